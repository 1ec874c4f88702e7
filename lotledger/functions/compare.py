"""Field comparison and elimination policy.

A comparable field travels as one *code*: ``-`` silent, ``?fp`` unparseable,
``=value`` stated (fingerprint, canonical decimal or year). Equal codes of a
real value are equal fields, so codes serve as verdict input, as join keys and
as distinctness marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotledger.functions import text as tx

EQUAL, ALIAS, DISAGREE, PREFIX = "equal", "equal_via_alias", "disagree", "prefix_only"
ONE_SILENT, BOTH_SILENT, UNCOMPARABLE = "one_silent", "both_silent", "uncomparable"

GATE, CORROBORATOR, SEPARATOR, EVIDENCE_ONLY = "gate", "corroborator", "separator", "evidence_only"

# Role of each field, in consultation order.
ROLES = {
    "designation": GATE,
    "model_year": CORROBORATOR,
    "brand": CORROBORATOR,
    "exterior": SEPARATOR,
    "interior": SEPARATOR,
    "vin_tag": EVIDENCE_ONLY,
    "trim": CORROBORATOR,
    "fuel": CORROBORATOR,
    "engine_l": CORROBORATOR,
    "transmission": CORROBORATOR,
}
COMPARED = (
    "brand", "model_head", "trim", "fuel", "engine_l", "transmission", "model_year", "exterior", "interior", "vin_tag",
)
CORROBORATORS = tuple(f for f, r in ROLES.items() if r == CORROBORATOR)
NAME_FIELDS = ("designation", "brand", "model_head", "trim")


def role_of(field: Column) -> Column:
    """Role by field name; fields outside the table are evidence only."""
    out = F.lit(EVIDENCE_ONLY)
    for name, role in ROLES.items():
        out = F.when(field == name, F.lit(role)).otherwise(out)
    return out


def eliminates(role: Column, verdict: Column) -> Column:
    contradicts = verdict.isin(DISAGREE, PREFIX)
    return ((role == GATE) & (contradicts | (verdict == ONE_SILENT))) | ((role == CORROBORATOR) & contradicts)


def field_code(field: Column, numeric: bool = False) -> Column:
    value = field.value.cast("string") if numeric else tx.fingerprint(field.value)
    return (
        F.when(field.state == "silent", F.lit("-"))
        .when(field.state == "unparseable", F.concat(F.lit("?"), tx.fingerprint(field.raw)))
        .otherwise(F.concat(F.lit("="), value))
    )


def car_code(car: Column, name: str) -> Column:
    return field_code(car[name], numeric=name in ("engine_l", "model_year"))


def code_verdict(left: Column, right: Column, alias_id: Column | None = None) -> Column:
    silent_l, silent_r = left == "-", right == "-"
    alias = F.lit(False) if alias_id is None else alias_id.isNotNull()
    return (
        F.when(left.startswith("?") | right.startswith("?"), F.lit(UNCOMPARABLE))
        .when(silent_l & silent_r, F.lit(BOTH_SILENT))
        .when(silent_l | silent_r, F.lit(ONE_SILENT))
        .when((left == right) & (F.length(left) > 1), F.lit(EQUAL))
        .when(alias, F.lit(ALIAS))
        .otherwise(DISAGREE)
    )


def designation_verdict(left: Column, right: Column) -> Column:
    """Fingerprints: a prefix is a contradiction of its own kind."""
    return (
        F.when((left == "") | (right == ""), F.lit(ONE_SILENT))
        .when(left == right, F.lit(EQUAL))
        .when(left.startswith(right) | right.startswith(left), F.lit(PREFIX))
        .otherwise(DISAGREE)
    )


def first_killer(verdicts: dict[str, Column]) -> Column:
    """First eliminating field in consultation order, null if none."""
    order = [f for f in ROLES if f in verdicts] + [f for f in verdicts if f not in ROLES]
    return F.coalesce(
        *[F.when(eliminates(F.lit(ROLES.get(f, EVIDENCE_ONLY)), verdicts[f]), F.lit(f)) for f in order]
    )


def sentence(field: str, verdict: Column, left: Column, right: Column, alias_id: Column | None = None) -> Column:
    """One line explaining a comparison."""
    q = tx.quoted
    name = F.lit(f"{field}: ")
    alias = F.lit("None") if alias_id is None else alias_id
    return (
        F.when(verdict == DISAGREE, F.concat(name, q(left), F.lit(" vs "), q(right)))
        .when(verdict == PREFIX, F.concat(name, q(left), F.lit(" is only a prefix of "), q(right), F.lit(" — not the same model")))
        .when(verdict == ONE_SILENT, F.concat(name, F.lit("only one side states it ("), q(F.coalesce(F.nullif(left, F.lit("")), right)), F.lit(")")))
        .when(verdict == BOTH_SILENT, F.concat(name, F.lit("neither side states it")))
        .when(verdict == UNCOMPARABLE, F.concat(name, F.lit("could not be read")))
        .when(verdict == ALIAS, F.concat(name, q(left), F.lit(" = "), q(right), F.lit(" (alias "), alias, F.lit(")")))
        .otherwise(F.concat(name, q(left)))
    )


def compare_cars(left: Column, right: Column) -> dict[str, Column]:
    """Verdict per field for two car structs."""
    out = {"designation": designation_verdict(left.designation.fingerprint, right.designation.fingerprint)}
    out.update({f: code_verdict(car_code(left, f), car_code(right, f)) for f in COMPARED})
    return out


def comparison_sentences(left: Column, right: Column) -> dict[str, Column]:
    verdicts = compare_cars(left, right)
    raw = lambda car, f: car.designation.raw if f == "designation" else car[f].raw
    return {f: sentence(f, v, raw(left, f), raw(right, f)) for f, v in verdicts.items()}
