"""Provenance as columns: identity basis and the trust derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The provenance vocabularies.
SOURCE_KINDS = (
    "salesforce_column", "car_string", "spec_sheet", "folder_segment",
    "lexicon", "photo_classifier", "language_model", "human",
)
IDENTITY_BASES = ("none", "model_level", "sole_variant", "colour_unique", "human_picked")
UNIT_LEVEL = ("sole_variant", "colour_unique", "human_picked")
REMEDIES = ("add_folder", "confirm_field", "pick_one_of", "photograph_variant", "name_the_car")


def is_unit_level(basis: Column) -> Column:
    return basis.isin(*UNIT_LEVEL)


def trust(source: Column, basis: Column) -> Column:
    """A model proposes, a person is certain, anything else is certain only when the
    unit itself was known."""
    return (
        F.when(source == "language_model", F.lit("proposed"))
        .when(source == "human", F.lit("certain"))
        .when(is_unit_level(basis), F.lit("certain"))
        .otherwise("assumed")
    )


def remedy_text(code: Column, detail: Column) -> Column:
    return F.concat(code, F.lit(": "), detail)


def _known(text: Column) -> Column:
    return F.trim(F.substring_index(text, ": ", 1)).isin(*REMEDIES)


def remedy_code(text: Column) -> Column:
    """Leading code of a remedy text, null if it names none."""
    text = F.coalesce(text, F.lit(""))
    return F.when(_known(text), F.trim(F.substring_index(text, ": ", 1)))


def remedy_detail(text: Column) -> Column:
    """Detail without its code; text that carries no known code stays whole."""
    text = F.coalesce(text, F.lit(""))
    at = F.locate(": ", text)
    return F.when((at > 0) & _known(text), F.substring(text, at + 2, F.length(text))).otherwise(text)
