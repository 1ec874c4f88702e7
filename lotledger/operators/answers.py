"""Model answers that arrive as tables: cleaning, consensus, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotledger.functions import text as tx
from lotledger.operators.features import match_vocabulary
from lotledger.session import settle


def _folded(c: Column) -> Column:
    return tx.strip(tx.fold_case(c))


def canonical_options(answers: DataFrame, options: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Inner join of answers to allowed options: exact text first, then caseless
    and trimmed, the last listed of options that fold alike. ``options``: ``by...,
    option, ord``, a form's own lists, so they travel to the answers: dealt out by
    field, all answers to one field would gather in a task. Adds ``canonical``."""
    exact = options.select(*by, F.col("option").alias(value), F.col("option").alias("__exact")).distinct()
    loose = (
        options.withColumn("__fold", _folded(F.col("option")))
        .groupBy(*by, "__fold")
        .agg(F.max_by("option", "ord").alias("__loose"))
    )
    return (
        answers.join(F.broadcast(exact), [*by, value], "left")
        .withColumn("__fold", _folded(F.col(value)))
        .join(F.broadcast(loose), [*by, "__fold"], "left")
        .withColumn("canonical", F.coalesce("__exact", "__loose"))
        .filter("canonical IS NOT NULL")
        .drop("__exact", "__loose", "__fold")
    )


def clean_field_answers(answers: DataFrame, fields: DataFrame) -> DataFrame:
    """Known fields with non-blank values; select fields canonicalised or dropped.

    ``answers``: ``car, provider, field, value``; ``fields``: ``field, type,
    options``. Returns ``car, provider, field, value``.
    """
    known = answers.filter(tx.strip(F.col("value")) != "").join(F.broadcast(fields.select("field", "type")), "field")
    cols = ["car", "provider", "field", "value"]
    allowed = fields.filter("type = 'select'").select("field", F.posexplode("options").alias("ord", "option"))
    selected = canonical_options(known.filter("type = 'select'"), allowed, ["field"]).select(
        *cols[:3], F.col("canonical").alias("value")
    )
    return known.filter("type != 'select'").select(*cols).unionByName(selected)


def field_precedence(cleaned: DataFrame, rank: str = "rank") -> DataFrame:
    """Per car and field the value of the earliest provider that has one."""
    return cleaned.groupBy("car", "field").agg(
        F.min_by("value", rank).alias("value"), F.min_by("provider", rank).alias("provider")
    )


def provider_summary(attempts: DataFrame) -> DataFrame:
    """``failed`` when no provider answered, ``degraded`` when some did not."""
    n_ok = F.count_if("ok")
    return attempts.groupBy("car").agg(
        F.count("*").alias("n_providers"), n_ok.alias("n_answered"),
        F.when(n_ok == 0, F.lit("failed")).when(n_ok < F.count("*"), F.lit("degraded")).otherwise("complete").alias("state"),
    )


def consensus(answers: DataFrame, answered: DataFrame) -> DataFrame:
    """Matched is the union over providers; unmatched must be named by every
    provider that answered, important if any said so.

    ``answers``: ``car, provider, kind, label`` with kind ``matched, important,
    other``; ``answered``: ``car, provider``. One row per car and label.
    """
    votes = answers.groupBy("car", "label", "provider").agg(
        F.bool_or(F.col("kind") == "matched").alias("m"),
        F.bool_or(F.col("kind") == "important").alias("i"),
        F.bool_or(F.col("kind") != "matched").alias("u"),
    )
    panel = answered.distinct().groupBy("car").agg(F.count("*").alias("panel"))
    return (
        votes.groupBy("car", "label")
        .agg(F.bool_or("m").alias("matched"), F.bool_or("i").alias("any_important"), F.count_if("u").alias("n_unmatched"))
        .join(panel, "car")
        .withColumn("suggested", F.col("n_unmatched") == F.col("panel"))
        .withColumn("important", F.col("suggested") & F.col("any_important"))
        .filter("matched OR suggested")
        .select("car", "label", "matched", "suggested", "important")
    )


def list_places(features: DataFrame) -> DataFrame:
    """Adds the places, from 1, of each label in its car's two lists, null where it is in neither:
    ``matched_place`` by label, ``suggested_place`` with important labels first, then by label."""
    place = lambda flag, *order: F.when(
        F.col(flag), F.row_number().over(Window.partitionBy("car", flag).orderBy(*order))
    )
    return features.withColumns({
        "matched_place": place("matched", "label"), "suggested_place": place("suggested", F.desc("important"), "label"),
    })


def _rule_pass(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Items with the vocabulary label found without a model, null if none."""
    usable = items.filter(tx.strip(F.col("item")) != "")
    found = settle(match_vocabulary(usable, vocabulary.withColumn("group", F.lit("")), flat=True))
    return items.join(found.select("item", F.col("label").alias("rule_label")), "item", "left")


def match_features(
    items: DataFrame, vocabulary: DataFrame, answers: DataFrame, answered: DataFrame
) -> DataFrame:
    """Rules first, then the providers' consensus over what the rules left.

    ``items``: ``car, item``. Matched answers are canonicalised, unmatched ones
    must be left-over items. Cars without left-overs were never asked.
    """
    passed = _rule_pass(items, vocabulary)
    rules = passed.filter("rule_label IS NOT NULL").select("car", F.col("rule_label").alias("label")).distinct()
    left = passed.filter("rule_label IS NULL").select("car", F.col("item").alias("label")).distinct()
    asked = answers.join(left.select("car").distinct(), "car", "left_semi")
    matched = canonical_options(
        asked.filter("kind = 'matched'"), vocabulary.select(F.col("label").alias("option"), "ord"), [], "label"
    ).select("car", "provider", "kind", F.col("canonical").alias("label"))
    unmatched = asked.filter("kind != 'matched'").join(left, ["car", "label"], "left_semi").select(
        "car", "provider", "kind", "label"
    )
    agreed = consensus(matched.unionByName(unmatched), answered)
    return (
        agreed.unionByName(
            rules.select("car", "label", F.lit(True).alias("matched"), F.lit(False).alias("suggested"), F.lit(False).alias("important"))
        )
        .groupBy("car", "label")
        .agg(F.bool_or("matched").alias("matched"), F.bool_or("suggested").alias("suggested"), F.bool_or("important").alias("important"))
    )


def match_all(items: DataFrame, vocabulary: DataFrame, answers: DataFrame) -> DataFrame:
    """Combined mode, first provider only: exact membership for matches, unmatched
    lists taken as they come. ``items``: ``car, ord, item``; ``answers``: ``car,
    kind, ord, label``. Rows ``car, kind, pos, label`` where matched labels keep
    rule order before answer order, each once."""
    rules = _rule_pass(items, vocabulary).filter("rule_label IS NOT NULL").select(
        "car", F.lit(0).alias("source"), "ord", F.col("rule_label").alias("label")
    )
    given = answers.filter("kind = 'matched'").join(vocabulary.select("label").distinct(), "label", "left_semi")
    matched = (
        rules.unionByName(given.select("car", F.lit(1).alias("source"), "ord", "label"))
        .groupBy("car", "label")
        .agg(F.min(F.struct("source", "ord")).alias("at"))
        .select("car", F.lit("matched").alias("kind"), F.col("at.source").alias("source"), F.col("at.ord").alias("ord"), "label")
    )
    suggested = answers.filter("kind != 'matched'").select(
        "car", "kind", F.when(F.col("kind") == "important", 0).otherwise(1).alias("source"), "ord", "label"
    )
    return matched.unionByName(suggested)
