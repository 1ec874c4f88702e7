"""Feature labels onto catalog ids and checkbox vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx
from lotledger.functions.vocab import FEATURE_ACRONYMS, FEATURE_SYNONYMS
from lotledger.operators.resolve import resolve_column, with_best_options
from lotledger.session import settle

MATCH_THRESHOLD = 0.6


def resolve_features(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Labels to distinct catalog ids per car.

    ``labels``: ``car, ord, label``; ``catalog``: ``id, name, slug, parent,
    parent_id, ord``. Rows of kind ``matched`` (first label per id) and
    ``unresolved``.
    """
    labels = labels.withColumn("label", tx.strip(F.col("label"))).filter("label != ''")
    options = catalog.select(
        "id", F.nullif("name", F.lit("")).alias("name"), F.array(F.nullif("slug", F.lit(""))).alias("aliases"), "ord"
    )
    entry = catalog.groupBy("id").agg(F.min_by(F.struct("name", "slug", "parent", "parent_id"), "ord").alias("e"))
    found = resolve_column(labels, "label", options)
    matched = (
        found.filter("res.status = 'matched'")
        .groupBy("car", F.col("res.id").alias("id"))
        .agg(F.min_by(F.struct("label", "res.method", "ord"), "ord").alias("m"))
        .join(entry, "id")
        .select(
            F.lit("matched").alias("kind"), "car", "id", "e.name", "e.slug", "e.parent", "e.parent_id",
            "m.label", "m.method", "m.ord", F.lit("matched").alias("status"),
        )
    )
    unresolved = found.filter("res.status != 'matched'").select(
        F.lit("unresolved").alias("kind"), "car", "label", "ord", "res.status", "res.candidates"
    )
    return matched.unionByName(unresolved, allowMissingColumns=True)


def _rule_hits(item: Column) -> Column:
    """Targets named outright, in order: phrases contained, then short forms as words."""
    lowered, words = F.lower(item), tx.plain_words(item)
    target = lambda t: F.struct(F.lit(t[0]).alias("group"), F.lit(t[1]).alias("label"))
    hits = [F.when(lowered.contains(p), target(t)) for p, t in FEATURE_SYNONYMS.items()]
    hits += [F.when(F.array_contains(words, a), target(t)) for a, t in FEATURE_ACRONYMS.items()]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def match_vocabulary(
    items: DataFrame, vocabulary: DataFrame, flat: bool, threshold: float = MATCH_THRESHOLD
) -> DataFrame:
    """Best vocabulary label of each distinct ``item``.

    ``vocabulary``: ``group, label, ord``. A flat vocabulary must hold a rule's
    target for the rule to apply; a grouped one need not. Returns ``item, group,
    label`` with nulls for no match.
    """
    items = items.select("item").distinct().select("item", tx.sealed(_rule_hits(F.col("item"))).alias("hits"))
    if flat:
        offered = vocabulary.groupBy("label").agg(F.min_by("group", "ord").alias("group"))
        rules = (
            items.select("item", F.posexplode("hits").alias("pos", "hit"))
            .select("item", "pos", F.col("hit.label").alias("label"))
            .join(offered, "label")
            .groupBy("item")
            .agg(F.min_by(F.struct("group", "label"), "pos").alias("rule"))
        )
        ruled = items.join(rules, "item", "left").drop("hits")
    else:
        ruled = items.select("item", F.get("hits", F.lit(0)).alias("rule"))
    options = vocabulary.select(F.lit(0).alias("__s"), F.col("group").alias("id"), F.col("label").alias("name"), "ord")
    found = with_best_options(
        ruled.withColumn("__s", F.lit(0)), F.when(F.col("rule").isNull(), F.col("item")), options, ["__s"],
        tx.stemmed_tokens, keep=1, floor=threshold,
    )
    top = F.get("top", F.lit(0))
    scored = F.when(top.score >= threshold, F.struct(top.id.alias("group"), top["name"].alias("label")))
    best = F.coalesce("rule", scored)
    return found.select("item", best["group"].alias("group"), best["label"].alias("label"))


def enrich_features(items: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(features, notes)``: labels per car and group in first-seen order, and the
    sentence listing what found no checkbox.

    ``items``: ``car, ord, item``, exploded from one extraction record per car,
    so an array rebuilt here is no larger than the record it came from.
    """
    items = items.filter(tx.strip(F.col("item")) != "")
    found = items.join(settle(match_vocabulary(items, vocabulary, flat=False)), "item")
    features = (
        found.filter("group IS NOT NULL")
        .groupBy("car", "group", "label")
        .agg(F.min("ord").alias("ord"))
        .groupBy("car", "group")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("l"))
        .select("car", "group", F.transform("l", lambda x: x.label).alias("labels"))
    )
    notes = (
        found.filter("group IS NULL")
        .groupBy("car")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("l"))
        .select(
            "car",
            F.concat(
                F.lit("no_matching_checkbox_for: "), F.array_join(F.transform("l", lambda x: x["item"]), ", ")
            ).alias("note"),
        )
    )
    return features, notes
