"""Specification rows resolved onto a catalog of parents and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotledger.functions import text as tx
from lotledger.functions.vocab import NUMERIC_PARENTS, SPEC_LABEL_HINTS
from lotledger.operators.resolve import _result, resolve_values, with_best_options
from lotledger.session import settle

PARENT_SCORE = 0.6


def hinted_parent(label: Column) -> Column:
    """Parent by hint: the whole label first, then the first hint it contains."""
    plain = tx.clean(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z ]", " "))
    # A constant list that is searched, not a branch for each hint: the plan stays small.
    hints = F.array(*[F.struct(F.lit(h).alias("hint"), F.lit(p).alias("parent")) for h, p in SPEC_LABEL_HINTS.items()])
    first = lambda test: F.get(F.filter(hints, test), F.lit(0))["parent"]
    return tx.bound(plain, lambda p: F.coalesce(first(lambda h: p == h["hint"]), first(lambda h: F.contains(p, h["hint"]))))


def label_parents(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """``label -> parent`` for distinct labels; ``parents``: ``name, ord``."""
    labels = labels.select("label").distinct().select("label", tx.sealed(hinted_parent(F.col("label"))).alias("hint"))
    options = parents.select(F.lit(0).alias("__s"), F.col("name").alias("id"), "name", "ord")
    found = with_best_options(
        labels.withColumn("__s", F.lit(0)), F.when(F.col("hint").isNull(), F.col("label")), options, ["__s"],
        tx.token_set, keep=1,
    )
    best = F.get("top", F.lit(0))
    return found.select(
        "label", F.coalesce("hint", F.when(best.score >= PARENT_SCORE, best["name"])).alias("parent")
    )


def resolve_spec_values(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct ``(parent, value)`` resolved within the parent; numeric parents by
    their first integer before anything else. ``catalog``: ``parent, id, name,
    slug, ord``. Adds ``res``."""
    values = values.select("parent", "value").distinct()
    ints = (
        catalog.filter(F.col("parent").isin(*NUMERIC_PARENTS))
        .select("parent", tx.first_int(F.col("name")).alias("n"), F.struct("id", "name").alias("o"), "ord")
        .filter("n IS NOT NULL")
        .groupBy("parent", "n")
        .agg(F.min_by("o", "ord").alias("num"))
    )
    options = catalog.select(
        "parent", "id", F.nullif("name", F.lit("")).alias("name"), F.array(F.nullif("slug", F.lit(""))).alias("aliases"), "ord"
    )
    numbered = values.withColumn("n", tx.first_int(F.col("value"))).join(ints, ["parent", "n"], "left")
    rest = resolve_values(numbered.filter("num IS NULL").select("parent", "value"), options, ["parent"]).select(
        "parent", F.col("value").alias("stripped"), F.col("res").alias("rest")
    )
    offered = catalog.select("parent").distinct().withColumn("offered", F.lit(True))
    joined = (
        numbered.withColumn("stripped", tx.strip(F.col("value")))
        .join(rest, ["parent", "stripped"], "left")
        .join(offered, "parent", "left")
    )
    numeric = _result(
        F.lit("matched"), F.lit("numeric"), id=F.col("num.id"), name=F.col("num.name"), confidence=F.lit(0.97)
    )
    res = (
        F.when(F.col("offered").isNull(), _result(F.lit("missing"), F.lit("unknown_parent")))
        .when(F.col("num").isNotNull(), numeric)
        .otherwise(F.col("rest"))
    )
    return joined.select("parent", "value", res.alias("res"))


def resolve_specifications(
    rows: DataFrame, catalog: DataFrame, parents: DataFrame, fallbacks: DataFrame | None = None
) -> DataFrame:
    """Specification rows to one value per ``(car, parent)``.

    ``rows``: ``car, ord, label, value``. ``parents``: ``name, mandatory, ord``.
    ``fallbacks``: ``car, stage, ord, parent, value`` with stage 1 for model-code
    colours and 2 for folder segments, used where earlier stages left the parent
    open. Returns one row per outcome with ``kind`` in ``resolved, unresolved,
    unmapped``.
    """
    # Texts repeat over the cars: each distinct one is read and resolved once, then its rows meet it.
    texts = rows.select("label", "value").distinct().withColumns(
        {"__label": tx.strip(F.col("label")), "__value": tx.strip(F.col("value"))}
    )
    texts = settle(texts.filter("__label != '' AND __value != ''"))
    parent_of = settle(label_parents(texts.select(F.col("__label").alias("label")), parents)).withColumnRenamed("label", "__label")
    texts = texts.join(parent_of, "__label")
    asked = texts.select("parent", F.col("__value").alias("value")).filter("parent IS NOT NULL")
    if fallbacks is not None:
        tinted = F.coalesce((F.col("stage") == 1) & (F.col("parent") == "Color"), F.lit(False))
        fallbacks = fallbacks.withColumn("__tinted", tinted)
        colour = F.when(F.col("__tinted"), tx.primary_colour(F.col("value")))
        given = fallbacks.select("__tinted", "parent", "value").distinct().withColumn("__value", F.coalesce(colour, F.col("value")))
        given = settle(given.filter("__value != ''"))
        asked = asked.unionByName(given.select("parent", F.col("__value").alias("value")))
    resolved = settle(resolve_spec_values(asked, catalog)).withColumnRenamed("value", "__value")
    texts = settle(texts.join(resolved, ["parent", "__value"], "left"))
    sheet = rows.select("car", "ord", "label", "value").join(texts, ["label", "value"]).select(
        "car", F.lit(0).alias("stage"), "ord", "parent", F.col("__label").alias("label"), F.col("__value").alias("value"), "res"
    )
    loose = sheet.filter("parent IS NULL").select(F.lit("unmapped").alias("kind"), "car", "label", "value", "ord")
    found = sheet.filter("parent IS NOT NULL")
    if fallbacks is not None:
        label = F.when(F.col("stage") == 1, F.lit("model code")).otherwise("folder path")
        more = fallbacks.join(settle(given.join(resolved, ["parent", "__value"])), ["__tinted", "parent", "value"])
        found = found.unionByName(
            more.select("car", "stage", "ord", "parent", label.alias("label"), F.col("__value").alias("value"), "res")
        )
    # One pass over each car's rows of a parent, in the order of asking: the earliest match wins,
    # anything after it never gets asked.
    matched = F.col("res.status") == "matched"
    asking = Window.partitionBy("car", "parent").orderBy("stage", "ord")
    upto = asking.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumns({"__won": F.count_if(matched).over(upto), "__tied": F.count_if(matched).over(asking)})
    # Failures before the winner are reported; colour fallbacks only with
    # candidates, folder segments never.
    reported = (F.col("stage") == 0) | ((F.col("stage") == 1) & (F.size("res.candidates") > 0))
    lost = F.col("car").isNotNull() & ~matched & reported & (F.col("__tied") == 0)
    found = found.withColumn("__wins", matched & (F.col("__won") == 1)).filter(F.col("__wins") | lost)
    stage, wins = F.col("stage"), F.col("__wins")
    from_text = F.when(stage == 2, F.concat(F.lit("folder path: "), F.col("value"))).when(
        stage == 1, F.concat(F.lit("model code: "), F.col("value"))
    ).otherwise(F.concat("label", F.lit(": "), "value"))
    prefix = F.when(stage == 2, F.lit("folder_path_")).when(stage == 1, F.lit("model_code_")).otherwise(F.lit(""))
    out = found.select(
        F.when(wins, F.lit("resolved")).otherwise("unresolved").alias("kind"), "car", "parent",
        F.when(wins, F.col("res.id")).alias("id"), F.when(wins, F.col("res.name")).alias("name"),
        F.when(wins, from_text).alias("matched_from"), F.when(wins, F.concat(prefix, "res.method")).alias("method"),
        F.col("res.status").alias("status"),
        *[F.when(~wins, F.col(c)).alias(c) for c in ("label", "value", "ord")],
        F.when(~wins, F.col("res.candidates")).alias("candidates"),
    )
    return out.unionByName(loose, allowMissingColumns=True)


def mandatory_gaps(cars: DataFrame, filled: DataFrame, mandatory: DataFrame) -> DataFrame:
    """Per car the mandatory names not filled, in catalog order.

    ``filled``: ``car, name``; ``mandatory``: ``name, ord``. The name list is the
    form's own, so it travels as one scalar array.
    """
    wanted = mandatory.agg(F.array_sort(F.collect_set(F.struct("ord", "name"))).alias("m")).scalar()
    have = filled.join(mandatory.select("name"), "name", "left_semi").groupBy("car").agg(
        F.collect_set("name").alias("have")
    )
    return (
        cars.select("car")
        .join(have, "car", "left")
        .withColumn("wanted", wanted)
        .select(
            "car",
            F.array_except(
                F.transform("wanted", lambda m: m["name"]), F.coalesce("have", F.array().cast("array<string>"))
            ).alias("unfilled"),
        )
        .withColumn("ready_to_prefill", F.size("unfilled") == 0)
    )
