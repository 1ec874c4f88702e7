"""Colours onto the catalog: rules, then remembered answers, then new answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import leaf
from lotledger.functions import text as tx
from lotledger.operators.resolve import _result
from lotledger.operators.specs import resolve_spec_values
from lotledger.session import settle

NO_MATCH = "NO_MATCH"
ANSWER_CONFIDENCE = 0.85
CACHE_COLUMNS = ("parent", "raw_key", "raw_value", "status", "name", "id", "resolved_at", "method")


def cache_key(raw: Column) -> Column:
    return F.upper(tx.strip(raw))


def upsert_cache(cache: DataFrame, records: DataFrame) -> DataFrame:
    """One row per ``(parent, raw_key)``, the latest resolution winning; a new record
    beats a cached one of the same instant."""
    records = records.withColumn("raw_key", cache_key(F.col("raw_value")))
    stacked = cache.select(*CACHE_COLUMNS, F.lit(0).alias("new")).unionByName(
        records.select(*CACHE_COLUMNS, F.lit(1).alias("new"))
    )
    body = F.struct(*[c for c in CACHE_COLUMNS if c not in ("parent", "raw_key")])
    return stacked.groupBy("parent", "raw_key").agg(
        F.max_by(body, F.struct("resolved_at", "new", "method")).alias("r")
    ).select("parent", "raw_key", "r.*")


def lookup_cache(values: DataFrame, cache: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Values left joined to their cached answer in ``hit``. A matched answer whose
    name left the catalog is a miss; missing answers stay valid."""
    entry = F.struct("status", "name", "id", "method")
    known = cache.select("parent", "raw_key", entry.alias("hit"))
    out = values.withColumn("raw_key", cache_key(F.col("value"))).join(known, ["parent", "raw_key"], "left")
    if catalog is not None:
        names = catalog.select("parent", F.col("name").alias("hit_name")).distinct().withColumn("listed", F.lit(True))
        out = out.withColumn("hit_name", F.col("hit.name")).join(names, ["parent", "hit_name"], "left")
        stale = (F.col("hit.status") == "matched") & F.col("listed").isNull()
        out = out.withColumn("hit", F.when(~stale, F.col("hit"))).drop("hit_name", "listed")
    return out.drop("raw_key")


def resolve_colours(
    colours: DataFrame, catalog: DataFrame, cache: DataFrame, answers: DataFrame | None = None
) -> DataFrame:
    """Distinct ``(parent, raw)`` to a result.

    Exterior colours reduce to their body part first. Values the rules leave open
    go to the cache, then to ``answers`` (``parent, raw_key, choice``) restricted
    to catalog names or NO_MATCH. Without ``answers`` open values keep the
    rules' own result.
    """
    reduced = F.when(F.col("parent") == "Color", tx.primary_colour(F.col("raw"))).otherwise(F.col("raw"))
    # The resolution asks for the distinct values in several jobs; what they are read off is read once.
    asked = settle(colours.select("parent", "raw").distinct().select("parent", "raw", tx.sealed(reduced).alias("value")))
    ruled = asked.join(settle(resolve_spec_values(asked.filter("value != ''"), catalog)), ["parent", "value"], "left")
    empty = tx.strip(F.col("raw")) == ""
    blank = _result(F.lit("missing"), F.lit("empty"))
    if answers is None:
        return ruled.select("parent", "raw", F.when(empty | F.col("raw").isNull(), blank).otherwise(F.col("res")).alias("res"))
    names = catalog.groupBy("parent", F.col("name").alias("choice")).agg(F.min_by("id", "ord").alias("choice_id"))
    replied = answers.groupBy("parent", "raw_key").agg(F.max("choice").alias("choice"))
    full = (
        lookup_cache(ruled, cache, catalog)
        .withColumn("raw_key", cache_key(F.col("value")))
        .join(replied, ["parent", "raw_key"], "left")
        .join(names, ["parent", "choice"], "left")
    )
    conf = F.lit(ANSWER_CONFIDENCE)
    missing = lambda m: _result(F.lit("missing"), F.lit(m))
    res = (
        F.when(empty | F.col("raw").isNull(), blank)
        .when((F.col("res.status") == "matched") | (F.col("res.method") == "unknown_parent"), F.col("res"))
        .when(F.col("hit.status") == "matched",
              _result(F.lit("matched"), F.lit("ai_cached"), id=F.col("hit.id"), name=F.col("hit.name"), confidence=conf))
        .when(F.col("hit").isNotNull(), missing("ai_cached_no_match"))
        .when(F.col("choice").isNull(), missing("llm_error"))
        .when(F.col("choice") == NO_MATCH, missing("llm_no_match"))
        .when(F.col("choice_id").isNotNull(),
              _result(F.lit("matched"), F.lit("llm"), id=F.col("choice_id"), name=F.col("choice"), confidence=conf))
        .otherwise(missing("llm_invalid_choice"))
    )
    return full.select("parent", "raw", res.alias("res"))


def new_cache_records(colours: DataFrame, resolved: DataFrame, run_at: Column) -> DataFrame:
    """Fresh answers worth remembering, in cache layout."""
    fresh = resolved.filter("res.method IN ('llm', 'llm_no_match')")
    value = F.when(F.col("parent") == "Color", tx.primary_colour(F.col("raw"))).otherwise(F.col("raw"))
    return fresh.select(
        "parent", cache_key(value).alias("raw_key"), value.alias("raw_value"), "res.status",
        "res.name", "res.id", run_at.alias("resolved_at"), "res.method",
    )


def vehicle_colours(
    cars: DataFrame, options: DataFrame, catalog: DataFrame, cache: DataFrame, answers: DataFrame | None = None
) -> DataFrame:
    """Both colours of every car: given, else parsed, else read off its folder.

    ``cars``: ``car, given_exterior, given_interior, exterior_color,
    interior_color, folder_path``. ``options``: ``parent, path, exterior,
    interior`` of colour folders. Several colour folders side by side leave both
    colours ``ambiguous``.
    """
    c = cars.withColumn("parent", F.when(F.col("folder_path").isNotNull(), tx.path_parent(F.col("folder_path"))))
    counts = options.groupBy("parent").agg(F.count("*").alias("n_options"))
    c = c.withColumn("folder", tx.path_name(F.col("folder_path")))
    c = leaf.parse_folder_colours(c, "folder", "f").join(counts, "parent", "left")
    several = F.coalesce(F.col("n_options") > 1, F.lit(False))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    # The folder is consulted only when one of the two colours is still open.
    c = c.withColumn("ext0", first("given_exterior", "exterior_color")).withColumn("int0", first("given_interior", "interior_color"))
    consulted = F.col("folder_path").isNotNull() & (F.col("ext0").isNull() | F.col("int0").isNull())
    c = c.withColumn("consulted", consulted).withColumn("several", several & consulted)
    read = F.col("consulted") & ~F.col("several")
    for side, tag in (("exterior", "ext"), ("interior", "int")):
        c = c.withColumn(f"{tag}_raw", F.coalesce(f"{tag}0", F.when(read, F.col(f"f.{side}"))))
    # Cars are parsed once: their colours are asked for, and the results joined, from the written rows.
    c = settle(c)
    sides = F.array(*[
        F.struct(F.lit(parent).alias("parent"), F.col(raw).alias("raw"))
        for parent, raw in (("Color", "ext_raw"), ("Interior Color", "int_raw"))
    ])
    wanted = c.select(F.inline(sides)).filter("raw IS NOT NULL")
    found = settle(resolve_colours(wanted, catalog, cache, answers))
    c = c.drop("parent")
    for parent, tag in (("Color", "ext"), ("Interior Color", "int")):
        part = found.filter(F.col("parent") == parent).select(F.col("raw").alias(f"{tag}_raw"), F.col("res").alias(f"{tag}_res"))
        c = c.join(part, f"{tag}_raw", "left")
        prefix = F.when(F.col(f"{tag}0").isNull(), F.lit("folder_")).otherwise(F.lit(""))
        res = F.col(f"{tag}_res")
        c = c.withColumn(
            f"{tag}_res",
            F.when(F.col(f"{tag}0").isNull() & F.col("several"), _result(F.lit("ambiguous"), F.lit("folder_ambiguous")))
            .when(res.isNotNull(), res.withField("method", F.concat(prefix, res.method))),
        )
    open_side = lambda tag, label: F.when(F.col(f"{tag}_res.status") != "matched", F.lit(label))
    unresolved = F.filter(
        F.array(open_side("ext", "exterior colour"), open_side("int", "interior colour")), lambda s: s.isNotNull()
    )
    return c.withColumn("unresolved_colors", unresolved).withColumn(
        "n_choices", F.when(F.col("several"), F.col("n_options")).otherwise(0)
    ).drop("ext0", "int0", "consulted", "several", "n_options", "f", "folder")
