"""Resolving text onto a controlled list of options.

One value is matched by exact name or alias, then by normalised form, then by
token overlap. Work is done per *distinct* value, and each step only sees what
the cheaper step left over.

Options stand in one total order (``ord``, then id, then name). The token step is a
set-similarity join by prefix filter, the same for catalogs of every size:

* A score of ``floor`` or more needs a shared part of the smaller set, so of sets of n
  and s tokens at least T = ``needed(min(n, s))`` must be shared.
* Tokens stand from rare to frequent. Two sets that share T tokens meet in the first
  n - T + 1 and s - T + 1 of them, so each set is listed under these tokens only, with T
  in the key, and the frequent ones at its end are no key at all. T is two at least here.
* Sharing a single token is enough only where a set has two tokens or one. The score then
  depends on the sizes alone, so per token and size the earliest ``keep`` options stand
  for all others of that size: they share as much and come earlier.

Candidates are verified on their token sets. For values with no option above the floor the
best score is found in the same way, with the best of the single tokens as the bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotledger.functions import text as tx
from lotledger.session import settle

CONFIDENT_THRESHOLD = 0.82
MIN_MARGIN = 0.10
CANDIDATE_FLOOR = 0.35
MAX_CANDIDATES = 5
#: Share of containment in the score.
CONTAINED = 0.85

RESULT_FIELDS = ("status", "id", "name", "confidence", "method", "candidates")
_RESULT_TYPE = (
    "struct<status:string,id:string,name:string,confidence:double,method:string,"
    "candidates:array<struct<id:string,name:string,score:double>>>"
)


def _result(status: Column, method: Column, **given: Column) -> Column:
    empty = {
        "status": status,
        "id": F.lit(None),
        "name": F.lit(None),
        "confidence": F.lit(0.0),
        "method": method,
        "candidates": F.array(),
    }
    empty.update(given)
    return F.struct(*[c.alias(n) for n, c in empty.items()]).cast(_RESULT_TYPE)


def needed(size: Column, score: Column | float) -> Column:
    """Tokens that sets must share for ``score``, the smaller having ``size``; two at least. (The
    Jaccard part asks for more wherever it decides.)"""
    return F.greatest(F.lit(2), F.ceil(size * (F.lit(score) if isinstance(score, float) else score) / CONTAINED - 1e-9)).cast("int")


def _rare_first(sets: DataFrame, by: list[str], column: str, counts: DataFrame, *carry: str) -> DataFrame:
    """Adds ``_r``, the tokens of a set from rare to frequent; unknown ones are the rarest."""
    return (
        sets.select(*by, column, *carry, F.explode(column).alias("_t")).join(counts, [*by, "_t"], "left").groupBy(*by, column, *carry)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("n"), "_t"))), lambda x: x["_t"]).alias("_r"))
    )


def _keys(sets: DataFrame, carry: list[str], low: Column, high: Column, *more: Column) -> DataFrame:
    """One row per number of shared tokens from ``low`` to ``high`` and token in the prefix it leaves."""
    upto = F.least(high, F.size("_r"))
    listed = sets.select(*carry, *more, "_r", F.explode(F.when(upto >= low, F.sequence(low, upto))).alias("_need"))
    return listed.withColumn("_t", F.explode(F.expr("slice(_r, 1, size(_r) - _need + 1)"))).drop("_r")


def with_best_options(
    df: DataFrame, ask: Column, options: DataFrame, by: Sequence[str], tokenise,
    keep: int = MAX_CANDIDATES, floor: float = CANDIDATE_FLOOR, below: str | None = None,
) -> DataFrame:
    """Add ``top``: the best ``keep`` options for the text ``ask`` of each row, as an
    array of ``score, ord, id, name``, best first, scores of ``floor`` or more only. Rows
    with a null ``ask`` get an empty array. ``below`` names a column for the best score of
    rows whose array is empty. Rows of ``df`` must be distinct; a repeated option counts once."""
    by = list(by)
    df = df.select("*", tx.sealed(ask).alias("__ask"))
    asked = df.filter("__ask IS NOT NULL").select(*by, "__ask").distinct().withColumn("_v", F.array_sort(tokenise(F.col("__ask"))))
    opts = options.select(*by, "ord", "id", "name").distinct().withColumn("_o", F.array_sort(tokenise(F.col("name")))).filter(F.size("_o") > 0)
    # Equal token sets score equally: only the earliest few of each can rank.
    first_few = Window.partitionBy(*by, "_o").orderBy("ord", "id", "name")
    sets = opts.withColumn("_n", F.row_number().over(first_few)).filter(F.col("_n") <= keep).groupBy(*by, "_o").agg(
        F.array_sort(F.collect_list(F.struct("ord", "id", "name"))).alias("_few")
    )
    counts = sets.select(*by, F.explode("_o").alias("_t")).groupBy(*by, "_t").agg(F.count("*").alias("_df"))
    o_sets = settle(_rare_first(sets, by, "_o", counts, "_few"))
    # Counts again, now from the written sets.
    counts = o_sets.select(*by, F.explode("_o").alias("_t")).groupBy(*by, "_t").agg(F.count("*").alias("_df"))
    v_sets = settle(_rare_first(asked.select(*by, "_v").distinct(), by, "_v", counts))
    opts = o_sets.select(*by, "_o", F.explode("_few").alias("_e")).select(*by, "_o", "_e.*")

    n, s, two = F.size("_v"), F.size("_o"), F.lit(2)
    most = needed(o_sets.agg(F.max(F.size("_o"))).scalar(), floor)
    # The value is the smaller set, or equal; then the option is.
    o_large = _keys(o_sets, [*by, "_o"], two, needed(s, floor), F.lit("v").alias("_small"))
    o_small = _keys(o_sets, [*by, "_o"], needed(s, floor), needed(s, floor), F.lit("o").alias("_small"))
    v_small = _keys(v_sets, [*by, "_v"], needed(n, floor), needed(n, floor), F.lit("v").alias("_small"))
    v_large = _keys(v_sets, [*by, "_v"], two, F.least(needed(n, floor), most), F.lit("o").alias("_small"))
    met = v_small.unionByName(v_large).join(o_small.unionByName(o_large), [*by, "_small", "_need", "_t"]).select(*by, "_v", "_o").distinct()

    early = Window.partitionBy(*by, "_t", s).orderBy("ord", "id", "name")
    lists = opts.withColumn("_t", F.explode("_o")).withColumn("_n", F.row_number().over(early)).filter(F.col("_n") <= keep).drop("_n")
    single = v_sets.select(*by, "_v", F.explode("_v").alias("_t")).join(lists, [*by, "_t"]).filter(F.least(n, s) <= 2)

    names = [*by, "_v", "_o", "ord", "id", "name"]
    found = met.join(opts, [*by, "_o"]).select(names).unionByName(single.select(names)).distinct()
    found = found.withColumn("score", tx.set_score(F.col("_o"), F.col("_v"))).filter(F.col("score") >= floor)
    best = Window.partitionBy(*by, "_v").orderBy(F.desc("score"), "ord", "id", "name")
    top = (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
        .groupBy(*by, "_v").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "ord", "id", "name"))).alias("top"))
    )
    of_value = asked.join(top, [*by, "_v"], "left")
    if below:
        of_value = settle(of_value)
        low = v_sets.join(of_value.filter("top IS NULL").select(*by, "_v").distinct(), [*by, "_v"], "left_semi")
        of_value = of_value.join(_best_below(low, o_sets, by, floor).withColumnRenamed("_best", below), [*by, "_v"], "left")
    none = F.array().cast("array<struct<score:double,ord:bigint,id:string,name:string>>")
    out = df.join(of_value.drop("_v"), [*by, "__ask"], "left").drop("__ask")
    return out.withColumn("top", F.coalesce(F.transform("top", lambda t: t.dropFields("rank")), none))


def _best_below(low: DataFrame, o_sets: DataFrame, by: list[str], floor: float) -> DataFrame:
    """``by..., _v, _best``: the best score of sets that no option meets at the floor."""
    n, s = F.size("_v"), F.size("_o")
    held = o_sets.select(*by, F.explode("_o").alias("_t"), s.alias("_size")).distinct()
    one = low.select(*by, "_v", "_r", F.explode("_v").alias("_t")).join(held, [*by, "_t"]).groupBy(*by, "_v", "_r").agg(
        F.max(tx.overlap_score(F.lit(1), n, F.col("_size"))).alias("_one")
    )
    one = settle(one)
    # As many sizes as the longest name has tokens, at most.
    sizes = F.coalesce(o_sets.agg(F.collect_set(F.size("_o"))).scalar(), F.array().cast("array<int>"))
    # More than one shared token: as above, with that score as the bound.
    small = _keys(one, [*by, "_v"], needed(n, F.col("_one")), needed(n, F.col("_one")), F.lit(0).alias("_size"))
    large = one.select("*", F.explode(sizes).alias("_size")).filter(F.col("_size") < n)
    need = needed(F.col("_size"), F.col("_one"))
    large = _keys(large, [*by, "_v"], need, need, F.col("_size"))
    listed = _keys(o_sets, [*by, "_o"], F.lit(2), needed(s, floor), s.alias("_own"))
    met = small.join(listed.drop("_own"), [*by, "_need", "_t"]).select(*by, "_v", "_o").unionByName(
        large.join(listed.withColumnRenamed("_own", "_size"), [*by, "_size", "_need", "_t"]).select(*by, "_v", "_o")
    )
    more = met.distinct().groupBy(*by, "_v").agg(F.max(tx.set_score(F.col("_o"), F.col("_v"))).alias("_more"))
    return one.select(*by, "_v", "_one").join(more, [*by, "_v"], "left").select(*by, "_v", F.greatest("_one", "_more").alias("_best"))


def resolve_values(values: DataFrame, options: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Resolution of every distinct ``(by..., value)``.

    ``values``: ``by..., value`` (repeats allowed). ``options``: ``by..., id,
    name, aliases, ord``; names and aliases count in the exact and normalised
    steps, scoring uses the name alone. Adds ``res``.
    """
    by = list(by) or ["__all"]
    scoped = by == ["__all"]
    if scoped:
        values, options = values.withColumn("__all", F.lit(0)), options.withColumn("__all", F.lit(0))
    values = values.select(*by, tx.strip(F.col("value")).alias("value")).distinct()
    names = options.select(
        *by, "ord", F.struct("id", "name").alias("o"),
        F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("label"),
    ).filter(F.col("label").isNotNull())

    # An exact hit is also a normalised hit, so one lookup serves both steps.
    norm = tx.normal_form
    labels = names.groupBy(*by, norm(F.col("label")).alias("norm"), "label").agg(
        F.min("ord").alias("ord"), F.min_by("o", "ord").alias("o")
    )
    hit = F.struct((F.col("label") != F.col("value")).alias("loose"), F.col("ord"), F.col("o"))
    named = (
        values.withColumn("norm", norm(F.col("value")))
        .join(labels, [*by, "norm"], "left")
        .groupBy(*by, "value")
        .agg(F.min(F.when(F.col("o").isNotNull() & (F.col("value") != ""), hit)).alias("hit"))
    )
    if scoped:
        named = named.withColumn("offered", F.nullif(options.agg(F.count("*") > 0).scalar(), F.lit(False)))
    else:
        named = named.join(options.select(*by).distinct().withColumn("offered", F.lit(True)), by, "left")
    ask = F.when((F.col("value") != "") & F.col("offered").isNotNull() & F.col("hit").isNull(), F.col("value"))
    joined = with_best_options(named, ask, options.select(*by, "id", "name", "ord"), by, tx.token_set, below="__below")
    score = lambda i: F.coalesce(F.get("top", F.lit(i)).score, F.lit(0.0))
    candidates = F.transform(
        "top",
        lambda t: F.struct(t.id.alias("id"), t["name"].alias("name"), F.bround(t.score, 3).alias("score")),
    )
    sure = (score(0) >= CONFIDENT_THRESHOLD) & (score(0) - score(1) >= MIN_MARGIN)
    best = F.get("top", F.lit(0))
    token = F.lit("token")
    named_hit = dict(id=F.col("hit.o.id"), name=F.col("hit.o.name"))
    res = (
        F.when(F.col("value") == "", _result(F.lit("absent"), F.lit("")))
        .when(F.col("offered").isNull(), _result(F.lit("missing"), F.lit("")))
        .when(~F.col("hit.loose"), _result(F.lit("matched"), F.lit("exact"), confidence=F.lit(1.0), **named_hit))
        .when(F.col("hit.loose"), _result(F.lit("matched"), F.lit("normalized"), confidence=F.lit(0.98), **named_hit))
        .when(sure, _result(F.lit("matched"), token, id=best.id, name=best["name"], confidence=score(0)))
        .when(F.size(candidates) > 0, _result(F.lit("ambiguous"), token, confidence=score(0), candidates=candidates))
        .otherwise(_result(F.lit("missing"), token, confidence=F.coalesce("__below", F.lit(0.0))))
    )
    out = joined.select(*by, "value", res.alias("res"))
    return out.drop("__all") if scoped else out


def resolve_column(
    df: DataFrame, value: str, options: DataFrame, by: Sequence[str] = (), into: str = "res"
) -> DataFrame:
    """``resolve_values`` joined back onto every row of ``df``. A null scope
    offers no options."""
    asked = df.select(*by, F.col(value).alias("value"))
    for b in by:
        asked = asked.filter(F.col(b).isNotNull())
    right = settle(resolve_values(asked, options, by)).select(
        *[F.col(b).alias(f"__r_{b}") for b in by], F.col("value").alias("__r_value"), F.col("res").alias(into)
    )
    on = tx.strip(F.col(value)) == F.col("__r_value")
    for b in by:
        on = on & (F.col(b) == F.col(f"__r_{b}"))
    unscoped = F.when(tx.strip(F.col(value)) == "", _result(F.lit("absent"), F.lit(""))).otherwise(
        _result(F.lit("missing"), F.lit(""))
    )
    return (
        df.join(right, on, "left")
        .drop("__r_value", *[f"__r_{b}" for b in by])
        .withColumn(into, F.coalesce(into, unscoped))
    )


def needs_human(res: Column) -> Column:
    return res.status.isin("ambiguous", "missing")


def resolve_vehicles(
    cars: DataFrame, taxonomy: DataFrame, levels: Sequence[str] = ("brand", "model", "trim")
) -> DataFrame:
    """Each level resolved within its resolved parent.

    ``taxonomy``: ``level, id, name, aliases, parent_id, ord``. Adds a result
    column per level, ``ready_to_prefill`` and ``blocked_on``.
    """
    out = cars
    for i, level in enumerate(levels):
        nodes = taxonomy.filter(F.col("level") == level)
        into = f"{level}_res"
        if i == 0:
            out = resolve_column(out, level, nodes, into=into)
            continue
        parent = F.col(f"{levels[i - 1]}_res")
        found = parent.status == "matched"
        out = out.withColumn("__parent", F.when(found, parent.id))
        out = resolve_column(out, level, nodes.withColumnRenamed("parent_id", "__parent"), ["__parent"], into)
        # Named after the first level that failed.
        above = F.coalesce(*[F.when(F.col(f"{lv}_res.status") != "matched", F.lit(lv)) for lv in levels[:i]])
        skipped = _result(F.lit("missing"), F.concat(F.lit("blocked_on_"), above))
        out = out.withColumn(into, F.when(F.col("__parent").isNull(), skipped).otherwise(F.col(into))).drop("__parent")
    unresolved = [F.when(F.col(f"{lv}_res.status") != "matched", F.lit(lv)) for lv in levels]
    return out.withColumn("blocked_on", F.coalesce(*unresolved)).withColumn(
        "ready_to_prefill", F.col("blocked_on").isNull()
    )
