"""Mixing sources to target weights by systematic sampling.

Every text of a source has the same expected number of copies, target over size
of its source. The texts of a source stand in a fixed order (size, then a hash
bucket, then id); copies are given by prefix sums: with one random offset u a
source, text number i gets floor(i * rate + u) - floor((i - 1) * rate + u)
copies, one for each integer boundary that the running sum crosses. Because the
order is by size, the words taken from a source differ from its target by less
than one longest text at either end.

The number i is the sum of three bounded parts: texts of smaller size (a window
over the distinct sizes of a source), texts of the same size in earlier buckets
(a window over at most 4096 rows), and the place in the bucket (a window over one
bucket of one size of one source). So a source, or a size, that holds a
third of all rows is never in one window.

Defined results: a null text has no words; null is a source of its own, last in
order; texts without words take part with size 0; a source without words has
target 0 and gives no copies; repeated rows are separate texts (equal ids keep
one order, and their copies are the same sum whichever comes first); an empty
table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from lotledger.llm.columns import unused
from lotledger.session import settle

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
SEED = "mix"


def n_words(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _offset(source: Column, seed: str) -> Column:
    """One number of [0, 1) a source, the same in every run."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("double") / F.lit(float(2**20))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight, target, rate) from (source, source_size).

    Sources in order of code points, null last, get the weights in turn. Targets
    share all words by weight; one that would pass ``most`` times its source stops
    there and the excess is shared again. With sources in the order of the level
    at which they stop (``most * size / weight``), those that stop are a prefix:
    source k stops if the level it would get, (total - stopped before) / weights
    from k on, reaches its own. One row a source; two windows over these rows.
    """
    by_name = Win.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("_level", most * F.col("source_size") / F.col("weight"))
    by_level = Win.orderBy("_level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Win.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Win.currentRow, Win.unboundedFollowing)
    every = Win.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    s = s.withColumn("_share", left / F.sum("weight").over(onward))
    s = s.withColumn("_stops", F.col("_share") >= F.col("_level"))
    # The first that doesn't stop has the common level; the shares after it only fall.
    common = F.max(F.when(~F.col("_stops"), F.col("_share"))).over(every)
    target = F.when(F.col("_stops"), most * F.col("source_size")).otherwise(F.col("weight") * common).cast("double")
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return s.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def allot(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
          weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row, in narrow columns: texts
    are read once, for their words."""
    rows = settle(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n_words(text).alias("size")))
    bucket = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 3)
    rows = rows.withColumn("bucket", bucket)
    cells = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    of_source = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(of_source, weights, most)

    smaller = Win.partitionBy("source").orderBy("size").rowsBetween(Win.unboundedPreceding, -1)
    by_size = by_size.select("source", "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before_size"))
    lower = Win.partitionBy("source", "size").orderBy("bucket").rowsBetween(Win.unboundedPreceding, -1)
    cells = cells.select("source", "size", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before_bucket"))
    cells = _join(_join(cells, by_size, "source", "size"), goal, "source")

    place = F.row_number().over(Win.partitionBy("source", "size", "bucket").orderBy("id"))
    r = _join(rows.withColumn("place", place), cells, "source", "size", "bucket")
    i = (F.col("place") + F.col("before_bucket") + F.col("before_size")).cast("double")
    u = _offset(F.col("source"), seed)
    copies = F.floor(i * F.col("rate") + u) - F.floor((i - 1) * F.col("rate") + u)
    return r.select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys of which any may be null."""
    right = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix itself: every row as many times as it has copies. Ids are taken as keys; where an
    id repeats, its rows share the copies of the id in total order of (source, size)."""
    size, turn, copies, again = (unused(docs, x) for x in ("size", "turn", "copies", "again"))
    shares = allot(docs, id_col, source, text, **how).filter("copies > 0")
    by_key = Win.partitionBy("id", "source", "size")
    shares = shares.select(
        *(F.col(c).alias(f"{copies}_{c}") for c in ("id", "source", "size", "copies")),
        F.row_number().over(by_key.orderBy(F.desc("copies"))).alias(f"{copies}_turn"),
    )
    # Rows with one id, source and size are alike for the sums: they are numbered on both sides.
    sized = docs.withColumn(size, n_words(text))
    sized = sized.withColumn(turn, F.row_number().over(Win.partitionBy(id_col, source, size).orderBy(F.xxhash64(text))))
    pairs = ((id_col, "id"), (source, "source"), (size, "size"), (turn, "turn"))
    out = sized.join(shares, [F.col(f"`{a}`").eqNullSafe(F.col(f"{copies}_{b}")) for a, b in pairs])
    out = out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(f"{copies}_copies").cast("int"))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
