"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every node of an edge.

    ``edges`` has columns a and b. In a large star every node links its larger
    neighbours to its smallest one, in a small star its smaller neighbours and
    itself; both keep components, and when neither changes anything each node
    hangs on the smallest of its component. A round is two aggregates with partial
    steps and two equality joins; a node with very many edges is split by the
    skew join, and nothing is gathered into one row.
    """
    e, mark = edges.select("a", "b").filter("a != b"), None
    while True:
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("m").alias("a"), "b")
        large = _ordered(large)
        down = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        hung = large.join(down, F.col("b") == F.col("u"))
        small = hung.select(F.col("m").alias("a"), F.col("a").alias("b")).union(hung.select(F.col("m").alias("a"), "b"))
        after = settle(_ordered(small))
        before, mark = mark, _mark(after)
        if mark == before:
            return after.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
                after.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
        e = after


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and hashes of the edges: equal for equal tables."""
    mark = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark), F.sum(mark % 1_000_003)).first())
