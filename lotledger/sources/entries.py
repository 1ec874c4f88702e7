"""File listings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.functions import text as tx


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` as ``path, name, is_dir, size, mtime_ns``, paths
    relative to the root. File content is pruned from the scan."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "modificationTime", "length")
    )
    base = root.rstrip("/") + "/"
    # Scheme and authority vary by file system; the root's own text does not.
    path = F.col("path")
    relative = F.substring_index(path, base, -1) if "://" in root else F.substring(
        path, F.locate(base, path) + F.lit(len(base)), F.length(path)
    )
    return files.select(
        relative.alias("path"),
        tx.path_name(F.col("path")).alias("name"),
        F.lit(False).alias("is_dir"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def ancestors(path: Column, own: bool = False) -> Column:
    """Proper ancestor paths of a relative path (the path itself too if ``own``)."""
    segments = F.split(path, "/")
    last = F.size(segments) if own else F.size(segments) - 1
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))


def directories(entries: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Distinct directory paths: those listed and all ancestors of entries.

    Siblings collapse to their parent before the ancestors are unfolded, so a
    crowded directory costs one row per task. ``parents``: ``path``, those of the
    files (where NOT is_dir) if they are known.
    """
    path, above = F.col("path"), tx.path_parent(F.col("path"))
    if parents is None:
        parents = entries.filter("NOT is_dir").select(above.alias("path"))
    rest = entries.filter("is_dir OR is_dir IS NULL").select(F.when(F.col("is_dir"), path).otherwise(above).alias("path"))
    parents = parents.unionByName(rest).distinct()
    return parents.filter("path != ''").select(F.explode(ancestors(F.col("path"), own=True)).alias("path")).distinct()
