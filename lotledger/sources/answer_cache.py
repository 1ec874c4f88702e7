"""The remembered-answer cache: a snapshot dealt by key into buckets, and the answers appended since.

* ``appended/batch=<id>/bucket=<n>``: one folder an append;
* ``snapshots/<version>/bucket=<n>``: the latest answer of every key;
* ``manifest``: one row a snapshot, with the batches that need not be read any more.

A lookup reads the buckets of its keys only. ``compact`` folds the batches into a new snapshot and
writes its manifest row last, so a writer stopped anywhere leaves the cache before. Folders that
only the snapshot before last needed are removed, so neither size nor listing grows with history.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lotledger.operators.colours import CACHE_COLUMNS, cache_key, upsert_cache

SCHEMA = "parent string, raw_key string, raw_value string, status string, name string, id string, resolved_at timestamp, method string"
BUCKETS = 64


def bucket_of(parent: Column, raw_key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(parent, raw_key), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    """A folder and the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> set[str]:
    target, files = _folder(spark, f"{path}/appended")
    names = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
    return {n.removeprefix("batch=") for n in names if n.startswith("batch=")}


def _last(spark: SparkSession, path: str) -> Row | None:
    try:
        return spark.read.parquet(f"{path}/manifest").orderBy(F.desc("number"), "version").first()
    except AnalysisException:
        return None


def _held(spark: SparkSession, path: str, last: Row | None, batches: set[str], asked: list[int] | None) -> DataFrame:
    """The latest answer of every key in the snapshot and the batches, of the asked buckets."""
    empty = spark.createDataFrame([], SCHEMA)
    pruned = lambda df: (df if asked is None else df.filter(F.col("bucket").isin(asked))).select(*CACHE_COLUMNS)
    snapshot = pruned(spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{path}/snapshots/{last['version']}")) if last else empty
    if not batches:
        return snapshot
    folders = [f"{path}/appended/batch={b}" for b in sorted(batches)]
    read = spark.read.schema(f"{SCHEMA}, batch string, bucket int").option("basePath", f"{path}/appended")
    return upsert_cache(snapshot, pruned(read.parquet(*folders)))


def load_cache(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Latest answer per key; a cache that was never written is empty. With ``keys`` (``parent,
    raw_key``) only their answers, from their buckets; the driver gets bucket numbers alone."""
    last = _last(spark, path)
    batches = _batches(spark, path) - set(last["batches"] if last else [])
    if keys is None:
        return _held(spark, path, last, batches, None)
    keys = keys.select("parent", "raw_key").distinct()
    asked = [r["b"] for r in keys.select(bucket_of(F.col("parent"), F.col("raw_key")).alias("b")).distinct().collect()]
    return _held(spark, path, last, batches, asked).join(keys, ["parent", "raw_key"], "left_semi").select(*CACHE_COLUMNS)


def append_answers(records: DataFrame, path: str) -> None:
    rows = records.withColumn("raw_key", cache_key(F.col("raw_value"))).select(*CACHE_COLUMNS)
    rows = rows.withColumn("bucket", bucket_of(F.col("parent"), F.col("raw_key")))
    rows.write.partitionBy("bucket").parquet(f"{path}/appended/batch=b{uuid.uuid4().hex}")


def compact(spark: SparkSession, path: str) -> None:
    """Fold what was appended into a new snapshot. One compaction of a cache runs at a time; appends
    may go on meanwhile."""
    last, present = _last(spark, path), _batches(spark, path)
    folded = set(last["batches"] if last else [])
    version = uuid.uuid4().hex
    rows = _held(spark, path, last, present - folded, None).withColumn("bucket", bucket_of(F.col("parent"), F.col("raw_key")))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/snapshots/{version}")
    row = (last["number"] + 1 if last else 1, version, last["version"] if last else None, sorted(present))
    head = spark.createDataFrame([row], "number long, version string, before string, batches array<string>")
    head.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    # Readers of the snapshot before need neither its folded batches nor the snapshot before it.
    gone = [f"appended/batch={b}" for b in sorted(folded & present)] + ([f"snapshots/{last['before']}"] if last and last["before"] else [])
    for name in gone:
        target, files = _folder(spark, f"{path}/{name}")
        files.delete(target, True)
