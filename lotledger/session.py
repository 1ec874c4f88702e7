"""Session-level helpers: cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What a task of ``small_tasks`` reads of a shuffle at most, if partitions are that small, or one of ``dealt``.
TASK_BYTES, TASK_ROWS = 8 << 20, 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a local session without
    one gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="lotledger-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used for dictionaries of distinct values that several later steps join: they
    are computed once, survive lost executors, and as files they carry the size
    Spark needs to choose between broadcasting and shuffling them.
    """
    path = f"{shared_dir(df.sparkSession)}/lotledger/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are never broadcast: both sides are shuffled and sorted.

    For tables that grow with the library. Of a file Spark knows the compressed bytes and takes a
    column's share of them by its type alone, so a column of paths counts for a fiftieth of what it
    holds in memory, and a broadcast would gather it in the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in tasks of at most ``TASK_ROWS`` rows, and in enough of them for all cores.

    A file of narrow rows is few tasks by its bytes, however much is parsed of a row or made of it.
    """
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)))


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, shuffles of ``rows`` rows are dealt to partitions of about ``TASK_ROWS``, and
    small ones are put together up to ``TASK_BYTES`` only.

    For narrow rows that a task widens: ids shrink to a few bytes a row in a shuffle, so the usual
    64 MB are millions of rows, and all the paths made of them stand in one task's hash table. The
    settings are the session's, and set back; what is written within must be computed within.
    """
    first = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    own = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{TASK_BYTES}b",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(first),
    }
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
