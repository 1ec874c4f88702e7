"""Saving and loading a library index as Parquet tables with a checked header."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.operators.library import Library

SCHEMA_ID = "library-index/2"
TABLES = ("folders", "variants", "sheets", "drift")


class EmptyIndexRefused(ValueError):
    """An index without model folders is the record of a failed crawl."""


class IndexCorrupt(ValueError):
    """Missing, of another schema, or at odds with its own header."""


def save_index(
    library: Library, path: str, root: str, fingerprint: str, crawled_at: Column, grammar_version: str = ""
) -> None:
    """Write the tables to a new version's folder, then one more row of the manifest, which names it.

    Readers follow the manifest's last row, so until that single file is in place they have the
    index before, whatever the writer has done and wherever it was stopped.
    """
    if library.folders.isEmpty():
        raise EmptyIndexRefused(f"refusing to save an index of {root!r} without model folders")
    spark = library.folders.sparkSession
    version = uuid.uuid4().hex
    for name in TABLES:
        getattr(library, name).write.parquet(f"{path}/versions/{version}/{name}")
    counts = {f"n_{t}": spark.read.parquet(f"{path}/versions/{version}/{t}").count() for t in TABLES}
    try:
        number = spark.read.parquet(f"{path}/manifest").agg(F.max("number")).first()[0] + 1
    except AnalysisException:
        number = 1
    header = spark.range(1).select(
        F.lit(number).cast("bigint").alias("number"), F.lit(version).alias("version"),
        F.lit(SCHEMA_ID).alias("schema_id"), F.lit(root).alias("root"), F.lit(fingerprint).alias("fingerprint"),
        crawled_at.cast("timestamp").alias("crawled_at"), F.lit(grammar_version).alias("grammar_version"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()],
    )
    header.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[Library, DataFrame]:
    """``(library, meta)`` of the manifest's last version, after the header checks."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest")
        head = manifest.orderBy(F.desc("number"), "version").first()
        tables = {name: spark.read.parquet(f"{path}/versions/{head['version']}/{name}") for name in TABLES} if head else {}
    except AnalysisException as error:
        raise IndexCorrupt(f"no readable index at {path}") from error
    if head is None or head["schema_id"] != SCHEMA_ID:
        raise IndexCorrupt(f"index schema is {head and head['schema_id']!r}, expected {SCHEMA_ID!r}")
    for name in TABLES:
        held = tables[name].count()
        if held != head[f"n_{name}"]:
            raise IndexCorrupt(f"header claims {head[f'n_{name}']} {name}, the table holds {held}")
    if head["n_folders"] == 0:
        raise EmptyIndexRefused(f"the index at {path} holds no model folders; recrawl the library")
    return Library(**tables), manifest.filter(F.col("version") == head["version"])


def save_folder_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_folder_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The flat folder index, or None where it was never built."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
