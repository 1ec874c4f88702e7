"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, so that no column of the caller is hit."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


#: Rows that are computed and handed back at once; a task holds the results of no more.
STEP_ROWS = 512


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(at, STEP_ROWS)


def add_columns(df: DataFrame, compute, added: dict[str, str]) -> DataFrame:
    """Map Arrow batches, keeping every column and adding those that ``compute``
    returns for a batch (name to array). A column of the same name is replaced."""
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(field(k, v) for k, v in added.items())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            new = compute(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(new[k] for k in added)], names=[*names, *added])

    return df.mapInArrow(run, schema)
