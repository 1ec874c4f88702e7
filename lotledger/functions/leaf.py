"""Colour readings from variant-folder names; two grammars, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx

_INSIDE = r"(?i)\bINSIDE?\b"
_RUN = r"(?s)^(.*?)[\s\-]+([A-Za-z0-9]+)\s*$"
_YEAR = r"(?s)^(.*?)[\s\-]+(\d{2}|\d{4})\s*$"


def parse_leaves(df: DataFrame, source: str, into: str = "leaf", fold: bool = True) -> DataFrame:
    """Add ``struct<exterior, interior, vin_tag>``: tag off first, then year, then
    the split on INSIDE. Both colours are null unless both can be read."""
    keep = df.columns
    df = df.withColumn("__leaf", F.col(source))
    if fold:
        df = tx.fold_nfkc(df, "__leaf")
    df = df.withColumn("__leaf", tx.clean(F.col("__leaf")))
    df = df.withColumn("__run", F.regexp_extract("__leaf", _RUN, 2))
    df = df.withColumn("__vin", F.when(tx.looks_like_vin(F.col("__run")), F.upper("__run")))
    df = df.withColumn(
        "__leaf",
        F.when(F.col("__vin").isNotNull(), F.regexp_extract("__leaf", _RUN, 1)).otherwise(F.col("__leaf")),
    )
    df = df.withColumn(
        "__leaf",
        F.when(
            tx.year4(F.regexp_extract("__leaf", _YEAR, 2)).isNotNull(), F.regexp_extract("__leaf", _YEAR, 1)
        ).otherwise(F.col("__leaf")),
    )
    df = df.withColumn("__half", F.split("__leaf", _INSIDE, 2))
    return _both(df, keep, into, tx.tidy, F.col("__vin").alias("vin_tag"))


def parse_folder_colours(df: DataFrame, source: str, into: str = "folder_colours") -> DataFrame:
    """Looser reading ``struct<exterior, interior>``: tags of 11-17 characters,
    years xx, 19xx or 20xx, no compatibility folding."""
    keep = df.columns
    vin = r"(?i)[\s\-]+(?=[A-Z0-9]{11,17}\s*$)(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{11,17}\s*$"
    edges = r"^[ \-\t\x{A0}]+|[ \-\t\x{A0}]+$"

    def bare(half: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(half, edges, ""), r"(?U)\s{2,}", " ")
        return F.regexp_replace(inner, edges, "")

    body = F.regexp_replace(F.coalesce(F.col(source), F.lit("")), vin, "")
    df = df.withColumn("__half", F.split(F.regexp_replace(body, r"[\s\-]+(?:19|20)?\d{2}\s*$", ""), _INSIDE, 2))
    return _both(df, keep, into, bare)


def _both(df: DataFrame, keep: list[str], into: str, trim, *extra: Column) -> DataFrame:
    df = df.withColumn("__ext", trim(F.get("__half", F.lit(0)))).withColumn("__int", trim(F.get("__half", F.lit(1))))
    ok = (F.size("__half") == 2) & (F.col("__ext") != "") & (F.col("__int") != "")
    colours = F.struct(
        F.when(ok, F.col("__ext")).alias("exterior"), F.when(ok, F.col("__int")).alias("interior"), *extra
    )
    return df.select(*keep, tx.sealed(colours).alias(into))
