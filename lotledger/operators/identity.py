"""Two readings of a vehicle's identity merged per field, conflicts flagged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx

COMPARED_FIELDS = ("brand", "model", "trim", "year")


def _long(df: DataFrame, side: str) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.nullif(tx.strip(F.col(f).cast("string")), F.lit("")).alias("value"))
            for i, f in enumerate(COMPARED_FIELDS)
        ]
    )
    return df.select("car", F.explode(pairs).alias("p")).filter("p.value IS NOT NULL").select(
        "car", "p.pos", "p.field", F.col("p.value").alias(side)
    )


def merge_identity(codes: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row per car and stated field; the sheet's reading is preferred."""
    both = _long(codes, "model_code").join(_long(sheets, "spec_sheet"), ["car", "pos", "field"], "full")
    agreed = tx.normal_form(F.col("model_code")) == tx.normal_form(F.col("spec_sheet"))
    source = (
        F.when(F.col("spec_sheet").isNull(), F.lit("model_code"))
        .when(F.col("model_code").isNull(), F.lit("spec_sheet"))
        .when(agreed, F.lit("agreed"))
        .otherwise("conflict")
    )
    return both.withColumn("source", source).select(
        "car", "pos", "field", F.coalesce("spec_sheet", "model_code").alias("value"), "source",
        (F.col("source") == "conflict").alias("conflict"), "model_code", "spec_sheet",
    )


def conflict_summary(merged: DataFrame) -> DataFrame:
    """Reviewer sentence per car with conflicts; at most one part per compared field."""
    part = F.concat(
        F.col("field"), F.lit(' (sheet says "'), F.col("spec_sheet"), F.lit('", code says "'), F.col("model_code"), F.lit('")')
    )
    return (
        merged.filter("conflict")
        .groupBy("car")
        .agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("l"))
        .select(
            "car",
            F.concat(
                F.lit("The spec sheet and the Model Code disagree on "),
                F.array_join(F.transform("l", lambda x: x.part), "; "),
                F.lit(". The spec sheet's reading was used — confirm it before publishing."),
            ).alias("summary"),
        )
    )
