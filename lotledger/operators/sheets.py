"""Spec sheets that come with a car's number instead of from its folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.functions import modelcode
from lotledger.functions import text as tx
from lotledger.operators import colours, pending
from lotledger.operators.attempts import FALLBACK_NOTE, TRUNCATED_NOTE
from lotledger.session import settle

_PARSED = ("brand", "model", "trim", "year", "fuel_type", "engine_size", "transmission")


def upload_entries(uploads: DataFrame, report: DataFrame) -> DataFrame:
    """Uploads with the staged ``new`` entry of their number below the values given with them.

    ``uploads``: ``upload, model_number, product_description, price_aed``; ``report``: a pending
    report. Adds ``stock_id``, the description or else the number.
    """
    staged = pending.pending_entries(report, uploads.select("model_number").distinct()).select("model_number", F.col("entry").alias("s"))
    caller = F.struct("product_description", "price_aed")
    out = uploads.withColumn("c", caller).join(staged, "model_number", "left")
    given = [pending.prefer_caller(F.col("s"), F.col("c"), f).alias(f) for f in ("product_description", "price_aed")]
    return out.select("upload", "model_number", *given).withColumn(
        "stock_id", F.coalesce(F.nullif(tx.strip(F.col("product_description")), F.lit("")), F.col("model_number"))
    )


def sheet_outcomes(judged: DataFrame) -> DataFrame:
    """One row per uploaded sheet: its first usable attempt, or why it has none.

    ``judged``: ``upload, attempt`` and the columns of ``judge_replies``. There is no other sheet
    to turn to, so the error is that of the last attempt.
    """
    usable = F.col("json").isNotNull()
    notes = F.filter(
        F.array(F.when(F.col("w.truncated"), F.lit(TRUNCATED_NOTE)), F.when(F.col("w.attempt") > F.col("first"), F.lit(FALLBACK_NOTE))),
        lambda n: n.isNotNull(),
    )
    return (
        judged.groupBy("upload")
        .agg(
            F.min_by(F.struct("attempt", "json", "truncated"), F.when(usable, F.col("attempt"))).alias("w"),
            F.max_by("error", "attempt").alias("error"), F.min("attempt").alias("first"), F.count("*").alias("n_attempts"),
            F.bool_or(usable).alias("found"),
        )
        .select(
            "upload", "n_attempts", F.when(F.col("found"), F.col("w.attempt")).alias("attempt"), F.when(F.col("found"), F.col("w.json")).alias("json"),
            F.when(F.col("found"), notes).alias("low_confidence_fields"), F.when(~F.col("found"), F.col("error")).alias("extraction_error"),
        )
    )


def uploaded_sheets(
    uploads: DataFrame, report: DataFrame, judged: DataFrame, catalog: DataFrame, cache: DataFrame, answers: DataFrame | None = None
) -> DataFrame:
    """Every upload with its car's vehicle fields, its price and its sheet's extraction; no folder, no photos.

    Descriptions and numbers are read once per distinct text; a car without a colour has none, as
    there is no folder to read it off. An upload without a reply has an error.
    """
    entries = upload_entries(uploads, report)
    texts = modelcode.parse_descriptions(entries.select("stock_id").distinct(), "stock_id").select(
        F.col("stock_id").alias("car"), *[F.col(f"fields.{f}").alias(f) for f in _PARSED], F.col("fields._source").alias("parsed_by"),
        F.col("fields.exterior_color").alias("exterior_color"), F.col("fields.interior_color").alias("interior_color"),
        *[F.lit(None).cast("string").alias(c) for c in ("given_exterior", "given_interior", "folder_path")],
    )
    texts = settle(texts)
    no_folders = texts.select(F.lit("").alias("parent"), F.lit("").alias("path"), F.lit("").alias("exterior"), F.lit("").alias("interior")).limit(0)
    vehicles = colours.vehicle_colours(texts, no_folders, catalog, cache, answers).select(
        F.col("car").alias("stock_id"), *_PARSED, "parsed_by", "ext_raw", "int_raw", "ext_res", "int_res", "unresolved_colors"
    )
    out = entries.join(vehicles, "stock_id", "left").join(sheet_outcomes(judged), "upload", "left")
    return out.withColumn(
        "extraction_error", F.when(F.col("json").isNull(), F.coalesce("extraction_error", F.lit("no reply for the uploaded sheet")))
    ).fillna(0, ["n_attempts"])
