"""Guards on incoming files and text layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx

MAX_PDF_BYTES = 25 * 1024 * 1024
MAX_STOCK_BYTES = 10 * 1024 * 1024
MIN_TEXT_WORDS = 50


def rejection(name: Column, size: Column, allowed: Sequence[str], max_bytes: int) -> Column:
    """Why a file is refused, null when it is accepted."""
    suffix = tx.file_suffix(name)
    shown = F.when(suffix == "", F.lit("(none)")).otherwise(suffix)
    return (
        F.when(
            ~suffix.isin(*allowed),
            F.concat(F.lit("Unsupported file type '"), shown, F.lit(f"' — expected one of {sorted(allowed)}")),
        )
        .when(size == 0, F.lit("Uploaded file is empty"))
        .when(
            size > max_bytes,
            F.format_string(f"File too large (%.1fMB) — max {max_bytes / 1024 / 1024:.0f}MB", size / 1024 / 1024),
        )
    )


def route_text_layers(documents: DataFrame, text: str = "text", minimum: int = MIN_TEXT_WORDS) -> DataFrame:
    """Add ``n_words`` and ``route``: ``text`` with enough words, else ``vision``."""
    cleaned = tx.clean(F.col(text))
    words = F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))
    return documents.withColumn("n_words", words).withColumn(
        "route", F.when(F.col("n_words") >= minimum, F.lit("text")).otherwise("vision")
    )
