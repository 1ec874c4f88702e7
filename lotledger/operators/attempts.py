"""Ordered attempts: candidate order, early stop, extraction report, car status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import replies as rp
from lotledger.functions import text as tx
from lotledger.session import merged, settle

TRUNCATED_NOTE = (
    "TRUNCATED: the spec sheet was longer than the model's output budget. Later specification rows and "
    "features are missing — verify against the sheet before publishing."
)
FALLBACK_NOTE = "__extraction_used_fallback_mode__ (strict schema attempt failed shape validation)"


def candidate_order(name: Column, key: Column, ord: Column) -> Column:
    """Sort key of a car's PDFs: the one named exactly after the car first."""
    exact = F.lower(tx.strip(name)) == F.concat(F.lower(tx.strip(key)), F.lit(".pdf"))
    return F.struct((~exact).alias("other"), ord.alias("ord"))


def until_stop(attempts: DataFrame, key: str, order: Column, stops: Column) -> DataFrame:
    """Attempts up to and including each key's first stop. The stop is an aggregate
    joined back, so a key with very many attempts is never gathered."""
    marked = attempts.withColumn("__order", order)
    stop = marked.groupBy(key).agg(F.min(F.when(stops, F.col("__order"))).alias("__stop"))
    return marked.join(stop, key).filter("__stop IS NULL OR __order <= __stop").drop("__order", "__stop")


def judge_replies(replies: DataFrame, content: str = "content", finish: str = "finish_reason") -> DataFrame:
    """Add ``json`` (usable extraction or null), ``error`` and ``truncated`` per reply."""
    df = replies.select("*", tx.sealed(rp.strip_fences(F.col(content))).alias("__body"))
    df = df.withColumn("__whole", F.try_parse_json("__body").isNotNull())
    cut = F.coalesce(F.col(finish).isin("length", "max_tokens"), F.lit(False))
    blank = tx.strip(F.col(content)) == ""
    df = rp.recover_json(df.withColumn("__try", F.when(cut | F.col("__whole"), F.col("__body"))), "__try", "__rec", F.col("__whole"))
    df = df.withColumn("truncated", cut & ~F.col("__whole") & ~blank)
    df = df.select("*", tx.sealed(rp.shape_issues(F.col("__rec.json"))).alias("__issues"))
    error = (
        F.when(blank, F.concat(F.lit("empty content (finish_reason="), F.coalesce(F.col(finish), F.lit("None")), F.lit(")")))
        .when(~F.col("__whole") & ~cut, F.lit("invalid JSON"))
        .when(F.col("__rec.json").isNull(), F.lit("output TRUNCATED at the token cap and could not be repaired."))
        .when(F.size("__issues") > 0, F.concat(F.lit("wrong shape — "), F.array_join("__issues", "; ")))
    )
    return (
        df.withColumn("error", error)
        .withColumn("json", F.when(F.col("error").isNull(), F.col("__rec.json")))
        .withColumn("dropped", F.col("__rec.dropped"))
        .drop("__body", "__whole", "__try", "__rec", "__issues")
    )


def extraction_report(judged: DataFrame) -> DataFrame:
    """One row per car: the first usable extraction over its PDFs and attempts.

    ``judged``: ``car, pdf, pdf_ord, search_key, attempt`` and the columns of
    ``judge_replies``. A PDF succeeds with its first usable attempt; the car
    stops at the first success or at the first PDF lost to truncation.
    """
    usable = F.col("json").isNotNull()
    pick = F.struct("attempt", "json", "truncated", "dropped")
    order = candidate_order(F.col("pdf"), F.col("search_key"), F.col("pdf_ord"))
    # The stop is joined back to the PDFs: they are settled, so that replies are judged once.
    pdfs = settle(
        judged.groupBy("car", "pdf", "pdf_ord", "search_key")
        .agg(
            F.min_by(pick, F.when(usable, F.col("attempt"))).alias("won"),
            F.bool_or(F.coalesce(F.col("error").contains("TRUNCATED"), F.lit(False))).alias("cut"),
            F.count("*").alias("n_attempts"),
        )
        .withColumn("won", F.when(F.col("won.json").isNotNull(), F.col("won")))
        .withColumn("order", order)
    )
    tried = until_stop(pdfs, "car", F.col("order"), F.col("won").isNotNull() | F.col("cut"))
    notes = F.filter(
        F.array(
            F.when(F.col("w.truncated"), F.lit(TRUNCATED_NOTE)), F.when(F.col("w.attempt") > 1, F.lit(FALLBACK_NOTE))
        ),
        lambda n: n.isNotNull(),
    )
    return (
        tried.groupBy("car")
        .agg(
            F.count("*").alias("n_pdfs_tried"), F.sum("n_attempts").alias("n_attempts"),
            F.min_by("won", F.when(F.col("won").isNotNull(), F.col("order"))).alias("w"),
            F.min_by("pdf", F.when(F.col("won").isNotNull(), F.col("order"))).alias("pdf"),
            F.bool_or(F.col("cut") & F.col("won").isNull()).alias("stopped_on_truncation"),
        )
        .select(
            "car", "n_pdfs_tried", "n_attempts", F.when(F.col("w").isNotNull(), F.col("pdf")).alias("pdf"),
            F.col("w.json").alias("json"), F.col("w.attempt").alias("attempt"), notes.alias("low_confidence_fields"),
            F.when(
                F.col("w").isNull(),
                F.concat(F.lit("None of the "), F.col("n_pdfs_tried").cast("string"), F.lit(" PDF(s) tried produced a usable extraction.")),
            ).alias("extraction_error"),
            "stopped_on_truncation",
        )
    )


def car_status(
    cars: DataFrame, files: DataFrame, extractions: DataFrame, photos_ok: Column | None = None, enabled: bool = True
) -> DataFrame:
    """Status of a batch of cars.

    ``cars``: ``car, folder_path, lookup_error, failed`` (``failed`` for errors
    other than a missing folder; a non-null ``status`` column is final and passes
    through). ``files``: ``folder_path, kind``. ``extractions``: result of
    ``extraction_report``.
    """
    n = files.groupBy("folder_path").agg(
        F.count_if(F.col("kind") == "pdf").alias("n_pdfs"), F.count_if(F.col("kind") == "photo").alias("n_photos")
    )
    df = cars.join(n, "folder_path", "left").fillna(0, ["n_pdfs", "n_photos"]).join(merged(extractions), "car", "left")
    given = F.col("status") if "status" in cars.columns else F.lit(None).cast("string")
    no_sheet = F.concat(
        F.lit("Found this car's folder and "), F.col("n_photos").cast("string"),
        F.lit(" photo(s), but it has no spec sheet yet — the PDF has not been uploaded to "), F.col("folder_path"), F.lit("."),
    )
    status = (
        F.when(given.isNotNull(), given)
        .when(F.col("failed"), F.lit("needs_review"))
        .when(F.col("folder_path").isNull() | (F.col("n_pdfs") == 0), F.lit("needs_folder_link"))
        .otherwise("ok")
    )
    error = F.when(given.isNull() & (F.col("failed") | F.col("folder_path").isNull()), F.col("lookup_error")).when(
        given.isNull() & (F.col("n_pdfs") == 0), no_sheet
    )
    reached = F.col("status") == "ok"
    off = F.lit("extraction is switched off — folder location only")
    extraction_error = F.when(reached, off if not enabled else F.coalesce("extraction_error", F.when(F.col("json").isNull(), F.lit("no reply for any spec-sheet PDF"))))
    photos = F.lit(True) if photos_ok is None else photos_ok
    return (
        df.withColumn("status", status)
        .withColumn("error", error)
        .withColumn("extraction_error", extraction_error)
        .withColumn("json", F.when(reached & F.lit(enabled), F.col("json")))
        .withColumn("completed", ~(reached & F.lit(enabled) & F.col("json").isNull() & ~photos))
    )
