"""Applying reviewed changes to the listings table.

``run_at`` is one timestamp literal per run; each operator returns the new
snapshot with an ``applied`` flag, from which both outputs are projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(listings: DataFrame, wanted: DataFrame) -> DataFrame:
    return listings.join(wanted, "model_number", "left")


def apply_hidden(listings: DataFrame, model_numbers: DataFrame, run_at: Column) -> DataFrame:
    """Wanted listings that are not hidden yet become hidden."""
    wanted = model_numbers.select("model_number").distinct().withColumn("__w", F.lit(True))
    hit = F.col("__w").isNotNull() & ~F.col("status").eqNullSafe("hidden")
    return (
        _marked(listings, wanted)
        .withColumn("applied", hit)
        .withColumn("status", F.when(F.col("applied"), F.lit("hidden")).otherwise(F.col("status")))
        .withColumn("updated_at", F.when(F.col("applied"), run_at).otherwise(F.col("updated_at")))
        .drop("__w")
    )


def apply_price_updates(
    listings: DataFrame, items: DataFrame, run_at: Column, item_ord: str = "ord"
) -> DataFrame:
    """New price and active status; of several items for one number the last wins.
    Serves price updates and restocks alike."""
    last = items.groupBy("model_number").agg(
        F.max_by(F.struct(F.col("new_price_aed").cast("double").alias("p")), item_ord).alias("__i")
    )
    hit = F.col("__i").isNotNull()
    return (
        _marked(listings, last)
        .withColumn("applied", hit)
        .withColumn("price_aed", F.when(hit, F.col("__i.p")).otherwise(F.col("price_aed")))
        .withColumn("status", F.when(hit, F.lit("active")).otherwise(F.col("status")))
        .withColumn("updated_at", F.when(hit, run_at).otherwise(F.col("updated_at")))
        .drop("__i")
    )


def update_listings(
    listings: DataFrame, changes: DataFrame, run_at: Column, listing_ord: str, change_ord: str
) -> DataFrame:
    """Partial update: of listings sharing a number only the first changes; null
    change columns leave the value alone and later changes override earlier ones."""
    fields = [c for c in changes.columns if c not in ("model_number", change_ord)]
    merged = changes.groupBy("model_number").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(change_ord))).alias(f"__c_{c}")
            for c in fields
        ]
    )
    first = listings.groupBy("model_number").agg(F.min(listing_ord).alias("__first"))
    target = merged.join(first, "model_number")
    hit = F.col("__first").isNotNull() & (F.col("__first") == F.col(listing_ord))
    out = _marked(listings, target).withColumn("applied", hit)
    for c in fields:
        out = out.withColumn(c, F.when(hit, F.coalesce(F.col(f"__c_{c}"), F.col(c))).otherwise(F.col(c)))
    return out.withColumn("updated_at", F.when(hit, run_at).otherwise(F.col("updated_at"))).select(
        *listings.columns, "applied"
    )


def publish_new(
    listings: DataFrame, reviewed: DataFrame, run_at: Column, ord: str = "ord"
) -> tuple[DataFrame, DataFrame]:
    """``(added, conflicts)``: reviewed cars whose number is not listed become
    active listings, the payload overriding the defaults; repeated numbers in one
    batch conflict with the first of them."""
    first = reviewed.groupBy("model_number").agg(F.min(ord).alias("__first"))
    known = listings.select("model_number").distinct().withColumn("__known", F.lit(True))
    marked = reviewed.join(first, "model_number").join(known, "model_number", "left")
    fresh = F.col("__known").isNull() & (F.col(ord) == F.col("__first"))
    placeholder = lambda side: F.array(F.lit(f"placeholder:{side}"))
    defaults = {
        "status": F.lit("active"),
        "photos": F.struct(placeholder("exterior").alias("exterior"), placeholder("interior").alias("interior")),
        "created_at": run_at,
        "updated_at": run_at,
    }
    added = marked.filter(fresh).drop("__first", "__known")
    for name, value in defaults.items():
        added = added.withColumn(name, F.coalesce(F.col(name), value) if name in added.columns else value)
    return added, marked.filter(~fresh).drop("__first", "__known")
