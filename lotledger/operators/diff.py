"""Stock snapshot against live listings.

Every "first one wins" is an aggregate (``min_by``/``max_by`` over an explicit
order), so a code or alias holding a third of the rows is reduced on the map
side and never meets a window in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx

BUCKETS = ("new", "price_updated", "hidden", "unchanged", "restocked")


def collapse_stock(rows: DataFrame) -> DataFrame:
    """One row per model code: the first row, or the first priced one if the first
    has no price. ``first_ord`` keeps the code's first appearance."""
    payload = F.struct(*[c for c in rows.columns if c not in ("model_code", "ord")])
    return (
        rows.groupBy("model_code")
        .agg(
            F.min_by(payload, F.struct(F.col("price").isNull(), F.col("ord"))).alias("row"),
            F.min("ord").alias("first_ord"),
            F.count("*").alias("n_rows"),
        )
        .select("model_code", "first_ord", "n_rows", "row.*")
    )


def stock_aliases(rows: DataFrame) -> DataFrame:
    """Distinct ``(model_code, alias)`` from descriptions and stock ids."""
    alias = F.explode(
        F.array(tx.match_key(F.col("product_description")), tx.match_key(F.col("stock_id").cast("string")))
    )
    return rows.select("model_code", alias.alias("alias")).filter("alias != ''").distinct()


def lookup_keys(rows: DataFrame) -> DataFrame:
    """``key -> model_code``. A code's own key beats an alias; of several codes
    sharing a key the one that appeared last in the file wins."""
    first = rows.groupBy("model_code").agg(F.min("ord").alias("code_ord"))
    own = first.select(
        tx.match_key(F.col("model_code")).alias("key"), "model_code", F.lit(1).alias("own"), "code_ord"
    )
    alias = stock_aliases(rows).join(first, "model_code").select(
        F.col("alias").alias("key"), "model_code", F.lit(0).alias("own"), "code_ord"
    )
    return (
        own.unionByName(alias)
        .groupBy("key")
        .agg(F.max_by("model_code", F.struct("own", "code_ord")).alias("model_code"))
    )


def stock_diff(rows: DataFrame, listings: DataFrame, listing_ord: str = "ord") -> DataFrame:
    """Five buckets in one long table.

    ``listings`` needs ``model_number, status, price_aed`` and an order column.
    """
    keys = lookup_keys(rows)
    keyed = listings.withColumn("key", tx.match_key(F.col("model_number")))
    listed = F.struct("model_number", "status", "price_aed")
    # First listing per key, then per code: both steps combine before shuffling.
    matched = (
        keyed.groupBy("key")
        .agg(F.min_by(listed, listing_ord).alias("l"), F.min(listing_ord).alias("lo"))
        .join(keys, "key")
        .groupBy("model_code")
        .agg(F.min_by("l", "lo").alias("l"))
    )
    joined = collapse_stock(rows).join(matched, "model_code", "left")
    hit = F.col("l").isNotNull()
    bucket = (
        F.when(~hit, F.lit("new"))
        .when(F.col("price").isNull(), F.lit("unchanged"))
        .when(F.coalesce(F.col("l.status") == "hidden", F.lit(False)), F.lit("restocked"))
        .when(~F.col("l.price_aed").eqNullSafe(F.col("price")), F.lit("price_updated"))
        .otherwise("unchanged")
    )
    is_new = F.col("bucket") == "new"
    moved = F.col("bucket").isin("restocked", "price_updated")
    text_or_null = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    description = F.coalesce(F.col("product_description").cast("string"), F.lit(""))
    stocked = joined.withColumn("bucket", bucket).select(
        "bucket",
        F.when(is_new, F.col("model_code")).otherwise(F.col("l.model_number")).alias("model_number"),
        F.when(is_new | moved, description).alias("product_description"),
        F.when(
            is_new,
            F.coalesce(
                F.nullif(tx.brand_guess(F.col("product_description")), F.lit("")),
                tx.brand_guess(F.col("model_code")),
            ),
        ).alias("brand"),
        F.when(is_new, F.lit("")).alias("model"),
        F.when(is_new, F.lit("")).alias("trim"),
        F.when(is_new, tx.year_guess(F.col("model_code"))).alias("year"),
        F.when(is_new, F.col("price")).when(~moved, F.col("l.price_aed")).alias("price_aed"),
        F.when(is_new, text_or_null("available")).alias("available"),
        F.when(is_new, text_or_null("exterior_color")).alias("exterior_color"),
        F.when(is_new, text_or_null("interior_color")).alias("interior_color"),
        F.when(moved, F.col("l.price_aed")).alias("old_price_aed"),
        F.when(moved, F.col("price")).alias("new_price_aed"),
    )
    gone = keyed.filter("status = 'active'").join(keys, "key", "left_anti")
    return stocked.unionByName(
        gone.select(
            F.lit("hidden").alias("bucket"), "model_number", F.lit("").alias("product_description"), "price_aed"
        ),
        allowMissingColumns=True,
    )
