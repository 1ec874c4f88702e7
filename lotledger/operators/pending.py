"""Review of a pending report: reconciling, removing, looking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx


def _entry_keys(entries: DataFrame, row_id: str) -> DataFrame:
    """Distinct keys of pending entries, by model number and description."""
    keys = F.array(tx.match_key(F.col("model_number")), tx.match_key(F.col("product_description")))
    return entries.select(row_id, F.explode(keys).alias("key")).filter("key != ''")


def reconcile(report: DataFrame, listings: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Drop ``new`` rows already listed and ``hidden`` rows that are back in ``new``.

    The in-stock keys come from the unreduced ``new`` bucket.
    """
    listed = listings.select(tx.match_key(F.col("model_number")).alias("key")).filter("key != ''").distinct()
    new_keys = _entry_keys(report.filter("bucket = 'new'"), row_id)
    settled = new_keys.join(listed, "key", "left_semi").select(row_id).distinct()
    in_stock = new_keys.select("key").distinct()
    new = report.filter("bucket = 'new'").join(settled, row_id, "left_anti")
    hidden = (
        report.filter("bucket = 'hidden'")
        .withColumn("key", tx.match_key(F.col("model_number")))
        .join(in_stock, "key", "left_anti")
        .drop("key")
    )
    return new.unionByName(hidden).unionByName(report.filter("bucket NOT IN ('new', 'hidden')"))


def remove_applied(report: DataFrame, bucket: str, model_numbers: DataFrame) -> DataFrame:
    """Rows of one bucket whose model number was applied are gone."""
    done = model_numbers.select("model_number").distinct().withColumn("bucket", F.lit(bucket))
    return report.join(done, ["bucket", "model_number"], "left_anti")


def remove_published(report: DataFrame, identifiers: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``new`` rows whose code or description was just published are gone."""
    keys = identifiers.select(tx.match_key(F.col("identifier")).alias("key")).distinct()
    gone = (
        _entry_keys(report.filter("bucket = 'new'"), row_id)
        .join(keys, "key", "left_semi")
        .select(row_id)
        .distinct()
    )
    return report.join(gone, row_id, "left_anti")


def pending_entries(report: DataFrame, wanted: DataFrame, ord: str = "row_id") -> DataFrame:
    """First ``new`` entry of each wanted model number."""
    first = (
        report.filter("bucket = 'new'")
        .groupBy("model_number")
        .agg(F.min_by(F.struct(*[c for c in report.columns if c != "model_number"]), ord).alias("entry"))
    )
    return wanted.join(first, "model_number", "left")


def prefer_caller(staged: Column, caller: Column, name: str) -> Column:
    """A caller's text wins when it is not empty; a caller's price wins when given."""
    given = caller[name] if name == "price_aed" else F.nullif(caller[name], F.lit(""))
    return F.coalesce(given, staged[name])


def listing_entries(staged: DataFrame, caller: DataFrame) -> DataFrame:
    """Staged entry fields overridden by caller values, per model number."""
    fields = ("product_description", "price_aed", "exterior_color", "interior_color")
    s = staged.select("model_number", F.struct(*fields).alias("s"))
    c = caller.select("model_number", F.struct(*fields).alias("c"))
    return s.join(c, "model_number", "full").select(
        "model_number", *[prefer_caller(F.col("s"), F.col("c"), f).alias(f) for f in fields]
    )
