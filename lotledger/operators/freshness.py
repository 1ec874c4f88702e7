"""Order-independent fingerprint of a listing and the freshness verdict built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx


def entry_line(path: Column, is_dir: Column, size: Column, mtime_ns: Column) -> Column:
    """One text line per entry; size and time count for files only."""
    file_only = lambda c: F.when(is_dir, F.lit("")).otherwise(c.cast("string"))
    kind = F.when(is_dir, F.lit("d")).otherwise(F.lit("f"))
    return F.concat_ws("\u001f", path, kind, file_only(size), file_only(mtime_ns))


def tree_fingerprint(entries: DataFrame, line_hash: Column | None = None) -> DataFrame:
    """Count, sum and xor of line hashes in one row: fully combinable, no sort, no
    gathering. Only equality of fingerprints carries meaning."""
    line = entry_line(F.col("path"), F.col("is_dir"), F.col("size"), F.col("mtime_ns"))
    h = F.xxhash64(line) if line_hash is None else line_hash
    return entries.agg(
        F.count("*").alias("n_entries"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"),
    ).withColumn(
        "fingerprint",
        F.md5(F.concat_ws(":", F.col("n_entries").cast("string"), F.col("hash_sum").cast("string"), F.col("hash_xor").cast("string"))),
    )


def check(meta: DataFrame, observed_root: Column, current: DataFrame) -> DataFrame:
    """Freshness of an index against the current listing.

    ``meta``: one row ``root, n_folders, fingerprint, crawled_at``; ``current``:
    one row of ``tree_fingerprint``. Roots compare with a trailing slash, so
    ``/lib2`` is not inside ``/lib``.
    """
    now = current.select("fingerprint").scalar()
    inside = F.startswith(
        F.concat(tx.root_key(F.col("root")), F.lit("/")), F.concat(tx.root_key(observed_root), F.lit("/"))
    )
    mismatch, empty, changed = ~inside, F.col("n_folders") == 0, F.col("fingerprint") != F.col("now")
    reason = (
        F.when(
            mismatch,
            F.concat(
                F.lit("this index was built from "), tx.quoted(F.col("root")), F.lit(", but the store is rooted at "),
                tx.quoted(observed_root), F.lit(" — they are not the same library"),
            ),
        )
        .when(empty, F.lit("the index holds no model folders at all"))
        .when(
            changed,
            F.concat(
                F.lit("the tree has changed since "), F.col("crawled_at").cast("string"), F.lit(" (fingerprint "),
                F.substring("fingerprint", 1, 12), F.lit(" -> "), F.substring("now", 1, 12), F.lit(")"),
            ),
        )
        .otherwise(F.concat(F.lit("unchanged since "), F.col("crawled_at").cast("string")))
    )
    remedy = (
        F.when(
            mismatch,
            F.lit("point the configuration back at the library the index describes, or recrawl against this one; "
                  "do NOT answer lookups from this index"),
        )
        .when(empty, F.lit("recrawl; an empty index is never a valid description of this library"))
        .when(changed, F.lit("recrawl the library"))
        .otherwise("")
    )
    stale = mismatch | empty | changed
    return meta.withColumn("now", now).select(
        F.when(stale, F.lit("stale")).otherwise("fresh").alias("state"),
        reason.alias("reason"), remedy.alias("remedy"),
        F.col("root").alias("expected_root"), observed_root.alias("observed_root"), mismatch.alias("root_mismatch"),
    )
