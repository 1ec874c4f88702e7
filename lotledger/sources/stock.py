"""Reading stock snapshots: header clean-up, aliases, required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.functions import text as tx

REQUIRED_COLUMNS = ("model_code", "aed_price")

# Export headers accepted under another name.
COLUMN_ALIASES = {
    "list_price": "aed_price",
    "description": "product_description",
    "int_color": "interior_color",
    "color": "exterior_color",
    "vehicle_card:_vehicle_card_name": "stock_id",
}

OPTIONAL_COLUMNS = (
    "product_description", "stock_id", "exterior_color", "interior_color", "available",
)


def canonical_headers(df: DataFrame) -> DataFrame:
    """Headers stripped, lower-cased, blanks as underscores, then aliases applied
    where the target name is not taken; required columns checked by name."""
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    names = set(df.columns)
    df = df.withColumnsRenamed(
        {old: new for old, new in COLUMN_ALIASES.items() if old in names and new not in names}
    )
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"stock file lacks column(s) {missing}; it has {list(df.columns)}")
    return df


def stock_rows(df: DataFrame, ord: str) -> DataFrame:
    """Usable rows: code stripped, blank and ``nan`` codes dropped, absent optional
    columns added as null. ``ord`` names the file-order column."""
    df = canonical_headers(df)
    absent = [c for c in OPTIONAL_COLUMNS if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df
    code = tx.strip(F.col("model_code").cast("string"))
    return (
        df.withColumn("model_code", code)
        .filter((code != "") & (F.lower(code) != "nan"))
        .withColumn("price", tx.price(F.col("aed_price")))
        .withColumnRenamed(ord, "ord")
    )


def read_stock(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A converted export as text columns; rows carry their file position as ``ord``."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    df = reader.format(fmt).load(path)
    position = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    return df.select("*", position.alias("ord"))


def largest_html_table(pages: DataFrame, file_col: str = "file", html_col: str = "html") -> DataFrame:
    """Rows of the longest table of each HTML export, ``(file, row_no, cells)``.

    Tables and rows are cut with regular expressions; ties go to the first table.
    """
    cut = lambda c, tag: F.regexp_extract_all(
        c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)
    )
    cells = lambda row: F.transform(
        F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)),
        lambda cell: tx.clean(F.regexp_replace(cell, r"(?s)<[^>]*>", " ")),
    )
    tables = F.transform(cut(F.col(html_col), "table"), lambda t: cut(t, "tr"))
    # Longest table; the first of equals keeps the lead.
    longest = F.aggregate(
        tables,
        F.array().cast("array<string>"),
        lambda best, t: F.when(F.size(t) > F.size(best), t).otherwise(best),
    )
    return pages.select(file_col, F.posexplode(longest).alias("row_no", "row")).select(
        file_col, "row_no", cells(F.col("row")).alias("cells")
    )
