"""Reading listings with unreadable records quarantined instead of fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotledger.operators.scans import running_sums

_STRINGS = T.ArrayType(T.StringType())
LISTING_SCHEMA = T.StructType(
    [
        T.StructField("model_number", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("price_aed", T.DoubleType()),
        T.StructField("product_description", T.StringType()),
        T.StructField(
            "photos", T.StructType([T.StructField("exterior", _STRINGS), T.StructField("interior", _STRINGS)])
        ),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
_CORRUPT = "_corrupt"


def _repeats_a_key(text: Column) -> Column:
    """Does the object, or its ``extra``, hold a key twice?"""
    twice = lambda keys: F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
    return twice(F.json_object_keys(text)) | twice(F.json_object_keys(F.get_json_object(text, "$.extra")))


def parse_listings(records: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """``(listings, quarantine)`` from one JSON object a row. Keys that are not fields of a
    listing are kept in ``extra`` (their JSON text, strings without quotes); a key that stands
    beside ``extra`` and in it has the value beside it. A record that holds a key twice is
    quarantined."""
    schema = T.StructType(LISTING_SCHEMA.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    text = F.when(~_repeats_a_key(F.col(record)), F.col(record))
    parsed = records.select(
        F.col(record).alias("record"), F.from_json(text, schema, options).alias("j"), F.from_json(text, "map<string,string>").alias("keys")
    )
    broken = F.col("j").isNull() | F.col(f"j.{_CORRUPT}").isNotNull() | ~F.trim("record").startswith("{")
    foreign = F.map_filter("keys", lambda k, v: ~k.isin(*LISTING_SCHEMA.names))
    inner = F.map_filter("j.extra", lambda k, v: ~F.map_contains_key(foreign, k))
    extra = F.map_concat(foreign, F.coalesce(inner, F.create_map().cast("map<string,string>")))
    good = parsed.filter(~broken).select(
        *(F.when(F.size(F.map_keys(extra)) > 0, extra).alias(n) if n == "extra" else F.col(f"j.{n}") for n in LISTING_SCHEMA.names)
    )
    return good, parsed.filter(broken).select("record")


def _pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value"
    )


#: Elements of an array that are no objects.
_SCALAR = r'"(?:\\.|[^"\\])*"|[^\[\]{}",\s][^\[\]{}",]*'


def array_records(pieces: DataFrame) -> DataFrame:
    """The elements of JSON arrays as rows (``record``), from texts cut behind every closing brace:
    ``file, block, n, value`` in order of block and n within a file.

    An array is never held as a whole. Quotes before a piece tell whether it begins within a
    string; brackets outside strings, the depth behind it. An object ends where a closing brace
    comes back to depth one, so a record that is no valid JSON costs itself only. Pieces behind the
    last such place (a cut-off file, or braces that don't balance) are a record each.
    """
    free = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(free) - F.length(F.replace(free, F.lit('"'), F.lit("")))
    # The last piece of a file has no closing brace behind it.
    last = pieces.groupBy("file").agg(F.max(F.struct("block", "n")).alias("__end"))
    p = pieces.withColumn("free", free).join(last, "file").withColumn("ends", F.struct("block", "n") != F.col("__end")).drop("__end")
    p = running_sums(p, "file", "block", "n", {"quoted": quotes})
    before = F.when((F.col("quoted") - quotes) % 2 == 1, F.lit('"')).otherwise("")
    bare = F.regexp_replace(F.concat(before, "free"), '(?s)"[^"]*("|$)', "")
    depth = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
    closes = F.col("ends") & (F.col("quoted") % 2 == 0)
    p = p.withColumn("closes", closes).withColumn("change", depth - F.col("closes").cast("int")).drop("free")
    p = running_sums(p, "file", "block", "n", {"depth": F.col("change")})
    done = (F.col("closes") & (F.col("depth") == 1)).cast("int")
    p = running_sums(p.withColumn("done", done), "file", "block", "n", {"upto": F.col("done")})
    n_done = p.groupBy("file").agg(F.max("upto").alias("n_done"))
    p = p.withColumn("no", F.col("upto") - F.col("done")).join(n_done, "file")
    whole = (
        p.filter("no < n_done").groupBy("file", "no")
        .agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"]), "}"), F.lit("}")).alias("text"))
    )
    rest = p.filter("no = n_done").select(F.concat("value", F.when(F.col("ends"), F.lit("}")).otherwise("")).alias("text"))
    text = F.regexp_replace("text", r"^[\s,\[]+", "")
    lead = F.regexp_extract(text, rf"^(?:(?:{_SCALAR})\s*,\s*)+(?=\{{)", 0)
    split = whole.select(text.alias("text"), lead.alias("lead"))
    objects = split.select(F.expr("substring(text, length(lead) + 1)").alias("record"))
    scalars = split.filter("lead != ''").select(F.explode(F.regexp_extract_all("lead", F.lit(_SCALAR), F.lit(0))).alias("record"))
    tail = rest.select(F.regexp_replace(text, r"[\s,\]]+$", "").alias("text")).filter("text != ''")
    flat = ~F.col("text").rlike(r"[{}]")
    tail = tail.filter(~flat).select(F.col("text").alias("record")).unionByName(
        tail.filter(flat).select(F.explode(F.regexp_extract_all("text", F.lit(_SCALAR), F.lit(0))).alias("record"))
    )
    return objects.unionByName(scalars).unionByName(tail).select(F.trim("record").alias("record"))


def read_listings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(listings, quarantine)`` of files that hold one JSON array each, indented or not, or one
    JSON object a line. Files of both kinds are read in splits; what can't be read is quarantined
    record by record."""
    first = _pieces(spark, path, "}").filter(F.trim(F.translate("value", "\n\r\t", "   ")) != "").groupBy("file").agg(
        F.min_by(F.regexp_extract("value", r"^\s*(.)", 1), F.struct("block", "n")).alias("sign")
    )
    # One row a file: as long as the list of files that the reader holds anyway.
    kinds = {r["file"]: r["sign"] == "[" for r in first.collect()}
    arrays, lines = ([f for f, kind in kinds.items() if kind is want] for want in (True, False))
    records = [array_records(_pieces(spark, arrays, "}"))] if arrays else []
    if lines:
        records.append(spark.read.text(lines).select(F.col("value").alias("record")).filter(F.trim("record") != ""))
    out = spark.createDataFrame([], "record string")
    for r in records:
        out = out.unionByName(r)
    return parse_listings(out)
