"""Work that is done once a row, whatever the number of jobs that ask for its result."""

from pyspark.sql import functions as F

from lotledger import session
from lotledger.functions import text as tx
from lotledger.operators import attempts, colours, library
from lotledger.plans import derive, gate_queries, locate_queries
from lotledger.session import settle, small_tasks


def counting(spark, df):
    """``df``, and the number of its rows that were read so far."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(counted, df.schema), read


def test_replies_are_judged_once(spark):
    """F1 car_status: the stop joined back to the PDFs judged every reply a second time."""
    rows = [(f"c{i % 3}", "a.pdf", 0, "z", i, None if i % 5 == 0 else '{"brand": 1}' if i % 2 else '{"brand": 1, "mod', ("length", "stop")[i % 2]) for i in range(30)]
    rows += [(None, None, None, None, None, None, None), rows[1]]
    replies, read = counting(spark, spark.createDataFrame(rows, "car string, pdf string, pdf_ord int, search_key string, attempt int, content string, finish_reason string"))
    got = {r.car: r for r in attempts.extraction_report(attempts.judge_replies(replies)).collect()}
    assert read.value == len(rows) and set(got) == {"c0", "c1", "c2"} and sum(r.n_attempts for r in got.values()) == len(rows) - 1


def test_directories_are_made_of_the_listing_once(spark):
    """F1 car_status: directories were made of all entries again for every job."""
    rows = [(f"SUV/B-M-T-PV-2-AT/RED INSIDE BLACK/{i}.jpg", f"{i}.jpg", False, 1, 1) for i in range(20)] + [("SUV/x", "x", True, None, None)]
    entries, read = counting(spark, spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, mtime_ns long"))
    got = {r.path: r.folder_path for r in library.classify_directories(entries).collect()}
    assert read.value <= 2 * len(rows)  # files, and directories that the listing names
    library.crawl(entries)
    assert read.value <= 4 * len(rows)
    assert got == {"SUV": None, "SUV/x": None, "SUV/B-M-T-PV-2-AT": "SUV/B-M-T-PV-2-AT", "SUV/B-M-T-PV-2-AT/RED INSIDE BLACK": "SUV/B-M-T-PV-2-AT"}


def test_cars_and_replies_are_dealt_out_by_rows(spark, monkeypatch, tmp_path):
    """F1 car_status: all texts were parsed in the one task of a small file."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    sf = str(tmp_path)
    spark.range(2000).selectExpr(
        "id AS p_partkey", "'red x' AS p_name", "'Brand#1' AS p_brand", "'SUV' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.0D AS p_retailprice"
    ).coalesce(1).write.parquet(f"{sf}/part.parquet")
    spark.range(2000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.0D AS value", "'' AS props"
    ).coalesce(1).write.parquet(f"{sf}/events.parquet")
    assert locate_queries._targets(spark, sf).select(F.input_file_name()).distinct().count() == 200
    assert derive.table(spark, sf, "sheet_replies", deal=True).select(F.spark_partition_id()).distinct().count() == 200
    assert derive.table(spark, sf, "sheet_replies", deal=True).count() == 2000 and gate_queries._report(spark, sf).count() == 7


def test_texts_are_trimmed_and_split_as_before(spark):
    """Regular expressions gave way to trims and cuts with the same results."""
    odd = [None, "", " ", ".", "..", ".a", "a.", "a.B", "a.b\n", "x/.b", "a/b/", "/a", "/", "a//b", "\u3000a\u2028\x1c", "\u200ba", "-. a\t.\n-", " é.É "]
    s = F.col("s")
    pairs = {
        "strip": (tx.strip(s), F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")),
        "tidy": (tx.tidy(s), F.regexp_replace(tx.clean(s), r"^[ \-\t.]+|[ \-\t.]+$", "")),
        "suffix": (tx.file_suffix(s), F.lower(F.regexp_extract(s, r"(?s)^.+(\.[^.]*)$", 1))),
        "parent": (tx.path_parent(s), F.regexp_extract(s, r"(?s)^(.*)/[^/]*$", 1)),
    }
    for r in spark.createDataFrame([(o,) for o in odd], "s string").select("s", *[F.struct(*p).alias(k) for k, p in pairs.items()]).collect():
        assert all(r[k][0] == r[k][1] for k in pairs), r


def test_cars_are_read_once_for_both_colours(spark):
    """every job of the resolution parsed all cars again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "car long, given_exterior string, given_interior string, exterior_color string, interior_color string, folder_path string"
    rows = [(i, "White" if i % 2 else None, None, "Blak", ("Beige", None)[i % 2], f"lib/f{i % 3}/GREY INSIDE BLACK 26") for i in range(40)]
    rows += [(None, None, None, None, None, None), (3, "Red", None, None, "", "lib/f9/x")]
    cars = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    options = spark.createDataFrame([("lib/f0", "a", "x", "y"), ("lib/f0", "b", "x", "y")], "parent string, path string, exterior string, interior string")
    catalog = spark.createDataFrame(
        [("Color", "1", "White", "white", 1), ("Color", "2", "Black", "black", 2), ("Color", "3", "Grey", "grey", 3), ("Interior Color", "4", "Black", "black", 4), ("Interior Color", "5", "Beige", "beige", 5)],
        "parent string, id string, name string, slug string, ord long",
    )
    out = colours.vehicle_colours(cars, options, catalog, None).collect()
    assert len(out) == len(rows) and read.value == len(rows)
    by = {r.car: r for r in out if r.car is not None and r.car != 3}
    assert (by[1].ext_raw, by[1].ext_res.id, by[1].int_raw, by[1].int_res.method) == ("White", "1", "BLACK", "folder_normalized")
    assert by[9].int_res.method == "folder_ambiguous" and by[2].int_res.id == "5"


def test_narrow_rows_are_dealt_to_small_tasks(spark, monkeypatch):
    """a shuffle of few bytes a row was read by few tasks, however many rows it had."""
    monkeypatch.setattr(session, "TASK_ROWS", 20_000)
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 20)
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    ids = spark.range(1_000_000).groupBy(F.xxhash64("id").alias("k")).agg(F.max("id").alias("m"))
    with small_tasks(spark, 1_000_000):
        parts = settle(ids).select(F.input_file_name()).distinct().count()
    assert [spark.conf.get(n, None) for n in names] == before
    assert parts > 8  # the session's number of shuffle partitions
