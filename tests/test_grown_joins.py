"""Joins whose sides grow with the input: nothing of them is gathered in the driver or under one key."""

import pytest
from pyspark.sql import functions as F

from lotledger.functions import carkey
from lotledger.operators import answers, library, specs
from lotledger.operators import locate as loc
from lotledger.plans.derive import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def written(monkeypatch):
    """Plans of everything that crawl and locate write on their way."""
    seen = []
    for module in (library, loc):
        monkeypatch.setattr(module, "settle", lambda df, own=module.settle: (seen.append(plan(df)), own(df))[1])
    return seen


FILES = [
    "SUV/KIA-RIO-STD-PV-2.0-AT/WHITE INSIDE BLACK/1.jpg", "SUV/KIA-RIO-STD-PV-2.0-AT/WHITE INSIDE BLACK/KIA RIO STD.pdf",
    "SUV/KIA-RIO-STD-PV-2.0-AT/GREY INSIDE BLACK/RAW/2.jpg", "SUV/KIA-RIO-LUX-PV-2.0-AT/GREY INSIDE BLACK/3.jpg", "docs/a/list.xlsx", "top.jpg",
]


def _entries(spark):
    rows = [(p, p.rsplit("/", 1)[-1], False, 1, 1) for p in FILES]
    return spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, mtime_ns long")


def test_library_and_locate_broadcast_no_table_that_grows(spark, written):
    entries = library.settle(_entries(spark))
    lib = library.crawl(entries)
    cars = spark.createDataFrame([(1, "KIA-RIO-STD-PV-2.0-AT-WHITE-BLACK-26"), (2, "KIA-RIO-LUX-PV-2.0-AT-RED-BLACK-26")], "id int, text string")
    found = loc.locate(carkey.parse_car_strings(cars, "text"), lib)
    files = library.car_files(entries, lib.folders.select(F.col("path").alias("folder_path")))
    named = {"folders": lib.folders, "variants": lib.variants, "sheets": lib.sheets, "drift": lib.drift, "targets": found.targets,
             "candidates": loc.candidates(found), "files": files, "buckets": loc.retrieval_counts(found.answers.withColumns({"brand_key": F.lit("kia"), "raw_fp": F.lit("")}), loc.bucket_tables(lib))}
    plans = {**dict(enumerate(written)), **{name: plan(df) for name, df in named.items()}}
    assert len(written) > 8
    assert [name for name, text in plans.items() if "BroadcastHashJoin" in text] == []
    assert {(r.id, r.outcome) for r in found.targets.collect()} == {(1, "matched"), (2, "absent")}
    assert sorted(r.relative_path for r in files.collect()) == ["GREY INSIDE BLACK/3.jpg", "GREY INSIDE BLACK/RAW/2.jpg", "WHITE INSIDE BLACK/1.jpg", "WHITE INSIDE BLACK/KIA RIO STD.pdf"]


def test_topmost_deals_finished_nodes_by_their_own_path(spark):
    nodes = [(None, "a", None), ("a", "a/b", "a/b"), ("a/b", "a/b/c", "a/b/c"), ("a/b/c", "a/b/c/d", None), (None, "z", None)]
    tree = spark.createDataFrame(nodes, "up string, path string, top string")
    got = library.topmost(tree)
    assert {(r.path, r.top) for r in got.collect()} == {("a", None), ("a/b", "a/b"), ("a/b/c", "a/b"), ("a/b/c/d", "a/b"), ("z", None)}
    assert "coalesce(up" in plan(got)


def test_answers_are_not_dealt_out_by_field(spark):
    given = spark.createDataFrame(
        [(1, "A", "color", " white "), (1, "B", "color", "White"), (2, "A", "color", "Mauve"), (2, "A", "power", "9"), (3, "A", "bogus", "x")],
        "car long, provider string, field string, value string",
    )
    fields = spark.createDataFrame([("color", "select", ["White", "Black"]), ("power", "text", [])], "field string, type string, options array<string>")
    got = answers.clean_field_answers(given, fields)
    assert "SortMergeJoin" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "A", "color", "White"), (1, "B", "color", "White"), (2, "A", "power", "9")]


def test_specifications_pass_each_car_once(spark):
    rows = spark.createDataFrame(
        [(1, 1, "Color", "Mauve"), (1, 2, " Color ", "red"), (1, 2, "Color", "Teal"), (1, 3, "Color", "Plum"), (2, 1, "Color", "Mauve"), (2, 2, "Kerb weight", "1"),
         (None, 1, "Color", "Mauve"), (3, 1, "Color", None), (3, 2, " ", "Red")],
        "car long, ord long, label string, value string",
    )
    catalog = spark.createDataFrame([("Color", "1", "Red", "red", 1), ("Color", "2", "White", "white", 2)], "parent string, id string, name string, slug string, ord int")
    parents = spark.createDataFrame([("Color", 0, 1)], "name string, mandatory int, ord int")
    more = spark.createDataFrame(
        [(1, 1, 0, "Color", "white body & black roof"), (3, 1, 0, "Color", "White body & black roof"), (2, 2, 0, "Color", "Sand"), (2, 1, 1, "Color", "")],
        "car long, stage int, ord long, parent string, value string",
    )
    got = specs.resolve_specifications(rows, catalog, parents, more)
    assert plan(got).count("hashpartitioning(car") == 1
    # The failure that shares the winner's place isn't before it.
    assert {(r.kind, r.car, r.ord, r.id, r.matched_from or r.value) for r in got.collect()} == {
        ("unresolved", 1, 1, None, "Mauve"), ("resolved", 1, None, "1", "Color: red"), ("unresolved", 2, 1, None, "Mauve"),
        ("unmapped", 2, 2, None, "1"), ("resolved", 3, None, "2", "model code: White"),
    }


def test_library_listing_broadcasts_no_parts(spark, tmp_path):
    parts = [(1, "green box", "Brand#11", "SMALL", 4), (2, "blue cup", "Brand#12", "LARGE", 9)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, 1 + k % 2, k % 5, k % 7) for k in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    listed = table(spark, str(tmp_path), "library_entries")
    assert "BroadcastHashJoin" not in plan(listed)
    assert {r.path.split("/")[0].split(" ")[0].upper() for r in listed.collect()} == {"SMALL", "LARGE"}
