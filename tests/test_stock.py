"""Snapshot reading, diff buckets and their properties."""

import json

import pytest
from pyspark.sql import functions as F

from lotledger.operators import changes, diff, pending
from lotledger.sources import listings as listing_source
from lotledger.sources import pending_store, stock

STOCK = "ord long, model_code string, aed_price string, product_description string, stock_id string"
LIST = "ord long, model_number string, status string, price_aed double"


def _rows(spark, data):
    return stock.stock_rows(spark.createDataFrame(data, STOCK), "ord")


def _buckets(df):
    return {(r.bucket, r.model_number) for r in df.collect()}


def test_headers(spark):
    df = spark.createDataFrame([("a", "1", "x")], "`Model Code` string, `List Price` string, Color string")
    assert stock.canonical_headers(df).columns == ["model_code", "aed_price", "exterior_color"]
    taken = spark.createDataFrame([("a", "1", "2")], "model_code string, aed_price string, list_price string")
    assert stock.canonical_headers(taken).columns == ["model_code", "aed_price", "list_price"]
    with pytest.raises(ValueError, match="aed_price"):
        stock.canonical_headers(spark.createDataFrame([("a",)], "model_code string"))


def test_diff(spark):
    rows = _rows(spark, [
        (0, "A-1-26", None, "TOYOTA-X", "S1"), (1, "A-1-26", "100", "TOYOTA-Y", "S2"), (2, "A-1-26", "200", None, None),
        (3, "B", "50", "KIA-Z", "S3"), (4, "C", "70", None, "S4"), (5, "D", None, None, "S5"), (6, "E", "5", None, "S6"),
        (7, "nan", "5", None, None), (8, "e", "6", None, None), (9, "N-26", "1,000", "ROX 01-6", "S9"),
    ])
    live = spark.createDataFrame([
        (0, "toyota-y", "active", 90.0), (1, "A-1-26", "hidden", 1.0), (2, "s3", "hidden", 50.0), (3, "c", "active", 70.0),
        (4, "D", "hidden", 8.0), (5, "gone", "active", 3.0), (6, "gone2", "hidden", 3.0), (7, "E", "active", None),
    ], LIST)
    out = diff.stock_diff(rows, live)
    got = _buckets(out)
    assert ("price_updated", "toyota-y") in got      # first listing of a code, first priced row
    assert ("restocked", "s3") in got and ("unchanged", "c") in got
    assert ("unchanged", "D") in got                 # no incoming price: unchanged even if hidden
    assert ("hidden", "gone") in got and not any(m == "gone2" for _, m in got)
    # Codes differing in case only: the later one takes the key, the earlier is new.
    assert ("new", "E") in got and ("price_updated", "E") in got
    new = {r.model_number: r for r in out.filter("bucket = 'new'").collect()}
    assert new["N-26"].brand == "Rox 01" and new["N-26"].year == 2026 and new["N-26"].price_aed == 1000.0


def test_applying_a_diff_settles_it(spark):
    rows = _rows(spark, [(i, f"M{i}", str(10 * i), None, f"S{i}") for i in range(1, 30)])
    live = spark.createDataFrame(
        [(i, f"m{i}", "hidden" if i % 3 == 0 else "active", float(i)) for i in range(10, 40)], LIST
    ).withColumn("updated_at", F.lit(0))
    report = diff.stock_diff(rows, live)
    assert report.count() == report.select("model_number").distinct().count()
    priced = report.filter("bucket IN ('price_updated', 'restocked')").select("model_number", "new_price_aed", F.lit(0).alias("ord"))
    after = changes.apply_price_updates(live, priced, F.lit(1)).drop("applied")
    after = changes.apply_hidden(after, report.filter("bucket = 'hidden'"), F.lit(1))
    assert {r.bucket for r in diff.stock_diff(rows, after).filter("bucket != 'new'").collect()} == {"unchanged"}


def test_publish_and_pending(spark, tmp_path):
    live = spark.createDataFrame([(0, "A", "active", 1.0)], LIST)
    reviewed = spark.createDataFrame([(1, "A", None, 5.0), (2, "B", None, 6.0), (3, "B", "hidden", 7.0)], LIST)
    added, conflicts = changes.publish_new(live, reviewed, F.lit(1))
    assert [(r.model_number, r.status, r.photos.exterior) for r in added.collect()] == [("B", "active", ["placeholder:exterior"])]
    assert sorted((r.model_number, r.price_aed) for r in conflicts.collect()) == [("A", 5.0), ("B", 7.0)]

    report = spark.createDataFrame(
        [(1, "new", "A", "x y"), (2, "new", "C", "D d"), (3, "hidden", "d  D", None), (4, "hidden", "Z", None), (5, "restocked", "Q", None)],
        "row_id int, bucket string, model_number string, product_description string",
    )
    kept = pending.reconcile(report, spark.createDataFrame([("a",)], "model_number string"))
    assert sorted(r.row_id for r in kept.collect()) == [2, 4, 5]
    path = str(tmp_path / "reports")
    for rid, at in (("r1", "2026-01-01"), ("r2", "2026-01-02")):
        pending_store.save_report(report, path, rid, "f.xlsx", F.lit(at))
    assert pending_store.load_report(spark, path).select("report_id").distinct().collect()[0][0] == "r2"
    pending_store.clear_report(spark, path, "r2")
    assert pending_store.load_report(spark, path).select("report_id").distinct().collect()[0][0] == "r1"


def test_listings_quarantine(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text('{"model_number": "A", "price_aed": 1.5}\n{"model_number": "B", \n{"model_number": "C"}\n')
    good, bad = listing_source.read_listings(spark, str(path))
    assert [r.model_number for r in good.orderBy("model_number").collect()] == ["A", "C"]
    assert bad.count() == 1


def test_listings_array_keeps_all_keys(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text('[\n  {"model_number": "A", "price_aed": 1.5,\n   "body": "SUV", "fields": {"seats": 5}, "extra": {"x": "y"}},\n  {"model_number": "B"},\n  7\n]\n')
    good, bad = listing_source.read_listings(spark, str(path))
    rows = {r.model_number: r for r in good.collect()}
    assert rows["A"].price_aed == 1.5 and rows["A"].extra == {"body": "SUV", "fields": '{"seats":5}', "x": "y"}
    assert rows["B"].extra is None and [r.record for r in bad.collect()] == ["7"]
    (tmp_path / "m.json").write_text('[{"model_number": "A"}, {"model')
    good, bad = listing_source.read_listings(spark, str(tmp_path / "m.json"))
    assert [r.model_number for r in good.collect()] == ["A"] and [r.record for r in bad.collect()] == ['{"model']


def test_broken_record_in_an_array_costs_itself_only(spark, tmp_path):
    records = ['{"model_number": "A"}', '{"model_number": "B", "price_aed": tru}', '{"model_number": "C", "photos": {"exterior": ["}", "{\\"}"]}}', "null", '"x, }"', '{"model_number": "D\\\\"}', '{"model_number": "E", }']
    for i, text in enumerate(("[" + ",".join(records) + "]", "[\n  " + ",\n  ".join(records) + "\n]\n", "[" + ", ".join(records))):
        (tmp_path / f"{i}.json").write_text(text)
        good, bad = listing_source.read_listings(spark, str(tmp_path / f"{i}.json"))
        assert sorted(r.model_number for r in good.collect()) == ["A", "C", "D\\"], text
        assert sorted(r.record.rstrip("}, ") for r in bad.collect()) == sorted(x.rstrip("}, ") for x in (records[1], "null", '"x, }"', records[6])), text
    good, bad = listing_source.read_listings(spark, str(tmp_path))
    assert good.count() == 9 and bad.count() == 12


def test_repeated_keys_are_quarantined_or_the_outer_one_wins(spark, tmp_path):
    rows = ['{"model_number": "A", "x": 1, "x": 2}', '{"model_number": "B", "extra": {"y": 1, "y": 2}}', '{"model_number": "C", "x": "own", "extra": {"x": "inner", "z": "z"}}', '{"model_number": "D", "model_number": "E"}']
    (tmp_path / "l.json").write_text("\n".join(rows))
    good, bad = listing_source.read_listings(spark, str(tmp_path / "l.json"))
    assert [(r.model_number, r.extra) for r in good.collect()] == [("C", {"x": "own", "z": "z"})]
    assert sorted(r.record for r in bad.collect()) == sorted([rows[0], rows[1], rows[3]])


def test_array_of_many_splits(spark, tmp_path):
    """A file over many splits: strings and records that begin in one and end in another."""
    records = [{"model_number": f"M{i}", "product_description": "a } \" { ] " * (i % 7), "status": "active"} for i in range(3000)]
    (tmp_path / "l.json").write_text(json.dumps(records, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, bad = listing_source.read_listings(spark, str(tmp_path / "l.json"))
        assert {(r.model_number, r.product_description) for r in good.collect()} == {(r["model_number"], r["product_description"]) for r in records}
        assert bad.count() == 0 and listing_source._pieces(spark, str(tmp_path / "l.json"), "}").select("block").distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_html_export(spark, tmp_path):
    html = "<table><tr><td>x</td></tr></table><TABLE><tr><th>Model Code</th><th>P</th></tr><tr><td>A&nbsp;</td><td><b>1</b></td></tr></TABLE>"
    rows = stock.largest_html_table(spark.createDataFrame([("f", html)], "file string, html string")).orderBy("row_no").collect()
    assert [r.cells for r in rows][0] == ["Model Code", "P"] and rows[1].cells[1] == "1"


def test_read_stock_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Model Code,List Price\nA,5\nB,\n")
    rows = stock.stock_rows(stock.read_stock(spark, str(tmp_path)), "ord")
    assert sorted((r.model_code, r.price) for r in rows.collect()) == [("A", 5.0), ("B", None)]
