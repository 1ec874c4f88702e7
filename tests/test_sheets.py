"""Uploaded sheets, payloads with ids, and the search that the reply oracle stands on."""

import itertools
import json
import random

import duckdb

from lotledger.functions import replies
from lotledger.operators import attempts, sheets
from lotledger.plans import reply_sql
from lotledger.sources import catalogs

GOOD = json.dumps({"brand": "b", "model": "m", "trim": None, "year": 2025, "raw_specifications": [{"label": "k"}], "description": "", "raw_features": ["ABS", "x"]})
UPLOADS = "upload int, model_number string, product_description string, price_aed double"
REPORT = "row_id int, bucket string, model_number string, product_description string, price_aed double"
REPLIES = "upload int, attempt int, content string, finish_reason string"
CATALOG = "parent string, id string, name string, slug string, ord int"


def run(spark, uploads, report, given):
    judged = attempts.judge_replies(spark.createDataFrame(given, REPLIES))
    catalog = spark.createDataFrame([("Color", "1", "White", "white", 1), ("Interior Color", "2", "Black", "black", 2)], CATALOG)
    out = sheets.uploaded_sheets(spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(report, REPORT), judged, catalog, None)
    return {r.upload: r for r in out.collect()}


def test_uploaded_sheets(spark):
    code = "KIA-RIO-LX-PV-2.0-AT-WHITE-BLACK-25"
    uploads = [(1, "A", code, None), (2, "A", "", 9.0), (3, "Z", None, None), (4, code, " ", None), (5, None, None, None), (1, "A", code, None)]
    report = [(7, "new", "A", "staged", 5.0), (8, "new", "A", "later", 6.0), (9, "hidden", "Z", "gone", 1.0)]
    given = [
        (1, 1, "no json", "stop"), (1, 2, GOOD, "stop"), (2, 1, GOOD, "stop"), (2, 2, GOOD, "stop"), (3, 1, GOOD, "stop"),
        (4, 1, "", "stop"), (4, 2, "{", "length"), (4, 3, GOOD[:-3], "length"),
    ]
    got = run(spark, uploads, report, given)
    one = got[1]
    assert (one.stock_id, one.price_aed, one.brand, one.year, one.ext_res.id, one.int_res.id) == (code, 5.0, "Kia", 2025, "1", "2")
    assert (one.attempt, one.n_attempts, one.extraction_error, len(one.low_confidence_fields)) == (2, 2, None, 1)
    assert (got[2].stock_id, got[2].price_aed, got[2].attempt, got[2].low_confidence_fields) == ("staged", 9.0, 1, [])
    assert (got[3].stock_id, got[3].price_aed, got[3].ext_res, got[3].attempt) == ("Z", None, None, 1)
    # A cut-off reply that still holds everything asked for is usable.
    assert got[4].stock_id == code and got[4].attempt == 3 and len(got[4].low_confidence_fields) == 2
    assert got[5].stock_id is None and got[5].extraction_error == "no reply for the uploaded sheet" and got[5].n_attempts == 0
    assert run(spark, [], [], []) == {}


def test_last_error_of_a_sheet(spark):
    got = run(spark, [(1, "A", None, None)], [], [(1, 1, "{", "length"), (1, 2, "", "stop")])
    assert got[1].extraction_error == "empty content (finish_reason=stop)" and got[1].json is None
    assert got[1].low_confidence_fields is None


def test_payload_ids_keep_groups_apart(spark):
    doc = lambda g, f: json.dumps({"parent_features": g, "features": f})
    rows = [
        (1, doc([{"id": 1, "name": "Comfort"}], [{"id": 5, "name": "ABS", "parent": "Comfort"}])),
        (2, doc([{"id": 2, "name": "Comfort"}], [{"id": 6, "name": "Radio", "parent": "Comfort"}, {"id": 7, "name": "?", "parent": "None"}])),
        (3, "broken"), (4, None), (5, doc([], [])),
    ]
    groups, features = catalogs.parse_feature_catalog(spark.createDataFrame(rows, "payload_id int, payload string"))
    assert sorted((r.payload_id, r.name, r.parent_id) for r in groups.collect()) == [(1, "Comfort", "1"), (2, "Comfort", "2")]
    assert sorted((r.payload_id, r.name, r.parent_id, r.ord) for r in features.collect()) == [(1, "ABS", "1", 0), (2, "?", "", 1), (2, "Radio", "2", 0)]


def test_repair_is_the_longest_valid_prefix():
    """The oracle's search and the operator agree on every cut of documents with brackets inside texts."""
    r = random.Random(4)

    def value(depth):
        if depth == 2 or r.random() < 0.5:
            return r.choice(["a, b", "]}", "{[", 'q"t', "", 1, 2.5, None, True])
        return [value(depth + 1) for _ in range(r.randint(0, 3))] if r.random() < 0.5 else {f"k{i}": value(depth + 1) for i in range(r.randint(0, 3))}

    docs = [json.dumps({f"f{i}": value(0) for i in range(r.randint(1, 4))}) for _ in range(12)]
    texts = sorted({d[:n] for d in docs for n in range(1, len(d) + 1)})
    con = duckdb.connect()
    con.execute("CREATE TABLE sheet_replies AS SELECT unnest(range(len(?))) AS event_id, unnest(?) AS content", [texts, texts])
    closings = tuple("".join(c) + "}" for n in range(4) for c in itertools.product("]}", repeat=n))
    sql = reply_sql.reply_ctes(closings=closings).replace(reply_sql.with_clause("sheet_replies") + ",", "")
    want = {i: (j, d) for i, j, d in con.execute(f"WITH {sql} SELECT event_id, json, dropped FROM rec").fetchall()}
    for i, t in enumerate(texts):
        body = t.strip()
        try:
            json.loads(body)
            assert want[i] == (body, 0)
        except json.JSONDecodeError:
            assert want[i] == replies.repair_json(body), body
