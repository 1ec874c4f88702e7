"""Replies, attempts, scoring gates, identity, trust, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from lotledger.functions import replies as rp
from lotledger.functions import trust as tr
from lotledger.operators import attempts, freshness, identity, library, scoring
from lotledger.sources import answer_cache, uploads
from lotledger.streaming.stock_feed import start_stock_feed

REPLY = {
    "brand": 'a "q" \\', "model": "x, [y] {z}", "trim": None, "year": 2025,
    "raw_specifications": [{"label": "k", "value": "1"}, {"label": "Seats", "value": [1, [2, 3]]}],
    "description": "d", "raw_features": ["ABS", "TPMS"],
}


def test_every_prefix_recovers_to_a_prefix(spark):
    text = json.dumps(REPLY)
    rows = spark.createDataFrame([(i, text[:i]) for i in range(len(text) + 1)], "n int, body string")
    got = {r.n: r.recovered for r in rp.recover_json(rows, "body").collect()}
    assert got[0].json is None
    assert json.loads(got[len(text)].json) == REPLY and got[len(text)].dropped == 0
    for n in range(1, len(text)):
        out = got[n]
        if out.json is None:
            assert out.dropped == len(text[:n].strip()) and n <= text.index(",")
            continue
        value = json.loads(out.json)
        assert list(value) == list(REPLY)[: len(value)]
        # Everything before the last kept key is whole.
        assert all(value[k] == REPLY[k] for k in list(value)[:-1])


def test_repair_cases():
    assert rp.repair_json('{"a": [1, {"b": 2}, {"c"') == ('{"a": [1, {"b": 2}]}', 6)
    assert rp.repair_json('{"a": 1, "b":') == ('{"a": 1}', 6)
    assert rp.repair_json("no json") == (None, 7)
    assert rp.repair_json("[1, 2") == (None, 5)
    # All brackets closed, or a fault that isn't the end: nothing is cut away without notice.
    for text in ('{"brand":"x","model":"y"}\n\nHope this helps!', '{"a":1,"b":2}}', '{"a":1,"b":tru, "c":', '{"a":1}{"b":2,"c"', "{}", '{"a": [1, x], "b": [2'):
        assert rp.repair_json(text) == (None, len(text)), text
    assert rp.repair_json('{"a": [1, x], "b": 2, "c": [3, 4') == (None, 32)
    assert rp.repair_json('{"a": 1, "b": [2, {"c": tru, "d"') == ('{"a": 1, "b": [2]}', 16)


def test_repair_keeps_the_longest_valid_prefix():
    whole = '{"a": [1, {"b": "x, ]"}, [2, 3]], "c": {"d": null}, "e": "t"}'
    for n in range(1, len(whole)):
        text, lost = rp.repair_json(whole[:n])
        fits = []
        for k in range(n + 1):
            for closing in ("}", "]}", "}}", "}]}", "]]}"):
                try:
                    value = json.loads(whole[:k].rstrip().rstrip(",") + closing)
                except ValueError:
                    continue
                # Cut after an element: the next sign ends it, or it was itself closed.
                if whole[k : k + 1] == "," or whole[k - 1 : k] in ("}", "]"):
                    fits.append((k, value))
        want = max(fits, key=lambda f: f[0], default=None) if fits else None
        if want is None or want[0] > n - (whole[want[0] : want[0] + 1] == ","):
            continue
        assert text is not None and json.loads(text) == want[1], whole[:n]
        assert lost == n - len(whole[: want[0]].rstrip().rstrip(","))


def test_unwrapping(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(rp.strip_fences(F.lit("```json\n{}\n```  "))) == "{}"
    assert one(rp.json_text(F.lit('Sure: {"a": 1} ok?'))) == '{"a": 1}'
    assert one(rp.json_text(F.lit("list [1, 2] end"))) == "[1, 2]"
    assert one(rp.shape_issues(F.lit(json.dumps(REPLY)))) == []
    issues = one(rp.shape_issues(F.lit('{"brand": 1, "raw_specifications": [], "raw_features": "x"}')))
    assert "missing top-level key 'year'" in issues and "'raw_features' should be an array, got str" in issues
    assert any("skeleton" in i for i in issues)


def test_extraction_report(spark):
    good, cut = json.dumps(REPLY), json.dumps(REPLY)[:120]
    rows = [
        # exact-named sheet first; strict reply broken, fallback good
        ("c1", "b.pdf", 0, "C1", 1, good, "stop"), ("c1", "c1.PDF", 1, "C1", 1, "oops", "stop"), ("c1", "c1.PDF", 1, "C1", 2, good, "stop"),
        # unrepairable truncation stops the car before its good second sheet
        ("c2", "a.pdf", 0, "z", 1, "{", "length"), ("c2", "b.pdf", 1, "z", 1, good, "stop"),
        # a shape failure does not
        ("c3", "a.pdf", 0, "z", 1, "{}", "stop"), ("c3", "b.pdf", 1, "z", 1, good, "stop"),
        ("c4", "a.pdf", 0, "z", 1, good[:-5], "max_tokens"),
        ("c5", "a.pdf", 0, "z", 1, cut[:20], "stop"),
    ]
    df = spark.createDataFrame(rows, "car string, pdf string, pdf_ord int, search_key string, attempt int, content string, finish_reason string")
    got = {r.car: r for r in attempts.extraction_report(attempts.judge_replies(df)).collect()}
    assert (got["c1"].pdf, got["c1"].attempt, got["c1"].n_pdfs_tried) == ("c1.PDF", 2, 1)
    assert attempts.FALLBACK_NOTE in got["c1"].low_confidence_fields
    assert got["c2"].json is None and got["c2"].stopped_on_truncation and got["c2"].n_pdfs_tried == 1
    assert (got["c3"].pdf, got["c3"].n_pdfs_tried) == ("b.pdf", 2)
    assert got["c4"].json and attempts.TRUNCATED_NOTE in got["c4"].low_confidence_fields
    assert got["c5"].json is None and "None of the 1" in got["c5"].extraction_error


def test_car_status(spark):
    cars = spark.createDataFrame(
        [("a", "f1", None, False), ("b", None, "no folder", False), ("c", "f2", None, False), ("d", None, "disk", True), ("e", "f1", None, False)],
        "car string, folder_path string, lookup_error string, failed boolean",
    )
    files = spark.createDataFrame([("f1", "pdf"), ("f1", "photo"), ("f2", "photo")], "folder_path string, kind string")
    done = spark.createDataFrame([("a", "{}", None)], "car string, json string, extraction_error string")
    got = {r.car: r for r in attempts.car_status(cars, files, done, photos_ok=F.lit(False)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "needs_folder_link", "c": "needs_folder_link", "d": "needs_review", "e": "ok"}
    assert "has no spec sheet yet" in got["c"].error and got["c"].n_photos == 1
    assert got["a"].completed and not got["e"].completed


def test_page_gates(spark):
    pages = spark.createDataFrame(
        [("d", i, p) for i, p in enumerate([True, True, False, True, True])] + [("e", 0, True)], "doc string, page int, photo boolean"
    )
    assert {r.doc: r.boundary for r in scoring.spec_page_boundary(pages).collect()} == {"d": 3, "e": 1}
    pytest.importorskip("PIL")
    import io

    from PIL import Image

    def png(colour):
        out = io.BytesIO()
        Image.new("RGB", (4, 4), colour).save(out, "PNG")
        return out.getvalue()

    stats = scoring.page_statistics(spark.createDataFrame([("d", 0, png((255, 255, 255))), ("d", 1, png((200, 10, 10)))], "doc string, page int, image binary"))
    got = {r.page: (r.white_fraction, r.colourfulness) for r in stats.collect()}
    assert got == {0: (1.0, 0.0), 1: (0.0, 190.0)}


def test_photos(spark):
    df = spark.createDataFrame([("c", "p1", [0.7, 0.3]), ("c", "p2", [0.45, 0.55]), ("c", "p3", [0.1, 0.9])], "car string, photo string, probs array<float>")
    gated = scoring.gate_photos(df, {0: "Exterior", 1: "Interior"})
    assert tuple(scoring.photo_slots(gated).first())[1:] == (1, 1, 1)
    images = spark.createDataFrame([("c", "p", b"x")], "car string, photo string, image binary")
    assert scoring.classify_images(images, lambda: lambda blobs: [[0.0, 1.0] for _ in blobs]).first().probs == [0.0, 1.0]


def test_guards_and_trust(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    guard = lambda n, s: one(uploads.rejection(F.lit(n), F.lit(s), [".pdf"], 100))
    assert guard("a.PDF", 50) is None and "empty" in guard("a.pdf", 0) and "'(none)'" in guard("a", 5) and "too large" in guard("a.pdf", 101)
    assert one(tr.trust(F.lit("language_model"), F.lit("human_picked"))) == "proposed"
    assert one(tr.trust(F.lit("spec_sheet"), F.lit("model_level"))) == "assumed"
    assert one(tr.remedy_code(F.lit("add_folder: x: y"))) == "add_folder" and one(tr.remedy_detail(F.lit("add_folder: x: y"))) == "x: y"
    assert one(tr.remedy_code(F.lit("other: x"))) is None and one(tr.remedy_detail(F.lit("other: x"))) == "other: x"


def test_identity(spark):
    code = spark.createDataFrame([("c", "KIA", " ", "LX", 2025)], "car string, brand string, model string, trim string, year int")
    sheet = spark.createDataFrame([("c", "k.i.a", "Rio", "EX", None)], "car string, brand string, model string, trim string, year int")
    merged = identity.merge_identity(code, sheet)
    got = {r.field: (r.value, r.source) for r in merged.collect()}
    assert got == {"brand": ("k.i.a", "agreed"), "model": ("Rio", "spec_sheet"), "trim": ("EX", "conflict"), "year": ("2025", "model_code")}
    assert 'trim (sheet says "EX", code says "LX")' in identity.conflict_summary(merged).first().summary


def test_fingerprint_ignores_order_not_content(spark):
    rows = [("a/b.jpg", "b.jpg", False, 1, 2), ("a", "a", True, 0, 9)]
    schema = "path string, name string, is_dir boolean, size long, mtime_ns long"
    fp = lambda r: freshness.tree_fingerprint(spark.createDataFrame(r, schema)).first().fingerprint
    assert fp(rows) == fp(rows[::-1]) == fp([rows[0], ("a", "a", True, 5, 7)])
    assert fp(rows) != fp([("a/b.jpg", "b.jpg", False, 2, 2), rows[1]])


def test_car_files_are_whole_and_ranked(spark):
    rows = [(f"x/f/p{i}.jpg", f"p{i}.jpg", False, 1, 1) for i in range(9)] + [("x/f/s/a.pdf", "a.pdf", False, 1, 1), ("x/fo/q.jpg", "q.jpg", False, 1, 1)]
    entries = spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, mtime_ns long")
    got = library.car_files(entries, spark.createDataFrame([("x/f",)], "folder_path string")).collect()
    assert sorted((r.relative_path, r["rank"]) for r in got) == [*((f"p{i}.jpg", i + 1) for i in range(9)), ("s/a.pdf", None)]


def test_answer_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert answer_cache.load_cache(spark, path).count() == 0
    cols = "parent string, raw_key string, raw_value string, status string, name string, id string, resolved_at timestamp, method string"
    for at, name in (("2026-01-01", "Old"), ("2026-01-02", "New")):
        rows = spark.createDataFrame([("Color", "X", "x", "matched", name, "1", None, "llm")], cols).withColumn("resolved_at", F.lit(at).cast("timestamp"))
        answer_cache.append_answers(rows, path)
    assert [r.name for r in answer_cache.load_cache(spark, path).collect()] == ["New"]


def _answer(spark, value, name, at):
    row = spark.createDataFrame([("Color", None, value, "matched", name, "1", None, "llm")], answer_cache.SCHEMA)
    return row.withColumn("resolved_at", F.lit(at).cast("timestamp"))


def _names(df):
    return {r.raw_key: r.name for r in df.collect()}


def test_answer_cache_survives_a_stopped_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    answer_cache.append_answers(_answer(spark, "a", "Old", "2026-01-01"), path)
    answer_cache.compact(spark, path)
    answer_cache.append_answers(_answer(spark, " A ", "New", "2026-01-02"), path)
    real = spark.createDataFrame

    def stopped(data, schema=None, **kw):
        if "batches" in str(schema):
            raise RuntimeError("stopped before the manifest")
        return real(data, schema, **kw)

    monkeypatch.setattr(spark, "createDataFrame", stopped)
    with pytest.raises(RuntimeError):
        answer_cache.compact(spark, path)
    monkeypatch.undo()
    assert _names(answer_cache.load_cache(spark, path)) == {"A": "New"}
    answer_cache.compact(spark, path)
    assert _names(answer_cache.load_cache(spark, path)) == {"A": "New"}


def test_answer_cache_drops_what_is_folded(spark, tmp_path):
    path = str(tmp_path / "cache")
    for i in range(4):
        answer_cache.append_answers(_answer(spark, f"k{i}", f"N{i}", "2026-01-01"), path)
        answer_cache.compact(spark, path)
        assert len(list((tmp_path / "cache" / "snapshots").iterdir())) <= 2
        assert len(list((tmp_path / "cache" / "appended").iterdir())) == 1
    answer_cache.append_answers(_answer(spark, "k0", "Older", "2025-01-01"), path)
    assert _names(answer_cache.load_cache(spark, path)) == {f"K{i}": f"N{i}" for i in range(4)}
    answer_cache.append_answers(_answer(spark, "none", "x", "2026-01-01").limit(0), path)
    answer_cache.compact(spark, path)
    assert _names(answer_cache.load_cache(spark, path)) == {f"K{i}": f"N{i}" for i in range(4)}


def test_answer_cache_lookup_reads_its_bucket(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.range(500).select(
        F.lit("Color").alias("parent"), F.lit(None).cast("string").alias("raw_key"), F.concat(F.lit("v"), "id").alias("raw_value"), F.lit("matched").alias("status"),
        F.concat(F.lit("n"), "id").alias("name"), F.lit("1").alias("id"), F.lit("2026-01-01").cast("timestamp").alias("resolved_at"), F.lit("llm").alias("method"))
    answer_cache.append_answers(rows, path)
    answer_cache.compact(spark, path)
    keys = spark.createDataFrame([("Color", "V7"), ("Color", "V7"), ("Color", "GONE"), (None, "V8")], "parent string, raw_key string")
    found = answer_cache.load_cache(spark, path, keys)
    assert _names(found) == {"V7": "n7"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert answer_cache.load_cache(spark, path, keys.limit(0)).count() == 0


def test_stock_feed(spark, tmp_path):
    source, reports = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"ord": 1, "model_code": "A", "aed_price": "5"}\n{"ord": 2, "model_code": "B", "aed_price": "6"}\n')
    live = spark.createDataFrame([(0, "a", "active", 5.0)], "ord int, model_number string, status string, price_aed double")
    for _ in range(2):
        start_stock_feed(spark, str(source), reports, str(tmp_path / "cp"), lambda: live).awaitTermination()
    got = sorted((r.report_id, r.bucket, r.model_number) for r in spark.read.parquet(reports).collect())
    assert got == [(0, "new", "B"), (0, "unchanged", "a")]
    # Two files that wait together are two snapshots.
    (source / "b.json").write_text('{"ord": 1, "model_code": "C", "aed_price": "5"}\n')
    (source / "c.json").write_text('{"ord": 1, "model_code": "A", "aed_price": "5"}\n')
    start_stock_feed(spark, str(source), reports, str(tmp_path / "cp"), lambda: live).awaitTermination()
    later = sorted((r.report_id, r.bucket, r.model_number) for r in spark.read.parquet(reports).filter("report_id > 0").collect())
    assert {r[0] for r in later} == {1, 2}
    assert sorted(r[1:] for r in later) == [("hidden", "a"), ("new", "C"), ("unchanged", "a")]
