"""Crawl and location on a small library; every role fact is a row here."""

import os
from unittest import mock

import pytest
from pyspark.sql import functions as F

from lotledger.functions import carkey
from lotledger.functions import compare as cp
from lotledger.operators import freshness, library
from lotledger.operators import locate as loc
from lotledger.sources import index_store, tree
from lotledger.sources.entries import read_entries

FILES = [
    "SUV/TOYOTA-COROLLA-GLI-PV-2.0-AT-26/WHITE INSIDE BLACK 26/a.jpg",
    "SUV/TOYOTA-COROLLA-GLI-PV-2.0-AT-26/WHITE INSIDE BLACK 26/TOYOTA COROLLA GLI no logo.pdf",
    "SUV/MG-ZS-STANDARD-PV-1.50-AT-26/WHITE INSIDE BLACK/b.JPG",
    "SUV/MG-ZS-STANDARD-PV-1.50-AT-26/RED INSIDE BLACK/b.jpg",
    "SUV/MG-ZS-STANDARD-PV-1.50-AT-26/Thumbs.db",
    "SUV/MG-ZS-COMFORT-PV-1.5-AT/WHITE INSIDE BLACK-ABCDEFGH123456789/c.jpg",
    "VAN/TOYOTA-HILUX-GLX-PV-2.7-MT-26/PHOTOS/d.jpg",
    "VAN/TOYOTA-COASTER-STD-DV-4.0-MT/WHITE INSIDE GREY/e.jpg",
    "VAN/KIA-ALL-CARS-PV-2.0-AT/KIA-RIO-LX-PV-1.4-AT/RED INSIDE RED/f.jpg",
    "VAN/KIA-ALL-CARS-PV-2.0-AT/KIA-RIO-LX-PV-1.40-AT-2026/BLUE INSIDE RED/f.jpg",
    "VAN/KIA-ALL-CARS-PV-2.0-AT/KIA-RIO-LX-PV-1.40-AT-2026/BLUE INSIDE RED/deep/g.jpg",
    "docs/old/list.xlsx", "docs/readme.txt", "VAN/notes.txt",
    "SUV/MG-HS-LUX-PV-2.0-AT/readme.md",
]

CARS = {
    # prefix of another name is a different car
    "TOYOTA-COROLLA CROSS-GLI-PV-2.0-AT-WHITE-BLACK-26": ("absent", "no_such_name", "add_folder"),
    "TOYOTA-COROLLA-GLI-PV-2.0-AT-WHITE-BLACK-26": ("matched", "matched", None),
    "TOYOTA-COROLLA-GLI-PV-2.0-AT-WHITE-BLACK-22": ("absent", "spec_differs", "confirm_field"),
    # no colour in the feed: the model still matches, its only variant is the answer
    "TOYOTA-COROLLA-GLI-PV-2.0-AT-26": ("matched", "matched", None),
    "TOYOTA-COROLLA-GLI-PV-2.0-AT-RED-BLACK-26": ("absent", "no_variant_in_colour", "photograph_variant"),
    # no year on the folder, another tag: kept
    "MG-ZS-COMFORT-PV-1.5-AT-WHITE-BLACK-ZZZZZZZZ123456789-22": ("matched", "matched", None),
    # 1.5 and 1.50 are one engine; the trim differs from COMFORT
    "MG-ZS-STANDARD-PV-1.5-AT-WHITE-BLACK-26": ("matched", "matched", None),
    "MG-ZS-STANDARD-PV-1.5-AT-26": ("ambiguous", "several_variants", "pick_one_of"),
    "TOYOTA-HILUX-GLX-PV-2.7-AT-WHITE-BLACK-26": ("absent", "spec_differs", "confirm_field"),
    "TOYOTA-COASTER-STD-DV-4.2-MT-WHITE-GREY-26": ("absent", "spec_differs", "confirm_field"),
    "TOYOTA-HILUX-GLX-PV-2.7-MT-WHITE-BLACK-26": ("matched", "matched", None),
    # two folders of one name: colour separates them, or nothing does
    "KIA-RIO-LX-PV-1.4-AT-BLUE-RED-26": ("matched", "matched", None),
    "KIA-RIO-LX-PV-1.4-AT-26": ("ambiguous", "several_folders", "pick_one_of"),
    "KIA-RIO-LX-PV-1.4-AT-GREEN-RED-26": ("absent", "no_folder_in_colour", "photograph_variant"),
    "MG-HS-LUX-PV-2.0-AT-WHITE-BLACK-26": ("absent", "no_variants", "photograph_variant"),
    "no car at all": ("absent", "nothing_offered", "add_folder"),
}


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(p, p.rsplit("/", 1)[-1], False, len(p), 1) for p in FILES]
    return spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, mtime_ns long")


@pytest.fixture(scope="module")
def lib(entries):
    return library.crawl(entries)


@pytest.fixture(scope="module")
def located(spark, lib):
    rows = spark.createDataFrame([(c,) for c in CARS], "number string")
    return loc.locate(carkey.parse_car_strings(rows, "number"), lib)


def test_retrieved_names_the_buckets_that_hit(lib, located):
    asked, buckets = loc.questions(located.targets.select("car")), loc.bucket_tables(lib)
    held = {}
    for r in buckets.collect():
        held.setdefault((r.bucket, r.key), set()).add(r.path)
    want = {}
    for q in asked.collect():
        tried = [("designation_fingerprint", q.d_fp), ("brand_token", q.brand_key), ("sheet_filename_stem", q.raw_fp), ("sheet_filename_stem", q.d_fp)]
        found = {}
        for bucket, key in tried:
            for path in held.get((bucket, key), ()) if key else ():
                hit = found.setdefault(path, ([], []))
                for seen, x in zip(hit, (bucket, key)):
                    if x not in seen:
                        seen.append(x)
        want[q.question] = found
    got = {}
    for r in loc.retrieved(asked, buckets).collect():
        assert got.setdefault(r.question, {}).setdefault(r.path, (r.buckets, r.keys)) == (r.buckets, r.keys)
    assert got == {q: f for q, f in want.items() if f}
    assert any(len(b) > 1 for f in got.values() for b, _ in f.values())
    pools = {r.question: r.n_pool for r in located.answers.collect()}
    assert {q: len(f) for q, f in want.items()} == pools


def test_crawl(lib):
    folders = {r.path: r for r in lib.folders.collect()}
    assert len(folders) == 8
    assert "VAN/KIA-ALL-CARS-PV-2.0-AT" not in folders
    assert folders["SUV/MG-HS-LUX-PV-2.0-AT"].body_type_hint == "SUV"
    variants = {r.path: r for r in lib.variants.collect()}
    assert variants["SUV/TOYOTA-COROLLA-GLI-PV-2.0-AT-26/WHITE INSIDE BLACK 26"].n_sheets == 1
    drift = {(r.kind, r.subject) for r in lib.drift.collect()}
    assert ("dead-branch", "docs") in drift and ("dead-branch", "docs/old") not in drift
    assert ("car-name", "VAN") in drift and ("loose-file", "SUV/MG-HS-LUX-PV-2.0-AT") in drift
    assert ("variant-colours", "VAN/TOYOTA-HILUX-GLX-PV-2.7-MT-26/PHOTOS") in drift
    assert any(k == "below-variant" for k, _ in drift)


def test_outcomes(located):
    got = {r.number: (r.outcome, r.stage, r.remedy_code) for r in located.targets.collect()}
    assert got == CARS


def test_details(located):
    rows = {r.number: r for r in located.targets.collect()}
    assert rows["TOYOTA-COROLLA-GLI-PV-2.0-AT-WHITE-BLACK-26"].basis == "sole_variant"
    assert rows["MG-ZS-STANDARD-PV-1.5-AT-WHITE-BLACK-26"].basis == "colour_unique"
    assert rows["MG-ZS-STANDARD-PV-1.5-AT-26"].discriminator == "exterior"
    assert rows["KIA-RIO-LX-PV-1.4-AT-26"].discriminator == "model_year"
    assert rows["TOYOTA-COROLLA CROSS-GLI-PV-2.0-AT-WHITE-BLACK-26"].tally == "3 on designation"
    assert rows["TOYOTA-COASTER-STD-DV-4.2-MT-WHITE-GREY-26"].failed_specs == "engine_l"
    options = loc.candidates(located).join(located.answers.select("question", "stage"), "question")
    assert options.filter("stage = 'several_folders'").count() == 2
    assert options.filter("stage = 'several_variants'").count() == 2


def test_no_match_contradicts_a_corroborator(spark, lib, located):
    hits = located.targets.filter("outcome = 'matched'").join(
        lib.folders.select(F.col("path").alias("folder_path"), F.col("car").alias("other")), "folder_path"
    )
    verdicts = cp.compare_cars(F.col("car"), F.col("other"))
    assert hits.filter(cp.first_killer(verdicts).isNotNull()).count() == 0


def test_messages(located):
    got = {r.number: r for r in loc.messages(located, "number").collect()}
    assert got["TOYOTA-COROLLA-GLI-PV-2.0-AT-WHITE-BLACK-26"].located_path.endswith("WHITE INSIDE BLACK 26")
    text = got["KIA-RIO-LX-PV-1.4-AT-26"].message
    assert "matches 2 folders" in text and text.endswith("'model_year'. Remedy: pick_one_of: state the model_year of this car, or let a reviewer choose")


def test_blocked(spark, lib):
    rows = carkey.parse_car_strings(spark.createDataFrame([("A-B-C-PV-2-AT",)], "number string"), "number")
    empty = library.Library(*[t.limit(0) for t in (lib.folders, lib.variants, lib.sheets)], lib.drift)
    assert loc.locate(rows, empty).targets.first().stage == "empty_index"
    assert loc.locate(rows, lib, fresh=F.lit(False)).targets.first().stage == "stale_index"


def test_prefixes(spark, lib, located):
    car = F.col("car")
    folders = lib.folders.select(car.designation.fingerprint.alias("d_fp"), carkey.brand_key(car).alias("brand_key"))
    asked = spark.createDataFrame([("toyotacorollagliplus", "toyota"), ("mgzs", "mg"), ("mghslux", "mg")], "d_fp string, brand_key string")
    got = {(r.d_fp, r.folder_fp) for r in loc.prefix_rejects(asked, folders).collect()}
    assert got == {("toyotacorollagliplus", "toyotacorollagli"), ("mgzs", "mgzsstandard"), ("mgzs", "mgzscomfort")}


def test_verdicts_and_roles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    v = lambda a, b: one(cp.code_verdict(F.lit(a), F.lit(b)))
    assert [v("=a", "=a"), v("=a", "=b"), v("-", "=a"), v("-", "-"), v("?a", "-"), v("=", "=")] == [
        "equal", "disagree", "one_silent", "both_silent", "uncomparable", "disagree"]
    kills = lambda role, verdict: one(cp.eliminates(F.lit(role), F.lit(verdict)))
    assert kills("gate", "one_silent") and not kills("corroborator", "one_silent")
    assert kills("corroborator", "disagree") and not kills("separator", "disagree")
    assert one(cp.role_of(F.lit("model_head"))) == "evidence_only"
    line = cp.sentence("fuel", F.lit("disagree"), F.lit("PV"), F.lit("EV"))
    assert one(line) == "fuel: 'PV' vs 'EV'"


def test_index_round_trip(spark, lib, entries, tmp_path):
    path = str(tmp_path / "index")
    fp = freshness.tree_fingerprint(entries).first().fingerprint
    index_store.save_index(lib, path, "/lib", fp, F.lit("2026-01-01"))
    loaded, meta = index_store.load_index(spark, path)
    assert loaded.folders.count() == 8 and meta.first().fingerprint == fp
    with pytest.raises(index_store.EmptyIndexRefused):
        index_store.save_index(library.Library(lib.folders.limit(0), lib.variants, lib.sheets, lib.drift), path, "/lib", fp, F.lit("2026-01-01"))
    # A writer that stops at any table leaves the index before; a later one replaces it.
    class Stopped(Exception):
        pass

    for at in index_store.TABLES:
        broken = mock.Mock()
        broken.write.parquet.side_effect = Stopped
        tables = {n: broken if n == at else getattr(lib, n) for n in index_store.TABLES}
        with pytest.raises(Stopped):
            index_store.save_index(library.Library(**tables) if at != "folders" else library.Library(mock.Mock(isEmpty=lambda: False, write=broken.write), lib.variants, lib.sheets, lib.drift), path, "/lib", "other", F.lit("2026-01-02"))
        assert index_store.load_index(spark, path)[1].first().fingerprint == fp
    index_store.save_index(lib, path, "/lib", "later", F.lit("2026-01-03"))
    loaded, meta = index_store.load_index(spark, path)
    assert meta.first().fingerprint == "later" and meta.count() == 1
    lib.folders.limit(3).write.mode("overwrite").parquet(f"{path}/versions/{meta.first().version}/folders")
    with pytest.raises(index_store.IndexCorrupt):
        index_store.load_index(spark, path)
    with pytest.raises(index_store.IndexCorrupt):
        index_store.load_index(spark, str(tmp_path / "nowhere"))


def test_topmost_mark_on_a_deep_way(spark):
    """A chain of 60 directories, and many that hang on one."""
    chain = ["/".join(f"d{i}" for i in range(n)) for n in range(1, 61)]
    wide = [f"{chain[20]}/w{i}" for i in range(300)]
    marks = {chain[5], chain[30], chain[59], wide[7]} - {chain[5]}
    rows = [(p, p.rpartition("/")[0] or None, p if p in marks else None) for p in chain + wide]
    got = {r.path: r.top for r in library.topmost(spark.createDataFrame(rows, "path string, up string, top string")).collect()}
    for p, *_ in rows:
        above = ["/".join(p.split("/")[:n]) for n in range(1, p.count("/") + 2)]
        assert got[p] == next((a for a in above if a in marks), None), p


def _tree(tmp_path):
    for p in FILES[:4]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"xy")
    (tmp_path / "empty" / "inner").mkdir(parents=True)
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "dead.jpg").symlink_to(tmp_path / "nothing")
    return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if not p.is_symlink())


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_read_tree(spark, tmp_path, partitions):
    want = _tree(tmp_path)
    rows = tree.read_tree(spark, str(tmp_path), partitions).collect()
    assert sorted(r.path for r in rows if r.issue is None) == want
    assert {r.path: (r.is_dir, r.size) for r in rows if r.issue is None} == {p: ((tmp_path / p).is_dir(), 0 if (tmp_path / p).is_dir() else 2) for p in want}
    assert {r.path: r.issue for r in rows if r.issue} == {"loop": "link", "dead.jpg": "link"}


def test_read_tree_needs_a_folder(spark, tmp_path):
    with pytest.raises(Exception, match="no folder that can be reached"):
        tree.read_tree(spark, str(tmp_path / "gone")).collect()
    assert tree.read_tree(spark, str(tmp_path)).collect() == []


def test_tree_partitions_cover_the_tree_once(tmp_path, monkeypatch):
    """A folder that can't be listed is a row, and costs nothing else."""
    want = _tree(tmp_path)
    real = os.scandir

    def scandir(path):
        if str(path).endswith("/empty"):
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    for wanted in (1, 2, 5, 100):
        reader = tree.TreeReader(str(tmp_path), wanted)
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert sorted(r[0] for r in rows if r[5] is None) == [p for p in want if p != "empty/inner"]
        assert [(r[0], r[2]) for r in rows if r[5] == "folder can't be listed"] == [("empty", True)]


def test_tree_names_that_are_not_utf8(tmp_path):
    with open(os.path.join(os.fsencode(tmp_path), b"b\xff.jpg"), "wb"):
        pass
    ((path, name, *_, issue),) = tree.children(str(tmp_path), "")
    assert (path, name, issue) == ("b\ufffd.jpg", "b\ufffd.jpg", "name isn't UTF-8")


def test_read_entries(spark, tmp_path):
    for p in FILES[:4]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = read_entries(spark, str(tmp_path))
    assert sorted(r.path for r in got.collect()) == sorted(FILES[:4])
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
