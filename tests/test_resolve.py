"""Catalog resolution: facts, and token search against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lotledger.operators import answers, colours, features, resolve, specs
from lotledger.sources import catalogs

OPT = "id string, name string, aliases array<string>, ord bigint"


def _resolve(spark, options, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    opts = spark.createDataFrame([(i, n, a, k) for k, (i, n, a) in enumerate(options)], OPT)
    return {r.value: r.res for r in resolve.resolve_values(df, opts, **kw).collect()}


def test_cascade(spark):
    options = [("1", "Red Fox", ["rf"]), ("2", "Red Fox Turbo", []), ("3", "Blue", ["redfox"]), ("4", "Land Cruiser Prado", [])]
    got = _resolve(spark, options, ["Red Fox", "rf", "RED-FOX", "Cruiser Prado Land X", "fox", "zzz", " ", "blue!"])
    assert (got["Red Fox"].id, got["Red Fox"].method) == ("1", "exact")
    assert (got["rf"].id, got["rf"].method) == ("1", "exact")
    assert (got["RED-FOX"].id, got["RED-FOX"].method, got["RED-FOX"].confidence) == ("1", "normalized", 0.98)
    assert (got["Cruiser Prado Land X"].id, got["Cruiser Prado Land X"].method) == ("4", "token")
    assert got["fox"].status == "ambiguous" and [c.id for c in got["fox"].candidates] == ["1", "2"]
    assert got["zzz"].status == "missing" and got[""].status == "absent"
    assert got["blue!"].id == "3"


def _brute(options, value):
    def score(a, b):
        a, b = set(a.split()), set(b.split())
        n = len(a & b)
        return max(n / len(a | b), n / min(len(a), len(b)) * 0.85) if n else 0.0

    ranked = sorted(((score(n, value), k, i) for k, (i, n, _) in enumerate(options)), key=lambda t: (-t[0], t[1]))
    return [(i, round(s, 9)) for s, _, i in ranked[:5] if s > 0]


def _best(spark, values, options, **kw):
    from lotledger.functions import text as tx

    df = spark.createDataFrame([(0, v) for v in values], "s int, value string").distinct()
    opts = spark.createDataFrame([(0, i, n, k) for k, (i, n, _) in enumerate(options)], "s int, id string, name string, ord bigint")
    return resolve.with_best_options(df, F.col("value"), opts, ["s"], tx.token_set, below="below", **kw).collect()


def _check(rows, options, floor=0.35):
    for r in rows:
        want = _brute(options, r.value)
        assert [(t.id, round(t.score, 9)) for t in r.top] == [w for w in want if w[1] >= floor], r.value
        if not r.top:
            assert round(r.below or 0, 9) == (want[0][1] if want else 0), r.value


@pytest.mark.parametrize(("seed", "most"), [(7, 3), (8, 9), (9, 20)])
def test_token_search_equals_brute_force(spark, seed, most):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "f", "g", "h"] + [f"w{i}" for i in range(3 * most)]
    pick = lambda: " ".join(dict.fromkeys(rng.sample(words[: rng.choice([3, 8, len(words)])], rng.randint(1, 3)) + rng.choices(words, k=rng.randrange(most)) + [f"u{rng.randrange(30)}"] * rng.choice([0, 0, 1])))
    options = [(str(k), pick(), None) for k in range(150)]
    _check(_best(spark, [pick() + rng.choice(["", " zz", " zz yy xx vv"]) for _ in range(80)], options), options)


def test_token_in_every_option_and_very_long_texts(spark):
    rng = random.Random(4)
    rare = [f"r{i}" for i in range(400)]
    options = [(str(k), " ".join(["car", *dict.fromkeys(rng.choices(rare[:40], k=rng.randint(0, 5)))]), None) for k in range(300)]
    options += [(str(k), " ".join(["car", *rng.sample(rare, 199)]), None) for k in range(300, 312)]
    values = ["car", "car car2", "car r1 r2", "zz car", "a b c d e f g car", "none of these"]
    values += [" ".join(["car", *rng.sample(rare, 199)]) for _ in range(5)] + [" ".join([*rng.sample(rare, 12), *(f"x{i}" for i in range(188))]) for _ in range(5)]
    _check(_best(spark, values, options), options)


def test_frequent_tokens_are_no_keys(spark):
    """Of three tokens or more, a set's most frequent one lists nothing."""
    sets = spark.createDataFrame([(0, ["a", "b", "c"], ["c", "b", "a"]), (0, ["a", "d"], ["d", "a"]), (0, ["a"], ["a"])], "s int, _o array<string>, _r array<string>")
    listed = resolve._keys(sets, ["s", "_o"], F.lit(2), resolve.needed(F.size("_o"), 0.35)).collect()
    assert sorted((len(r["_o"]), r["_need"], r["_t"]) for r in listed) == [(2, 2, "d"), (3, 2, "b"), (3, 2, "c")]


def test_repeated_options_count_once_and_empty_sides(spark):
    rows = [("1", "red fox turbo", None), ("2", "red cat", None)]
    df = spark.createDataFrame([(0, "red fox")], "s int, value string")
    from lotledger.functions import text as tx

    opts = spark.createDataFrame([(0, "1", "red fox turbo", 0)] * 3 + [(0, "2", "red cat", 1)] * 2, "s int, id string, name string, ord bigint")
    out = resolve.with_best_options(df, F.col("value"), opts, ["s"], tx.token_set).first()
    assert [(t.id, round(t.score, 9)) for t in out.top] == _brute(rows, "red fox")
    empty = resolve.with_best_options(df, F.col("value"), opts.filter("false"), ["s"], tx.token_set, below="b").first()
    assert empty.top == [] and empty.b is None
    assert resolve.with_best_options(df, F.lit(None).cast("string"), opts, ["s"], tx.token_set).first().top == []


SPECS = [
    ("Color", "13", "White", "white"), ("Color", "14", "Black", "black"), ("Interior Color", "36", "Ivory", "ivory"),
    ("Interior Color", "37", "Green", "charcoal"), ("Seats", "61", "5-Seater", "5-seater"), ("Seats", "68", "13-Seater", "15-seater"),
    ("Regional Specification", "1", "GCC", "gcc"), ("Regional Specification", "2", "EU", "eu"), ("Body Type", "51", "SUV", "suv"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(SPECS)], "parent string, id string, name string, slug string, ord bigint")


def test_catalog_facts(spark, catalog):
    ask = [("Interior Color", "Charcoal"), ("Interior Color", "GREY"), ("Seats", "5"), ("Seats", "15"), ("Regional Specification", "US"), ("Nope", "x")]
    df = spark.createDataFrame(ask, "parent string, value string")
    got = {(r.parent, r.value): r.res for r in specs.resolve_spec_values(df, catalog).collect()}
    assert got[ask[0]].id == "37" and got[ask[1]].status == "missing"
    assert (got[ask[2]].id, got[ask[2]].method) == ("61", "numeric")
    assert got[ask[3]].method == "normalized" or got[ask[3]].status != "matched"
    assert got[ask[4]].status == "missing" and got[ask[5]].method == "unknown_parent"


def test_label_parents(spark):
    labels = ["interior colour finish", "Gear-box", "Boot lid", "kerb weight", "No. of Seats", "specs"]
    parents = spark.createDataFrame([("Boot Lid", 0), ("Color", 1)], "name string, ord bigint")
    got = {r.label: r.parent for r in specs.label_parents(spark.createDataFrame([(v,) for v in labels], "label string"), parents).collect()}
    # The first hint in table order wins: plain "colour" comes before "interior colour".
    assert got == {"interior colour finish": "Color", "Gear-box": None, "Boot lid": "Boot Lid", "kerb weight": None,
                   "No. of Seats": "Seats", "specs": "Regional Specification"}


def test_colours(spark, catalog):
    rows = [("Color", "WHITE BODY & BLACK ROOF"), ("Color", "SONIC QUARTZ"), ("Color", "ghost"), ("Color", "new one"), ("Color", "odd"), ("Color", " ")]
    cache = colours.upsert_cache(
        spark.createDataFrame([], "parent string, raw_key string, raw_value string, status string, name string, id string, resolved_at int, method string"),
        spark.createDataFrame([("Color", "Sonic quartz", "matched", "Black", "14", 1, "llm"), ("Color", "ghost", "matched", "Gone", "9", 1, "llm")],
                              "parent string, raw_value string, status string, name string, id string, resolved_at int, method string"),
    )
    replies = spark.createDataFrame([("Color", "GHOST", "NO_MATCH"), ("Color", "NEW ONE", "White"), ("Color", "ODD", "Mauve")], "parent string, raw_key string, choice string")
    got = {r.raw: r.res for r in colours.resolve_colours(spark.createDataFrame(rows, "parent string, raw string"), catalog, cache, replies).collect()}
    assert got["WHITE BODY & BLACK ROOF"].id == "13"
    assert (got["SONIC QUARTZ"].id, got["SONIC QUARTZ"].method) == ("14", "ai_cached")
    assert got["ghost"].method == "llm_no_match"          # cached name left the catalog
    assert (got["new one"].id, got["new one"].method) == ("13", "llm")
    assert got["odd"].method == "llm_invalid_choice" and got[" "].method == "empty"


def test_features(spark):
    vocab = spark.createDataFrame([("comfort", "Heated Seats", 0), ("comfort", "Parking sensor rear", 1), ("security", "ABS", 2)], "group string, label string, ord bigint")
    items = spark.createDataFrame([(v,) for v in ["heating of seats", "Rear parking radar x", "ESC", "wings"]], "item string")
    flat = {r.item: r.label for r in features.match_vocabulary(items, vocab, flat=True).collect()}
    grouped = {r.item: r.label for r in features.match_vocabulary(items, vocab, flat=False).collect()}
    assert flat == {"heating of seats": "Heated Seats", "Rear parking radar x": "Parking sensor rear", "ESC": None, "wings": None}
    assert grouped["ESC"] == "Vehicle Stability Control"


def test_consensus(spark):
    a = spark.createDataFrame(
        [("c", "p", "matched", "x"), ("c", "p", "other", "y"), ("c", "q", "important", "y"), ("c", "p", "other", "z")],
        "car string, provider string, kind string, label string",
    )
    got = {r.label: (r.matched, r.suggested, r.important) for r in answers.consensus(a, a.select("car", "provider")).collect()}
    assert got == {"x": (True, False, False), "y": (False, True, True)}


def test_list_places(spark):
    rows = [("c", "b", True, False, False), ("c", "a", True, True, False), ("c", "z", False, True, True), ("c", "B", True, False, False), ("d", "q", False, True, False)]
    df = spark.createDataFrame(rows, "car string, label string, matched boolean, suggested boolean, important boolean")
    got = {(r.car, r.label): (r.matched_place, r.suggested_place) for r in answers.list_places(df).collect()}
    assert got == {("c", "B"): (1, None), ("c", "a"): (2, 2), ("c", "b"): (3, None), ("c", "z"): (None, 1), ("d", "q"): (None, 1)}
    assert answers.list_places(df.limit(0)).collect() == []


def test_catalog_payloads(spark):
    spec = '{"parent_specifications":[{"id":1,"name":"Color","mandatory":true}],"values":[{"id":3,"name":"Red","parent":"Color","status":"Draft"},{"id":4,"label":"Blue","parent_specification":"Color"}]}'
    parents, values = catalogs.parse_spec_catalog(spark.createDataFrame([(spec,)], "payload string"))
    assert [(r.name, r.mandatory) for r in parents.collect()] == [("Color", True)]
    assert [(r.id, r.name, r.parent_id) for r in values.collect()] == [("4", "Blue", "1")]
    tree = '[{"name":"KIA","models":[{"title":"Rio","id":7,"trims":[{"label":"L"},{"label":"X","aliases":["x1"]}]}]}]'
    rows = {(r.level, r.name): r for r in catalogs.parse_taxonomy(spark.createDataFrame([(tree,)], "payload string")).collect()}
    assert rows[("brand", "KIA")].id == "@000000000" and rows[("model", "Rio")].parent_id == "@000000000"
    assert rows[("trim", "X")].aliases == ["x1"] and rows[("trim", "L")].parent_id == "7"
    assert len({r.id for r in rows.values()}) == len(list(itertools.chain(rows)))
