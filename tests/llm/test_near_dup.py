"""Near duplicates against all pairs on a small table."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lotledger.llm import near_dup as nd
from lotledger.llm import words as W
from lotledger.llm.graph import components


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    ids = [i for i, _ in rows]
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    bags = [(i, bag(t)) for i, t in rows]
    for x, (i, a) in enumerate(bags):
        for j, b in bags[:x]:
            if a and b and jaccard(a, b) >= 0.8:
                p, q = sorted((find(i), find(j)))
                label[q] = p
    return {i: find(i) for i in ids}


def prose(r, n):
    return [f"w{r.randint(0, 3000)}" for _ in range(n)]


def corpus():
    r = random.Random(8)
    rows, n = [], 0
    common = " ".join(prose(r, 40))
    for family in range(25):
        words = prose(r, r.randint(6, 150))
        for _ in range(r.randint(1, 6)):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = f"edit{n}"
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(30):  # texts that share a passage only
        rows.append((n, " ".join(prose(r, 90)) + " " + common))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "one  two"), (n + 5, "one"), (n + 6, "a " * 400), (n + 7, "a " * 398), (n + 8, "a " * 200)]
    return rows


def got(df, **how):
    return {r["doc_id"]: r["class_id"] for r in nd.classes(df, **how).collect()}


def test_classes_match_all_pairs(documents):
    rows = corpus()
    assert got(documents(rows)) == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(1)
    for shared, a_only, b_only in ((50, 10, 10), (5, 1, 0), (300, 200, 50)):
        a = Counter({i: r.choice([1, 1, 2, 3, 7, 40]) for i in range(shared + a_only)})
        b = Counter({i: max(1, a[i] + r.choice([0, 0, 1, -1, 5])) for i in range(shared)}) + Counter({1000 + i: r.randint(1, 9) for i in range(b_only)})
        m = 4096
        text = np.array([0] * len(a) + [1] * len(b))
        item = W.mix64(np.array([*a, *b], np.uint64))
        reg = nd.bag_min_hash(text, item, np.array([*a.values(), *b.values()]), 2, m)
        assert abs((reg[0] == reg[1]).mean() - jaccard(a, b)) < 4 * (0.25 / m) ** 0.5


def test_repeats_count():
    part = next(W.slices(pa.array(["a b c d e a b c d e", "x y", ""])))
    text, _, n = nd.shingles(part)
    assert sorted(zip(text.tolist(), n.tolist(), strict=True)) == [(0, 1)] * 4 + [(0, 2), (1, 1)]


def test_star_of_edited_copies_is_one_class(documents):
    """Copies of one text, each edited elsewhere: many pairs of copies lie below 0.8, all are near the original."""
    words = prose(random.Random(3), 100)
    rows = [(500, " ".join(words))]
    for i in range(60):
        w = list(words)
        w[10 + i] = f"e{i}"
        w[(40 + i) % 100] = f"f{i}"
        rows.append((i, " ".join(w)))
    assert set(got(documents(rows)).values()) == {0}


def test_blocks_do_not_change_classes(documents, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "BEST", 1)
    rows = corpus()
    assert got(documents(rows)) == brute(rows)


def test_second_turn_keeps_the_buckets_of_nodes_apart(spark):
    members = spark.createDataFrame([(7, 1, 3), (7, 2, 3), (7, 3, 3), (8, 3, 2), (8, 4, 2), (9, 5, 2), (9, 6, 2)], "key long, node long, n long")
    pairs = spark.createDataFrame([(1, 2, True), (3, 4, False), (5, 6, True)], "a long, b long, more boolean")
    labels = spark.createDataFrame([(5, 5), (6, 5)], "node long, label long")
    apart = nd._apart(pairs, labels)
    assert sorted(r.node for r in apart.collect()) == [1, 2]  # 5 and 6 were joined since, 3 and 4 had no others
    assert sorted((r.key, r.node, r.n) for r in nd._buckets_of(members, apart).collect()) == [(7, 1, 3), (7, 2, 3), (7, 3, 3)]


def test_turns_end_where_no_node_is_apart(documents, monkeypatch):
    """The second turn reads no bucket again that the first has settled."""
    seen, own = [], nd._near_pairs
    monkeypatch.setattr(nd, "_near_pairs", lambda opened, *a: (seen.append(opened.count()), own(opened, *a))[1])
    monkeypatch.setattr(nd, "BEST", 1)
    # Sketches in one class bound by size alone, so unlike texts of one length stay apart.
    monkeypatch.setattr(nd, "CLASSES", 1)
    r = random.Random(4)
    rows = []
    for family in range(6):
        words = prose(r, 60)
        for i in range(5):  # a fifth of the words differ: buckets are shared, links aren't
            rows.append((len(rows), " ".join(words[:48] + [f"v{family}x{i}w{j}" for j in range(12)])))
    words = prose(r, 90)
    rows += [(100 + i, " ".join(words + [f"z{i}"])) for i in range(4)]
    assert got(documents(rows)) == brute(rows)
    assert len(seen) < 2 or seen[1] <= seen[0]


def test_sketches_deal_no_bags(spark):
    bags = spark.createDataFrame([(1, bytes(16)), (2, bytes(8))], "node long, bag binary")
    made = nd._sketches(bags, bags.select("node").filter("node = 1"))
    assert {r.node: r["size"] for r in made.collect()}[1] == 2
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1  # the broadcast cells


def test_bounds_hold():
    r = np.random.default_rng(0)
    bags = [np.sort(r.integers(0, 40, r.integers(1, 90)).astype(np.uint64)) for _ in range(30)]
    hashed = [np.sort(W.mix64(b)) for b in bags]
    for most in (65535, 1):  # full classes too
        sketch = np.stack([np.minimum(np.bincount((h >> np.uint64(40)).astype(int) % nd.CLASSES, minlength=nd.CLASSES), most) for h in hashed]).astype(np.uint16)
        sizes = np.array([len(b) for b in bags])
        bound = nd.bounds(sketch, sizes, sketch, sizes)
        exact = np.array([[nd.overlap(a.tobytes(), b.tobytes()) for b in hashed] for a in hashed])
        assert (bound >= exact - 1e-12).all()


def test_chain_through_an_outlier(documents):
    """Links that don't pass the central text: each text is near its neighbours only."""
    words = prose(random.Random(5), 120)
    rows = []
    for i in range(40):
        rows.append((i, " ".join([f"n{j}" for j in range(i * 2)][-60:] + words[: 120 - min(60, i * 2)])))
    assert got(documents(rows)) == brute(rows)


def test_hot_copies(documents):
    rows = [(i, "the same text again and again in most rows") for i in range(700)] + [(1000 + i, f"text number {i} is its own and no other has it {i}") for i in range(50)]
    classes = got(documents(rows))
    assert {classes[i] for i in range(700)} == {0} and all(classes[1000 + i] == 1000 + i for i in range(50))


def test_null_ids_repeated_ids_and_extra_columns(documents):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (5, a), (None, a), (None, "only here with no id at all"), (7, b), (7, "quite another text of id seven here"), (9, b)]
    out = nd.classes(documents(rows)).collect()
    assert Counter((r[0], r[1]) for r in out) == Counter([(5, 5), (5, 5), (None, 5), (None, None), (7, 7), (7, 7), (9, 7)])
    df = documents(rows).withColumn("key", F.lit("k")).withColumn("node", F.lit(1)).withColumn("n", F.lit(2)).withColumn("id", F.lit(3))
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([5, 7, None, None])


def test_keep_one_keeps_the_smallest_of_each_class(documents):
    rows = corpus()
    want = brute(rows)
    assert sorted(r["doc_id"] for r in nd.keep_one(documents(rows)).collect()) == sorted({want[i] for i in want})


def test_empty_table(documents):
    assert nd.classes(documents([])).collect() == [] and nd.keep_one(documents([])).collect() == []


def test_components_of_a_long_path(spark):
    n = 200
    order = random.Random(2).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (1003, 1003)]
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}
