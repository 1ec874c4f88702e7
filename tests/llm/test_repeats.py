"""Removal of repeated windows against loops."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotledger.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def corpus(seed=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "日本", "a.b", "\u0085x", "|"]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [prose(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(120):
        w = prose(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        rows.append((i * 3 % 121, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (-7, rows[4][1]), (600, "x " * 200), (601, "x " * 20), (602, None), (603, "")]
    rows += [(None, rows[5][1]), (None, None), (700, rows[6][1]), (700, rows[6][1]), (700, rows[7][1])]
    return rows


@pytest.mark.parametrize("block", [3 << 19, 700])
def test_matches_loops(documents, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rows = corpus()
    got = repeats.remove_repeats(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_shards_locate_the_same():
    texts = [(t or "").encode().split() for _, t in corpus()]
    windows = [(d, k) for d, t in enumerate(texts) for k in range(0, len(t) - 12, 5)]
    windows = list({tuple(texts[d][k : k + 13]): (d, k) for d, k in windows}.values())
    first = np.arange(len(windows))
    whole = sorted(repeats.locate(texts, windows, first))
    assert whole == sorted(repeats.locate(texts, windows, first, 3))
    want = {tuple(texts[d][k : k + 13]): n for n, (d, k) in enumerate(windows)}
    every = sorted((d, k, want[tuple(t[k : k + 13])]) for d, t in enumerate(texts) for k in range(len(t) - 12) if tuple(t[k : k + 13]) in want)
    assert whole == every


def test_automata_read_only_runs_of_known_words(monkeypatch):
    """Words that no window holds leave an automaton at its root, so they aren't read by any shard."""
    read, inner = [], repeats.ahocorasick.Automaton

    class Counted:
        def __init__(self, *a):
            self.automaton = inner(*a)

        def __getattr__(self, name):
            return getattr(self.automaton, name)

        def iter(self, signs):
            read.append(len(signs))
            return self.automaton.iter(signs)

    monkeypatch.setattr(repeats.ahocorasick, "Automaton", Counted)
    passage = [b"p%d" % i for i in range(20)]
    texts = [[b"own%d_%d" % (d, i) for i in range(400)] + passage[: 20 if d < 2 else 12] + [b"end%d" % d] for d in range(50)]
    windows = [(0, 400 + k) for k in range(8)]
    got = sorted(repeats.locate(texts, windows, np.arange(8), 3))
    assert got == [(d, 400 + k, k) for d in (0, 1) for k in range(8)]
    # Three shards, each of which reads the passage twice: two signs a word, and a word behind each.
    assert sum(read) <= 3 * 2 * 2 * 21


@pytest.mark.parametrize("values", [1, 3, 50])
def test_distinct_pairs(values):
    r = np.random.default_rng(values)
    a, b = r.integers(-values, values, 400) * 2**56, np.sort(r.integers(0, 9, 400)).astype(np.int32)
    one = repeats._distinct_pairs(a, b)
    want = sorted(set(zip(a.tolist(), b.tolist(), strict=True)))
    assert sorted(zip(a[one].tolist(), b[one].tolist(), strict=True)) == want
    assert len(repeats._distinct_pairs(a[:0], b[:0])) == 0


def test_hot_passage(documents):
    r = random.Random(1)
    hot = " ".join(f"hot{i}" for i in range(25))
    rows = [(i, f"own{i} " * 3 + hot + f" tail{i}" if i % 3 else " ".join(f"z{r.random()}" for _ in range(30))) for i in range(500)]
    got = repeats.remove_repeats(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_hot_copies(documents):
    text = " ".join(f"c{i}" for i in range(40))
    rows = [(i, text) for i in range(5, 600)] + [(3, "x " + text + " y"), (1000, "short one"), (1001, "short one")]
    got = repeats.remove_repeats(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_copies_in_many_batches_are_one_row_of_a_block(spark, documents, monkeypatch):
    """A third of 200 batches hold one text; a block's group holds it once."""
    sizes = []
    monkeypatch.setattr(repeats, "_distinct_texts", lambda dealt, inner=repeats._distinct_texts: sizes.append(inner(dealt)) or inner(dealt))
    hot = " ".join(f"h{i}" for i in range(40))
    rows = [(i, hot if i % 3 == 0 else f"only {i} " + " ".join(f"v{(i * j) % 97}" for j in range(20))) for i in range(600)]
    df = documents(rows).repartition(200, "doc_id")
    got = repeats.remove_repeats(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    (texts,) = sizes
    copies = texts.groupBy("k1", "k2").count().filter("count > 1")
    assert texts.count() == 401 and copies.isEmpty()
    assert texts.filter(F.col("text") == hot).first().id == 0
    # Dealt once: the aggregate sits on the exchange by block.
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_table_and_clashing_columns(documents):
    assert repeats.remove_repeats(documents([])).collect() == []
    df = documents([(1, "a b")]).withColumn("block", F.lit(9)).withColumn("id", F.lit("x")).withColumn("n_words", F.lit(0))
    assert [tuple(r) for r in repeats.remove_repeats(df).collect()] == brute([(1, "a b")])
