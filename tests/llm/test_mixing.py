"""Mixing against an iterative sharing of targets and a running sum."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lotledger.llm import mixing


def shared(sizes):
    """Targets by the rule as stated: share, stop at three times, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(order)}
    target, stopped = {}, set()
    total = sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        open_ = [s for s in order if s not in stopped]
        target = {s: Fraction(3 * sizes[s]) for s in stopped} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


ROWS = [(i, "w " * random.Random(i).randint(0, 60), None, f"s{i % 7}" if i % 3 else "big") for i in range(600)]
ROWS += [(1000 + i, None if i % 2 else "", None, None) for i in range(4)] + [(2000, "a b c", None, None), (2001, "a b", None, "é")]


def check(rows, got):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = shared(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-9, abs=1e-9)
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    longest = max(len((r[1] or "").split()) for r in rows)
    for s, t in taken.items():
        assert abs(t - float(want[s])) <= longest + 1, s


def test_targets_and_copies(documents):
    df = documents(ROWS)
    got = mixing.allot(df).collect()
    assert len(got) == len(ROWS)
    check(ROWS, got)
    again = mixing.allot(documents(ROWS[::-1], 5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_one_copy_for_each_boundary(documents):
    got = sorted(mixing.allot(documents([(i, "x y", None, "s") for i in range(50)] + [(99, "x " * 300, None, "t")])).filter("source = 's'").collect())
    rate = got[0]["target"] / got[0]["source_size"]
    assert sum(r["copies"] for r in got) in (math.floor(50 * rate), math.ceil(50 * rate))


def test_mix_emits_copies_and_keeps_columns(documents):
    rows = ROWS + [(7, "same same", None, "big")] * 3
    df = documents(rows).withColumn("copies", F.lit("mine")).withColumn("id", F.lit(1))
    out = mixing.mix(df)
    assert out.columns == df.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.n_words("text")).alias("n")).collect()}
    goal = {r["source"]: r["target"] for r in mixing.allot(df).collect()}
    assert all(abs(words.get(s, 0) - t) <= 61 for s, t in goal.items())


def test_hot_source_and_equal_sizes(documents):
    rows = [(i, "one two three", None, "hot") for i in range(900)] + [(1000 + i, "one two", None, f"s{i % 5}") for i in range(100)]
    check(rows, mixing.allot(documents(rows)).collect())


def test_empty_table(documents):
    df = documents([])
    assert mixing.allot(df).collect() == [] and mixing.mix(df).collect() == []


def test_all_without_words(documents):
    got = mixing.allot(documents([(1, None, None, "a"), (2, "", None, "b")])).collect()
    assert all(r["copies"] == 0 and r["target"] == 0 for r in got)
