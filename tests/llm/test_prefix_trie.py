"""The prefix trie against loops over nested dictionaries."""

import binascii
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotledger.llm import prefix_trie
from lotledger.llm.prefix_trie import Slots, rebuild, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def loops(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] if t[0] else 0, t[2].encode(), t[3].encode()))] for c, ts in own.items()}
    members = {}
    for c in own:
        h = binascii.crc32(str(c).encode()) % 6
        opener = c - int(np.fmod(c, 100))
        path = own.get(opener, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path) == d))
    out = []
    for path, ms in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        leaves = [p for p in under if not any(q[: len(p)] == p and len(q) > len(p) for q in under)]
        ends = ",".join(str(c) for c in sorted(c for c, end in ms if end))
        out.append((
            min(c for c, _ in ms), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(ms), len(kids), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(repr, out))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in trie(*rebuild(df), **options).collect())


def corpus(n, seed, words=3, most=7):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 450), n):
        rows += [(c, t, r.choice(["user", "assistant"]), "ab"[: r.randint(0, 2)] * r.randint(1, words)) for t in range(r.randint(1, most))]
    return rows


ODD = [
    (None, 0, "user", "lost"), (7, None, None, None), (7, None, "a", "b"), (7, 2, "user", "x"), (7, 2, "user", "x"), (7, -5, "user", "minus"), (200, 0, "user", "only"),
    (201, 0, "u", "日本"), (201, 1, "", None), (299, 4, "user", ""), (12345678901234, 1, "user", "far"), (12345678901234, 2, "user", "far"),
]


@pytest.mark.parametrize("options", [{}, {"light": 4}, {"light": 0}, {"light": 30, "shard_nodes": 5}])
def test_matches_loops(spark, options):
    rows = corpus(60, 1) + ODD
    assert run(spark, rows, **options) == loops(rows)


def test_very_common_conversation_and_first_turn(spark, monkeypatch):
    # A third of all conversations are copies of one, and another third begin alike.
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 120, 3) for t in range(6)]
    rows += [(c, t, "user", "hello" if t < 2 else f"{c} {t}") for c in range(1, 120, 3) for t in range(5)]
    rows += corpus(40, 5)
    rows = [r for i, r in enumerate(rows) if r[0] is not None]
    assert run(spark, rows, light=20) == loops(rows)


def test_one_very_long_conversation_is_many_windows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 4)
    long = [(c, t, "user", f"t{t}") for c in (101, 102, 300) for t in range(230)]
    rows = long + corpus(10, 3)
    assert run(spark, rows, light=64) == loops(rows)


def test_empty_null_only_and_single(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []
    assert run(spark, [(5, 0, "user", "x")]) == loops([(5, 0, "user", "x")])


def test_clashing_columns_are_left_alone(spark):
    rows = corpus(20, 9)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("place", "k1", "_block", "x", "opener", "n_convs")})
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in trie(*rebuild(df)).collect()) == loops(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_slots_are_minimal_and_checked(n):
    r = np.random.default_rng(n)
    a, b = r.integers(0, 50, n).astype(np.uint64), np.arange(n).astype(np.uint64)
    slots = Slots(a, b)
    assert sorted(slots.find(a, b)) == list(range(n))
    assert (slots.find(a, b + np.uint64(n)) == -1).all()


def test_a_key_that_stands_twice_is_an_error():
    with pytest.raises(ValueError, match="twice"):
        Slots(np.array([3, 3], np.uint64), np.array([4, 4], np.uint64))
