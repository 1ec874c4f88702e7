"""Preference formatting against loops."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotledger.llm import preference as pref
from lotledger.llm import queries

SCHEMA = "pair_id long, side string, turn long, role string, text string, extra int"


def text_of(role, text):
    return f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"


def expected(rows):
    sides = defaultdict(list)
    for p, s, n, role, text, *_ in rows:
        if s in ("chosen", "rejected"):
            sides[p, s].append((n, role, text))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    out = {}
    for p in {p for p, _ in sides}:
        a, b = (sorted(sides[p, s], key=key) if (p, s) in sides else None for s in ("chosen", "rejected"))
        n = 0
        while a and b and n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        row = [n, "".join(text_of(*t[1:]) for t in (a or b)[:n])]
        for s in (a, b):
            if s is None:
                row += [None, None]
                continue
            done, spans = "", []
            for _, role, text in s[n:]:
                piece = text_of(role, text)
                if role == "assistant":
                    spans.append(f"{len(done) + len('<|im_start|>assistant') + 1}:{len(done) + len(piece)}")
                done += piece
            row += [done, ",".join(spans)]
        out[p] = tuple(row)
    return out


def collected(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r[0]: tuple(r[1:]) for r in pref.format_pairs(df).collect()}


def test_matches_loops(spark):
    r = random.Random(2)
    rows = []
    for p in range(60):
        shared = [(r.choice(["user", "assistant", "system", None]), r.choice(["hi", "é😀", "", None])) for _ in range(r.randint(0, 4))]
        for side in ("chosen", "rejected"):
            own = [(r.choice(["user", "assistant"]), r.choice(["a", "bb"])) for _ in range(r.randint(0, 3))]
            rows += [(p, side, i, role, text, 1) for i, (role, text) in enumerate(shared + own)]
    rows += [(100, "chosen", 0, "user", "only", 1), (101, "rejected", 0, "assistant", "x", 1), (102, "other", 0, "user", "left out", 1)]
    rows += [(103, s, 0, "user", "same turn", 1) for s in ("chosen", "rejected") for _ in range(3)] + [(103, "chosen", 0, "assistant", "tie", 1)]
    rows += [(None, "chosen", None, "user", "q", 1), (None, "rejected", None, "user", "q", 1), (None, "rejected", 1, "assistant", "y" * 30000, 1)]
    assert collected(spark, rows) == expected(rows)


def test_null_is_not_empty(spark):
    rows = [(1, "chosen", 0, "user", None, 1), (1, "rejected", 0, "user", "", 1)]
    assert collected(spark, rows)[1][0] == 0


def test_many_pairs_that_open_alike(spark):
    rows = [(p, s, i, "user" if i % 2 == 0 else "assistant", "hot" if i < 2 else f"{s}{p}", 1) for p in range(400) for s in ("chosen", "rejected") for i in range(3)]
    got = collected(spark, rows)
    assert len(got) == 400 and all(v[0] == 2 for v in got.values())


def test_reply_swaps(spark):
    rows = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "bye"), (1, 0, "user", "q1"), (1, 1, "assistant", "x"), (1, 2, "user", "more"),
        (1, 3, "assistant", "a1"), (2, 0, "user", "alone"), (3, 0, "user", "z"), (3, 1, "assistant", "zz"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in pref.format_pairs(pref.reply_swaps(df), pair="conv_id").collect()}
    assert set(got) == {0, 1}
    assert got[1]["n_prompt_turns"] == 3
    assert got[0]["chosen"] == text_of("assistant", "a0") and got[0]["rejected"] == text_of("assistant", "a1")


def test_whole_swaps_keep_every_conversation_and_turn(spark):
    rows = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "bye"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"),
        (2, 0, "user", "alone"), (3, 0, "user", "z"), (3, 1, "assistant", "zz"), (6, 0, "assistant", "gap"), (None, 0, "assistant", "no id"),
        (8, None, "assistant", "a8"), (9, 0, "assistant", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r[1:]) for r in pref.format_pairs(pref.reply_swaps(df, whole=True), pair="conv_id").collect()}
    last = {0: ("a0", "a1"), 1: ("a1", "a0"), 8: ("a8", None), 9: (None, "a8")}
    sides = [(c, "chosen", *t) for c, *t in rows]
    sides += [(c, "rejected", n, role, last[c][1] if role == "assistant" else text) for c, n, role, text in rows if c in last]
    assert set(got) == {0, 1, 2, 3, 6, 8, 9, None}
    assert got == expected(sides)
    assert got[0][2] == text_of("assistant", "a0") + text_of("user", "bye") and got[0][4] == text_of("assistant", "a1") + text_of("user", "bye")
    assert all(got[c][4:] == (None, None) for c in (2, 3, 6, None))


def test_query_has_a_row_for_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are not mounted")
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = queries.op4_preference_pairs(spark, sf)
    assert sorted(r[0] for r in got.select("conv_id").collect()) == sorted(r[0] for r in table.select("conv_id").distinct().collect())
    # Every turn is rendered on the chosen side.
    n = lambda c: F.sum(F.size(F.split(c, F.lit("<\\|im_start\\|>"))) - 1)
    assert got.select(n(F.col("prompt")) + n(F.col("chosen"))).first()[0] == table.count()


def test_empty_table(spark):
    assert collected(spark, []) == {}
