"""Neighbours against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotledger.llm import neighbours as nb

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, block int"


def brute(rows, k=nb.K):
    ok = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    lengths = [len(v) for _, v in ok]
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    ok = [(i, np.array(v, np.float64)) for i, v in ok if len(v) == d]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            found = set()
            for j, v in ok:
                if j != i:
                    total = 0.0
                    for a, b in zip(q.tolist(), v.tolist(), strict=True):
                        total += a * b
                    found.add((-total, j))
            out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def got(df, **how):
    out = {}
    for r in nb.search(df, F.col("id") % 20 == 0, **how).orderBy("query_id", "rank").collect():
        found = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(found) + 1
        found.append((r["vec_id"], r["score"]))
    return out


def frame(spark, rows):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def rows(n=900, d=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    return [(i, (centres[i % 6] + 0.4 * r.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]


def test_all_visits_are_exact(spark):
    data = rows(400)
    data += [(1000 + i, data[5][1]) for i in range(90)] + [(1000, data[5][1]), (40, data[40][1])]
    data += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0] * 7), (2080, [float("nan")] * 8), (2100, [None] + [1.0] * 7), (2120, [float("inf")] * 8), (None, data[3][1])]
    assert got(frame(spark, data), visits=10**6) == brute(data)


def test_calibrated_recall(spark):
    data = rows(3000, 16)
    want, found = brute(data), got(frame(spark, data))
    assert set(found) == set(want) and all(len(v) == nb.K for v in found.values())
    hits = np.mean([len({j for j, _ in want[q]} & {j for j, _ in found[q]}) / nb.K for q in want])
    assert hits >= 0.9


def test_ties_go_to_smaller_ids(spark):
    """120 distinct vectors have one product with each query, in any order of rows."""
    r = np.random.default_rng(1)
    data = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [1.0, *r.normal(size=3).astype(np.float32).tolist()]) for i in r.permutation(np.arange(1, 121)).tolist()]
    found = got(frame(spark, data), visits=10**6)
    assert [j for j, _ in found[0]] == list(range(1, 21))
    assert found == brute(data)


def test_ties_of_sparse_vectors(spark):
    r = np.random.default_rng(2)
    data = [(i, np.eye(6)[r.integers(6)].tolist()) for i in range(300)] + [(i, r.integers(0, 2, 6).astype(float).tolist()) for i in range(300, 600)]
    assert got(frame(spark, data), visits=10**6) == brute(data)


def test_blocks_do_not_change_results(spark, monkeypatch):
    data = rows(300)
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(nb, "ASKED", 2)
    assert got(frame(spark, data), visits=10**6) == brute(data)


def test_fewer_candidates_than_k(spark):
    data = rows(8)
    assert got(frame(spark, data)) == brute(data)
    assert got(frame(spark, [(20, [1.0, 2.0])])) == {}
    assert got(frame(spark, [])) == {}


def test_best_bin_first_visits_every_leaf_once():
    points = np.array([v for _, v in rows(700)])
    tree = nb.Tree.fit(points)
    order = list(tree.visits(points[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 10
    assert tree.place(points).max() < tree.leaves


def test_equal_points_make_one_leaf():
    assert nb.Tree.fit(np.ones((500, 3))).leaves == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    found = got(df)
    assert set(found) == set(want)
    hits = np.mean([len({j for j, _ in want[q]} & {j for j, _ in found[q]}) / nb.K for q in want])
    assert hits >= 0.9
