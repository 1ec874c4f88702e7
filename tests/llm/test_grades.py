"""Ordinal regression: gradients, order of thresholds, held-out accuracy."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotledger.llm import grades
from lotledger.llm.columns import table

SF = "/root/testdata/sf0.1"


def rated(n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = r.randint(0, 3)
        words = [f"w{r.randint(0, 60)}" for _ in range(30)] + [["bad", "poor", "fair", "fine"][g]] * 2
        r.shuffle(words)
        rows.append((" ".join(words), g))
    return rows


def test_learns_ordered_grades():
    rows = rated()
    owner, bucket = grades.features(pa.array([t for t, _ in rows]))
    model = grades.fit(owner, bucket, np.array([g for _, g in rows]), 4)
    assert (np.diff(model.thresholds) > 0).all()
    fresh = rated(100, 9)
    tails = model.tails(model.scores(pa.array([t for t, _ in fresh])))
    assert (np.diff(tails, axis=1) <= 0).all()
    expected, y = tails.sum(axis=1), np.array([g for _, g in fresh])
    assert np.corrcoef(expected, y)[0, 1] > 0.9 and np.abs(expected - y).mean() < 0.5


def test_gradient_step_lowers_loss():
    rows = rated(120)
    owner, bucket = grades.features(pa.array([t for t, _ in rows]))
    y = np.array([g for _, g in rows])

    def loss(m):
        tails = m.tails(np.bincount(owner, m.weights[bucket], len(y)))
        edges = np.concatenate([np.ones((len(y), 1)), tails, np.zeros((len(y), 1))], axis=1)
        return -np.log(edges[np.arange(len(y)), y] - edges[np.arange(len(y)), y + 1]).mean()

    losses = [loss(grades.fit(owner, bucket, y, 4, epochs=e)) for e in (0, 1, 4)]
    assert losses[0] > losses[1] > losses[2]


def test_features_are_whole_and_slice_free(monkeypatch):
    texts = pa.array([t for t, _ in rated(50)] + [None, "", "x" * 40_000, "É é", "!!"])
    whole = set(zip(*(a.tolist() for a in grades.features(texts)), strict=True))
    monkeypatch.setattr(grades.W, "slices", lambda t, limit=300, f=grades.W.slices: f(t, limit))
    assert set(zip(*(a.tolist() for a in grades.features(texts)), strict=True)) == whole


def test_edge_rows(documents, spark):
    docs = documents([(1, "fine text"), (1, "fine text"), (2, None), (3, ""), (None, "x")]).withColumn("tails", F.lit(1)).withColumn("g", F.lit("g"))
    none = grades.learn(docs, spark.createDataFrame([], "doc_id long, grade int"), grades=3)
    rows = grades.grade_texts(docs, none).collect()
    assert len(rows) == 5 and all(r["tails"] == [0.5, 0.5] and r["expected_grade"] == 1.0 and r["g"] == "g" for r in rows)
    ratings = spark.createDataFrame([(1, 2), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, grade int")
    model = grades.learn(docs, ratings, grades=3)
    assert grades.grade_texts(documents([]), model).collect() == []
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, None), (4, None, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["grade"] for r in grades.grades_of_labels(labels).orderBy("doc_id").collect()] == [0, 0, 2, None, 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), grades.grades_of_labels(table(spark, SF, "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = grades.learn(docs, labels.filter(~out), grades=3)
    both = grades.grade_texts(docs.filter(out).select("doc_id", "text"), model).join(labels, "doc_id")
    by = {r["grade"]: r["kept"] for r in both.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[0] < 0.1 and by[1] < 0.15 and by[2] > 0.95
