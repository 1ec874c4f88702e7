"""Mixture inference: learned languages, held-out accuracy, mixtures."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotledger.llm import language, queries

SF = "/root/testdata/sf0.01"
STEMS = {"aa": ["kala", "maru", "tiko", "nalu", "rake"], "bb": ["strom", "grind", "welch", "flunt", "drosk"], "cc": ["éphon", "çuile", "rêva", "oùtre", "lîsse"]}


def prose(r, lang, n):
    return " ".join("".join(r.choices(STEMS[lang], k=r.randint(1, 2))) for _ in range(n))


def learned(documents):
    r = random.Random(1)
    rows = [(i, prose(r, lang, 40), lang, None) for i, lang in enumerate(list(STEMS) * 20)]
    return language.learn(documents([*rows, (900, None, "aa", None), (901, "kala", None, None), (902, "123", "dd", None)])), r


def test_counts_match_loops(documents):
    rows = [(1, "Abba cab", "x", None), (2, "ab", "x", None), (3, "éa!", "y", None)]
    model = language.learn(documents(rows))
    assert model.languages == ["x", "y"]
    owner, bucket = language.ngrams(["Abba cab", "ab"])
    assert np.bincount(owner).tolist() == [7, 2]
    # The same trigram in another text falls in the same bucket: edge, a, b; and a, b, edge.
    assert bucket[0] == bucket[7] and bucket[6] == bucket[8] and len(set(bucket.tolist())) == 7
    counts = np.bincount(bucket, minlength=language.BUCKETS)
    want = np.log(counts + language.SMOOTHING) - np.log(9 + language.SMOOTHING * language.BUCKETS)
    assert np.allclose(model.logp[:, 0], want, atol=1e-5)


def test_single_and_mixed_texts(documents):
    model, r = learned(documents)
    one = prose(r, "bb", 60)
    mixed = prose(r, "aa", 70) + ". " + prose(r, "cc", 30)
    shares = language.infer(model, [one, mixed, "", None, "12 !!", "kala"])
    assert shares[0].tolist() == [0, 1, 0] + [0] * (len(model.languages) - 3)
    assert shares[1][1] == 0 and 0.55 < shares[1][0] < 0.85 and abs(shares[1].sum() - 1) < 1e-6
    assert not shares[2:5].any() and shares[5][0] == 1


def test_steps_and_neighbours_do_not_matter(documents):
    model, r = learned(documents)
    texts = [prose(r, r.choice(list(STEMS)), r.randint(0, 30)) + " " + prose(r, r.choice(list(STEMS)), r.randint(0, 30)) for _ in range(40)]
    whole = language.infer(model, texts)
    assert np.allclose(whole, np.concatenate([language.infer(model, [t]) for t in texts]), atol=0.02)
    assert ((whole > 0) == np.concatenate([language.infer(model, [t]) > 0 for t in texts])).mean() > 0.97


def test_undetermined_empty_and_clashing_columns(documents):
    model, _ = learned(documents)
    df = documents([(1, None), (2, ""), (3, "42 ²"), (4, "rake maru"), (4, "rake maru")]).withColumn("score", F.lit("x")).withColumn("bucket", F.lit(1))
    rows = language.identify(df, model).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in rows) == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa")]
    assert all(r["score"] == (0.0 if r["lang_pred"] == "und" else 1.0) and r["bucket"] == 1 for r in rows)
    assert language.identify(documents([]), model).collect() == []
    nothing = language.learn(documents([]))
    assert language.identify(documents([(1, "words")]), nothing).collect()[0]["lang_pred"] == "und"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op7_language_mixture"](spark, SF)
    both = got.join(truth, "doc_id").filter("held_out AND lang_pred <> 'und'")
    right, n = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97
    assert got.filter("score < 0 OR score > 1").isEmpty()
