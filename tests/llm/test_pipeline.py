"""The pipeline's stages against brute force on a small corpus."""

import random
from collections import Counter

import corpus_pipeline as cp
from test_near_dup import brute
from test_pii import base
from test_quality_rules import counts

from lotledger.llm import mixing, pii, quality_rules


def corpus():
    r = random.Random(12)
    rows = []
    for i in range(60):
        words = [r.choice("the of and wood tree river stone light".split()) + str(r.randint(100, 999)) + "x" for _ in range(r.randint(60, 120))]
        words[5:5] = [f"mail{i}@x.example.com"] if i % 4 == 0 else []
        rows.append((2 * i, " ".join(words), "en", f"s{i % 3}" if i % 2 else "hot"))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join([*words[:-1], "changed"]), "en", "hot"))
    rows += [(900, "too short", "en", "hot"), (901, None, None, None), (902, "again and " * 60, "en", "s1")]
    return rows


def test_stages_in_order(spark, documents, tmp_path):
    docs = documents(corpus())
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == columns
        seen[name] = docs.collect()

    rows = {i: t for i, t, *_ in corpus()}
    fails = lambda t: counts(t)[0] < 50 or 100 * counts(t)[4] > 50 * counts(t)[0]
    good = {i for i, t in rows.items() if not fails(t)}
    assert {r["doc_id"] for r in seen["quality rules"]} == good
    label = brute([(i, rows[i]) for i in sorted(good)])
    assert {r["doc_id"] for r in seen["near-dedup"]} == set(label.values())
    assert not any(base(r["text"]) for r in seen["personal data"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["personal data"])
    assert sum("<EMAIL>" in r["text"] for r in seen["personal data"]) == sum("@" in rows[i] for i in set(label.values()))
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert max(copies.values()) <= 3 and set(copies) <= set(label.values())
    assert Counter(r["doc_id"] for r in seen["encoding"]) == copies
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in seen["encoding"])


def test_run_on_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_stages_name_their_operators():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-dedup", "personal data", "mixing", "encoding"]
    assert mixing and pii and quality_rules and cp.ORACLE_SQL is None
