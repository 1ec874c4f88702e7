"""Prefix token counts against the library, prefix by prefix."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotledger.llm import token_counts
from lotledger.llm.bytelevel import byte_level
from lotledger.llm.token_counts import PrefixCounter

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a  b", "a   ", "we're they'll I'd 've 're", "'r 'v 'l", "\n\n b\n\nc", "a\n \n b", "x" * 300, " " * 200 + "a", "=-" * 200, "<|endoftext|>",
    "a<|endoftext|> b", "a  <|endoftext|>\n\n<|endoftext|>x", "$<|endoftext|>$<|endo", "'s<|endoftext|>", "日本語 テスト 😀👍🏽", "naïve é", "\u0085a b​c\x1cd　　e",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def texts(n, seed=1):
    r = random.Random(seed)
    pool = [chr(c) for c in range(32, 127)] + list("éüßñ日本語😀́ \t\n  \x1c\x85　") + ["the", "ing ", " 're", "'ll", "'ve", "Eine ", "<|endoftext|>", "   ", "\n\n", "----", "1234", " <|end"]
    return ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(n)]


def test_every_prefix_matches_library(documents, library):
    rows = ODD + texts(150)
    out = token_counts.prefix_counts(documents(list(enumerate(rows))), PATH)
    for r in out.collect():
        text = rows[r["doc_id"]] or ""
        assert r["prefix_tokens"] == [library(text[:i]) for i in range(len(text) + 1)], text


def test_questions_need_no_encoding(documents, library):
    rows = ODD + texts(60, 4)
    counts, budget = F.col("prefix_tokens"), F.lit(9)
    out = token_counts.prefix_counts(documents(list(enumerate(rows))), PATH).select(
        "doc_id", token_counts.total(counts).alias("n"), token_counts.over(counts, budget).alias("over"), token_counts.longest_within(counts, budget).alias("longest"),
        token_counts.truncated(F.col("text"), counts, budget).alias("cut"), token_counts.of_prefix(counts, F.lit(3)).alias("three"),
        token_counts.longest_within(counts, F.lit(-1)).alias("none"),
    )
    assert not any(word in out._jdf.queryExecution().toString() for word in ("PythonUDF", "ArrowEvalPython"))
    for r in out.collect():
        text = rows[r["doc_id"]] or ""
        prefix = [library(text[:i]) for i in range(len(text) + 1)]
        longest = max(i for i, n in enumerate(prefix) if n <= 9)
        assert (r["n"], r["over"], r["longest"], r["cut"]) == (prefix[-1], prefix[-1] > 9, longest, text[:longest])
        assert r["three"] == (prefix[3] if len(text) >= 3 else None) and r["none"] is None


def test_long_pieces_and_many_pieces_at_once(library, monkeypatch):
    counter = PrefixCounter(byte_level(PATH))
    long = "ab" * 40_000 + " " + "-" * 5000 + "é" * 3000
    assert counter.texts([long]).to_pylist()[0][-1] == library(long)
    rows = texts(80, 7)
    want = counter.texts(rows)
    # Pieces one by one, small steps and a memory that is always full give the same.
    for name, value in (("SHORT_BYTES", 0), ("SHORT_ROWS", 3), ("SPREAD_PIECES", 5), ("KNOWN_PIECES", 1), ("KNOWN_PAIRS", 3)):
        monkeypatch.setattr(token_counts, name, value)
        assert PrefixCounter(byte_level(PATH)).texts(rows).equals(want), name


def test_neighbours_stand_as_merging_says():
    vocab = byte_level(PATH)
    counter, r = PrefixCounter(vocab), random.Random(3)
    ids = sorted(vocab.token_bytes)
    runs = [i for i in ids if len(set(vocab.token_bytes[i])) == 1]
    for a, b in [(r.choice(ids), r.choice(ids)) for _ in range(4000)] + [(a, b) for a in runs[:60] for b in runs[:60]]:
        assert counter._together(a, b) == (vocab.merge(vocab.token_bytes[a] + vocab.token_bytes[b]) == [a, b]), (a, b)


def test_empty_table_very_long_text_and_clashing_columns(documents, library):
    assert token_counts.prefix_counts(documents([]), PATH).collect() == []
    long = " ".join(texts(3000, 5))
    df = documents([(1, long), (1, long), (None, None)]).withColumn("prefix_tokens", F.lit("old")).withColumn("counts", F.lit(3))
    rows = token_counts.prefix_counts(df, PATH).select("doc_id", "counts", token_counts.total(F.col("prefix_tokens")).alias("n")).collect()
    assert sorted((r["doc_id"] or 0, r["counts"], r["n"]) for r in rows) == [(0, 3, 0), (1, 3, library(long)), (1, 3, library(long))]
