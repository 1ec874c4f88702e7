"""Encoding and decoding against the tokenizers library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotledger.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello <|endoftext|>wörld it's 123 ΑΣ naïve é\n\tfoo", "<|startoftext|><|endoftext|>", "<|EndOfText|> <|endoftext",
    "x" * 3000, "!?" * 900, "İstanbul STRASSE ẞ ﬁ ǅ", "é ñ Å ẛ̣", "\u0085a b c​d\x1ce\x1ff", "½ ² ⅷ ٣ 日本語 😀👍🏽",
    "we'll they'd I'm you've 're 's !!'s", "İİ", "a_b __ c--d", "Ελλάς ΣΑΣ", "﻿bom ᠎ 　x",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def random_texts(n, seed=5):
    r = random.Random(seed)
    pool = [chr(c) for c in range(32, 127)] + list("éüßñçÀΣσς日本語😀́ \t\n\x1c\x85") + ["the", "ing ", "'ll", "Eine ", "<|endoftext|>"]
    return ["".join(r.choices(pool, k=r.randint(0, 200))) for _ in range(n)]


def test_matches_library(documents, library):
    texts = TEXTS + random_texts(400)
    out = bpe.decode(bpe.encode(documents(list(enumerate(texts))), PATH, lexicon_pieces=50), PATH)
    once = {r["doc_id"]: r["decoded"] for r in bpe.encode(documents(list(enumerate(texts))), PATH, lexicon_pieces=50, decoded="decoded").collect()}
    for r in out.collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want, texts[r["doc_id"]]
        assert r["decoded"] == once[r["doc_id"]] == library.decode(want, skip_special_tokens=False)


def test_lexicon_size_changes_nothing():
    vocab = bpe.vocabulary(PATH)
    texts = pa.array(random_texts(60))
    pieces = sorted({p for t in texts.to_pylist() for p in vocab.pieces(t)})
    plain = bpe.Encoder(vocab, None).encode(texts)
    for step in (1, 3):
        entries = sorted((p.encode(), vocab.merge(p)) for p in pieces[::step])
        assert bpe.Encoder(vocab, bpe.Lexicon.compile(entries)).encode(texts).equals(plain)


def test_transducer_is_minimal_and_mappable(tmp_path):
    words = sorted({a + b + c for a in (b"re", b"un", b"") for b in (b"do", b"make", b"read") for c in (b"", b"s", b"ing")} | {b"\xff", b""})
    lex = bpe.Lexicon.compile([(w, [i]) for i, w in enumerate(words)])
    lex.write(str(tmp_path / "lex"))
    lex = bpe.Lexicon.map(str(tmp_path / "lex"))
    assert lex.places(pa.array(words, pa.binary())).tolist() == list(range(len(words)))
    assert lex.places(pa.array([b"redo!", b"mak", b"x", b"doingg"], pa.binary())).tolist() == [-1] * 4
    # Right languages tell states apart: as many states as distinct sets of endings.
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert len(lex.final) == len(endings)


def test_long_piece_is_quick(library):
    text = "ab" * 60_000
    assert bpe.vocabulary(PATH).merge(text) == library.encode(text, add_special_tokens=False).ids


def test_empty_table_unknown_ids_and_clashing_columns(documents, spark):
    empty = bpe.decode(bpe.encode(documents([]), PATH), PATH)
    assert empty.collect() == [] and empty.columns[-2:] == ["ids", "decoded"]
    df = documents([(1, "the cat"), (1, "the cat")]).withColumn("ids", F.lit("old")).withColumn("piece", F.lit(3))
    assert [len(r["ids"]) for r in bpe.encode(df, PATH).collect()] == [2, 2]
    odd = spark.createDataFrame([([0, -1, 999999, 1],), (None,), ([],)], "ids array<int>")
    assert {r["decoded"] for r in bpe.decode(odd, PATH).collect()} == {'! "', None, ""}
