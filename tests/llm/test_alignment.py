"""Alignment of two tokenizers against loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotledger.llm import alignment
from lotledger.llm.alignment import Fragment, compose
from lotledger.llm.bytelevel import byte_level

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n b", "one two  three\tfour", "<|endoftext|> <s>", "x▁y z", "日本語 テスト 😀👍🏽 ok", "naïve café",
    " b c", "x" * 700, "a　 b", "end \n\n start", " lead and trail ", "123 4567,89", "it's we'll",
]


def texts(n, seed=3):
    r = random.Random(seed)
    pool = [chr(c) for c in range(32, 127)] + list("éüßñ日本語😀\t\n ") + ["the ", " of", "ing ", "tion", " ▁", "  ", "0x1F"] + [" word", " other", " thing"] * 9
    return ["".join(r.choices(pool, k=r.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes = byte_level(A).token_bytes

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        """Groups and links of one text."""
        if not text:
            return [], []
        of_a, of_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x, y = [a_bytes[i] for i in of_a], [b_bytes(i) for i in of_b]
        if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            return [], []
        ends = lambda parts: list(np.cumsum([len(p) for p in parts]))
        ea, eb = ends(x), ends(y)
        common, groups, p, q = sorted(set(ea) & set(eb)), [], 0, 0
        for c in common:
            i, j = ea.index(c) + 1, eb.index(c) + 1
            groups.append((of_a[p:i], of_b[q:j]))
            p, q = i, j
        links = [(of_a[i], of_b[j]) for i in range(len(ea)) for j in range(len(eb)) if max(ea[i] - len(x[i]), eb[j] - len(y[j])) < min(ea[i], eb[j])]
        return groups, links

    def all_of(rows):
        done = [one(t) for t in rows]
        counts = Counter(p for _, links in done for p in set(links))
        best = defaultdict(int)
        for (i, _), n in counts.items():
            best[i] = max(best[i], n)
        out = []
        for groups, links in done:
            s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if groups else "",
            ))
        return out

    return all_of


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def results(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"range_bytes": 48, "fan": 2}, {"head_pairs": 0}, {"range_bytes": 90, "fan": 3, "head_pairs": 40}])
def test_matches_loops(documents, brute, options):
    rows = ODD + texts(120) + ["the same words here"] * 5
    got = results(alignment.align(documents(list(enumerate(rows))), A, B, **options))
    want = brute(rows)
    for i, t in enumerate(rows):
        assert got[i] == want[i], (t, options)


def test_very_long_text_is_dealt_out(documents, brute):
    long = " ".join(texts(400, 8)).replace("▁", "") + "y" * 5000 + " end of it"
    rows = [long, "a short one", long]
    assert len(list(alignment.ranges(long, 4096))) > 4
    got = results(alignment.align(documents(list(enumerate(rows))), A, B, range_bytes=4096, fan=2))
    whole = results(alignment.align(documents(list(enumerate(rows))), A, B, range_bytes=1 << 30))
    assert got == whole and got[0][0] > 4000
    ends = lambda parts: np.cumsum([len(p) for p in parts])
    t = alignment._tokenizers(A, B)
    a, b = t.a.encode(" " + long, add_special_tokens=False).ids, t.b.encode(long)
    assert got[0][:2] == (len(a), len(b))
    assert got[0][2] == len(set(ends(t.a_bytes[i] for i in a)) & set(ends(t.b_bytes[i] for i in b)))


def test_fragments_are_a_monoid():
    r = random.Random(2)
    for _ in range(30):
        size = r.randint(5, 60)
        a_ends, b_ends = (np.array(sorted({*r.sample(range(1, size), r.randint(0, size // 2)), size})) for _ in "ab")
        a, b = np.arange(len(a_ends)), np.arange(len(b_ends)) + 100
        cuts = sorted({0, size, *r.sample(range(1, size), 3)})
        parts = [Fragment.of_range(a, b, a_ends, b_ends, x, y) for x, y in zip(cuts, cuts[1:])]
        whole = Fragment.of_range(a, b, a_ends, b_ends, 0, size)
        left = right = None
        for p in parts:
            left = p if left is None else compose(left, p)
        for p in reversed(parts):
            right = p if right is None else compose(p, right)
        assert left.groups == right.groups == whole.groups and not left.open_left
        assert compose(Fragment(open_left=False), left).groups == whole.groups
        assert parts[-1].open_left


def test_units_join_to_the_text_and_encode_alike():
    t = alignment._tokenizers(A, B)
    assert t.cuttable
    for text in [x for x in ODD + texts(200, 9) if x]:
        cut = alignment.units(text)
        assert " ".join(cut) == text
        assert [i for u in cut for i in t.a.encode(" " + u, add_special_tokens=False).ids] == t.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for u in cut for i in t.b.encode(u)] == t.b.encode(text)


def test_model_that_cant_be_cut(documents, brute, monkeypatch):
    t = alignment._tokenizers(A, B)
    t.cuttable = False
    try:
        assert t.cut("a b") == ["a b"]
        assert [x[3] for x in alignment.ranges("a b " * 9 + "c", 8, t.cut)] == ["a b " * 9 + "c"]
    finally:
        t.cuttable = True


def test_empty_table_repeats_and_clashing_columns(documents):
    assert alignment.align(documents([]), A, B).collect() == []
    df = documents([(1, "the cat sat"), (1, "the cat sat"), (None, None)]).withColumn("n_a", F.lit("old")).withColumn("key", F.lit(2)).withColumn("good", F.lit("x"))
    rows = alignment.align(df, A, B, groups="groups", range_bytes=4).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["n_b"], r["good"], r["key"]) for r in rows) == [(0, 0, 0, "x", 2), (1, 3, 3, "x", 2), (1, 3, 3, "x", 2)]
    # Two documents hold each pair.
    assert {r["count_sum"] for r in rows if r["doc_id"]} == {6} and {r["groups"].count("|") for r in rows if r["doc_id"]} == {3}
