"""Word hashes against loops."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lotledger.llm import words as W

MASK = 2**64 - 1


def plain(word, seed, upto):
    factors = [int(f) for f in W.stream(len(word) + 1, seed)]
    total = sum((b + 1) * f for b, f in zip(word[:upto], factors, strict=False)) & MASK
    return int(W.mix64(np.array([total], np.uint64))[0])


@pytest.mark.parametrize("upto", [None, 0, 3, 31, 32, 33, 100])
def test_hashes_match_loops(upto):
    r = random.Random(4)
    length = lambda: r.choice([1, 2, 5, 15, 16, 17, 31, 32, 33, 64, 300])
    texts = [r.choice(["", " "]) + r.choice([" ", "\n\t"]).join("".join(r.choice("abé日\u0085") for _ in range(length())) for _ in range(r.randint(0, 8))) for _ in range(60)]
    texts += [None, "", "  ", *("q" * n for n in (31, 32, 33, 32, 1))]
    for limit in (90, 1 << 19):
        for seed in (0, 5):
            got = np.concatenate([p.hashes(seed, upto) for p in W.slices(pa.array(texts), limit)]).tolist()
            assert got == [plain(w, seed, upto) for t in texts for w in (t or "").encode().split()]


def test_hashes_take_little_more_than_the_text():
    """No array of eight bytes for each byte of the text is made, whatever the words' lengths."""
    text = " ".join("x" * (3 + i % 9) for i in range(60_000))
    (part,) = W.slices(pa.array([text]), 1 << 24)
    tracemalloc.start()
    try:
        part.hashes()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * len(text)
