"""Words, their hashes and word shingles of Arrow text columns, in numpy.

A word is a longest run of characters other than the six ASCII spaces
(U+0020, U+0009 to U+000D). Everything works on the UTF-8 bytes of a slice of a
column, so cost and memory follow the bytes and no Python object is made per
word. Slices are bounded by bytes; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

#: Bytes of a word that are hashed one place at a time over all words.
HEAD = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix64(steps) | np.uint64(1)


@dataclass
class Slice:
    """Neighbouring texts. Word i lies at bytes starts[i]:ends[i]; the words of text
    d are first[d]:first[d + 1]."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self, seed: int = 0, upto: int | None = None) -> np.ndarray:
        """A 64-bit multilinear hash of each word's bytes, or of its first ``upto`` bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        factors = stream(int(length.max()) + 1, seed)
        if upto is not None:
            length = np.minimum(length, upto)
        # Byte by byte over the words that have it, longer words first; what lies beyond HEAD in one go.
        head = np.minimum(length, HEAD + 1)
        order = np.argsort((HEAD + 1 - head).astype(np.uint8), kind="stable")
        at, length = self.starts[order], length[order]
        longer = len(at) - np.cumsum(np.bincount(head, minlength=HEAD + 2))
        total = np.zeros(len(at), np.uint64)
        for j, n in enumerate(longer[: min(HEAD, int(head.max()))].tolist()):
            total[:n] += (self.data[at[:n] + j].astype(np.uint64) + np.uint64(1)) * factors[j]
        if n := int(longer[HEAD]):
            rest = length[:n] - HEAD
            begin = np.cumsum(rest) - rest
            place = np.arange(HEAD, HEAD + int(rest.sum())) - np.repeat(begin, rest)
            bytes_ = self.data[np.repeat(at[:n], rest) + place]
            total[:n] += np.add.reduceat((bytes_.astype(np.uint64) + np.uint64(1)) * factors[place], begin)
        out = np.empty(len(at), np.uint64)
        out[order] = total
        return mix64(out)

    def shingles(self, words: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``size`` words inside one text."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        factors = stream(size, seed ^ 0x5851F42D4C957F2D)
        total = words[:n] * factors[0]
        for j in range(1, size):
            total += words[j : n + j] * factors[j]
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + size <= last[:n])
        return at, mix64(total[at])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of about ``limit`` bytes; null counts as empty."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        here = offsets[row : upto + 1]
        yield _slice(row, data[here[0] : here[-1]], here - here[0])
        row = upto


def _slice(row: int, data: np.ndarray, offsets: np.ndarray) -> Slice:
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], ~inside[:-1]])[: len(data)] | edge[:-1]
    after = np.concatenate([~inside[1:], [True]])[: len(data)] | edge[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return Slice(row, data, offsets, starts, ends, np.searchsorted(starts, offsets))
