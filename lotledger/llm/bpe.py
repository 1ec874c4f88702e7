"""Byte-level BPE encoding and decoding through a memory-mapped word lexicon.

A text is cut into pieces as the vocabulary file says (special tokens first, then
canonical composition, lower case, pieces of letters, single digits, runs of
other signs). Ids of a piece come from one of two exact ways:

* the lexicon: the corpus's most frequent pieces, compiled into a minimal acyclic
  transducer. Its states share prefixes and suffixes; each edge carries how many
  pieces are skipped by taking it, so the sum along a path is the piece's place
  in the table of id sequences. It is a flat file that workers memory-map, and it
  is walked for all distinct pieces of a slice at once;
* merging: a piece that the lexicon doesn't hold is merged pair by pair, lowest
  rank first and then leftmost, with a heap, so a piece of n bytes takes
  O(n log n).

Pieces are counted over all texts. ``lexicon_pieces`` bounds the lexicon and so
what is compiled and sent; it decides speed only, both ways give the same ids.

Defined results: null text counts as empty, an empty text has no ids and decodes
to the empty string; a null id list decodes to null; ids without a token are left
out in decoding; repeated rows get equal ids; an empty table gives an empty
result; further columns pass through, ones named like an added column are
replaced.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm.columns import add_columns

LEXICON_PIECES = 1 << 16
SLICE_CHARS = 1 << 20
FLUSH_PIECES = 200_000

# Fixed values of the vocabulary format: white space, and the pieces of a text.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids |= self.special
        end, signs = model["end_of_word_suffix"] or "", _byte_signs()
        self.inner = [ids[s] for s in signs]
        self.last = [ids[s + end] for s in signs]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.tokens: list[str | None] = [None] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")

    def pieces(self, text: str) -> list[str]:
        found = self.specials.search(text)
        if found is None:
            return _plain_pieces(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += _plain_pieces(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + _plain_pieces(text[at:])

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece by exact merging."""
        if piece in self.special:
            return [self.special[piece]]
        data = piece.encode("utf-8")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


def _plain_pieces(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_PIECE.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    # Lower case sign by sign: a final sigma is no special case.
    return _PIECE.findall(text.replace("Σ", "σ").lower())


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """The transducer over flat arrays, in memory or memory-mapped.

    ``edge`` holds state * 256 + byte in order, ``target`` and ``skip`` what the edge leads to
    and skips; ``final`` marks accepting states; ``offset`` and ``ids`` are the id sequences.
    """

    PARTS = ("edge", "target", "skip", "final", "offset", "ids")
    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32)

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        for name in self.PARTS:
            setattr(self, name, parts[name])

    @classmethod
    def compile(cls, entries: list[tuple[bytes, list[int]]]) -> Lexicon:
        """From (piece, ids) in order of pieces, without repeats."""
        edges, finals, counts = _minimal([e[0] for e in entries])
        key, target, skip = [], [], []
        for state, out in enumerate(edges):
            seen = int(finals[state])
            for byte, to in out:
                key.append(state * 256 + byte)
                target.append(to)
                skip.append(seen)
                seen += counts[to]
        lengths = [len(e[1]) for e in entries]
        return cls({
            "edge": np.array(key, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
            "final": np.array(finals, np.uint8), "offset": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            "ids": np.array([i for e in entries for i in e[1]], np.int32),
        })

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(self.parts[n]) for n in self.PARTS], np.int64).tobytes())
            for n in self.PARTS:
                f.write(self.parts[n].tobytes().ljust(-(-self.parts[n].nbytes // 8) * 8, b"\0"))

    @classmethod
    def map(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.uint8, "r")
        sizes, at, parts = whole[: 8 * len(cls.PARTS)].view(np.int64), 8 * len(cls.PARTS), {}
        for name, kind, n in zip(cls.PARTS, cls.KINDS, sizes, strict=True):
            nbytes = int(n) * np.dtype(kind).itemsize
            parts[name] = whole[at : at + nbytes].view(kind)
            at += -(-nbytes // 8) * 8
        return cls(parts)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece in the table of ids, -1 where the lexicon lacks it."""
        column = pieces.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        out = np.full(len(column), -1, np.int64)
        if not len(self.edge) or not len(column):
            return out
        data = np.frombuffer(data, np.uint8)
        at, left = offsets[:-1].copy(), np.diff(offsets)
        rows = np.arange(len(column))
        state, place = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        while len(rows):
            done = left == 0
            if done.any():
                good = done & (self.final[state] > 0)
                out[rows[good]] = place[good]
                rows, state, place, at, left = (x[~done] for x in (rows, state, place, at, left))
                if not len(rows):
                    break
            key = state * 256 + data[at]
            e = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            known = self.edge[e] == key
            rows, e, at, left, place = rows[known], e[known], at[known] + 1, left[known] - 1, place[known]
            state, place = self.target[e].astype(np.int64), place + self.skip[e]
        return out


def _minimal(words: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool], list[int]]:
    """The minimal acyclic automaton of words in order, built word by word: the path of the
    word before, past the common prefix, is folded into equal states from its end. Returns
    edges by state (0 starts), accepting states and how many words lead from each."""
    edges: list[list[tuple[int, int]]] = []
    finals: list[bool] = []
    counts: list[int] = []
    register: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # open states along the last word: accepting, edges
    last = b""

    def settle_state(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(edges)
            edges.append(state[1])
            finals.append(state[0])
            counts.append(int(state[0]) + sum(counts[to] for _, to in state[1]))
        return register[key]

    for word in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for i in range(len(last), common, -1):
            to = settle_state(path.pop())
            path[-1][1].append((last[i - 1], to))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        to = settle_state(path.pop())
        path[-1][1].append((last[i - 1], to))
    start = len(edges)
    edges.append(path[0][1])
    finals.append(path[0][0])
    # The start becomes state 0.
    turn = lambda s: 0 if s == start else s + 1
    return (
        [[(b, turn(t)) for b, t in edges[start]], *([(b, turn(t)) for b, t in e] for e in edges[:start])],
        [finals[start], *finals[:start]],
        [len(words), *counts],
    )


class Encoder:
    """Encodes columns of texts, with the lexicon if there is one."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocab, lexicon
        self._merged: dict[str, list[int]] = {}

    def _merge(self, piece: str) -> list[int]:
        if piece not in self._merged:
            if len(self._merged) >= FLUSH_PIECES:
                self._merged.clear()
            self._merged[piece] = self.vocab.merge(piece)
        return self._merged[piece]

    def _slice(self, texts: list[str]) -> pa.ListArray:
        pieces: list[str] = []
        ends = [0]
        for t in texts:
            pieces += self.vocab.pieces(t)
            ends.append(len(pieces))
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        places = self.lexicon.places(distinct) if self.lexicon else np.full(len(distinct), -1)
        missing = np.flatnonzero(places < 0)
        merged = [self._merge(distinct[int(i)].as_py()) for i in missing]
        # One table: the lexicon's ids, then those of the slice's merged pieces.
        known = self.lexicon.ids if self.lexicon else np.zeros(0, np.int32)
        start, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        held = places >= 0
        if held.any():
            start[held] = self.lexicon.offset[places[held]]
            length[held] = self.lexicon.offset[places[held] + 1] - start[held]
        lengths = np.array([len(m) for m in merged], np.int64)
        start[missing] = len(known) + np.cumsum(lengths) - lengths
        length[missing] = lengths
        table = np.concatenate([known, np.array([i for m in merged for i in m], np.int32)])
        n = length[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(upto[-1]) + np.repeat(start[index] - upto[:-1], n)
        return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(table[take], pa.int32()))

    def encode(self, texts: pa.Array) -> pa.Array:
        parts, slice_, size = [], [], 0
        for t in texts:
            slice_.append(t.as_py() or "")
            size += len(slice_[-1])
            if size >= SLICE_CHARS:
                parts.append(self._slice(slice_))
                slice_, size = [], 0
        if slice_ or not parts:
            parts.append(self._slice(slice_))
        return pa.concat_arrays(parts)


def piece_counts(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """(piece, n) over all texts, counted within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, counts = vocabulary(vocab_path), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])
        for batch in batches:
            for t in batch.column(0):
                counts.update(vocab.pieces(t.as_py() or ""))
                if len(counts) >= FLUSH_PIECES:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocab_path: str, text: str = "text", lexicon_pieces: int = LEXICON_PIECES) -> str:
    """Compile the corpus's ``lexicon_pieces`` most frequent pieces; their ids are merged on
    the executors. Adds the file to the job's files and returns its name."""
    top = piece_counts(docs, vocab_path, text).orderBy(F.desc("n"), "piece").limit(lexicon_pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.encode() for p in pieces], pa.binary()), pa.array([vocab.merge(p) for p in pieces], pa.list_(pa.int32()))], names=["piece", "ids"]
            )

    rows = top.select("piece").mapInArrow(run, "piece binary, ids array<int>").collect()
    lexicon = Lexicon.compile(sorted((bytes(r["piece"]), r["ids"]) for r in rows))
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    lexicon.write(path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


@lru_cache(maxsize=2)
def _encoder(vocab_path: str, name: str | None) -> Encoder:
    return Encoder(vocabulary(vocab_path), Lexicon.map(SparkFiles.get(name)) if name else None)


def encode(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", lexicon_pieces: int = LEXICON_PIECES,
           decoded: str | None = None) -> DataFrame:
    """Every row with the ids of its whole text, and with what they decode to if ``decoded`` names
    a column for it: one pass then does both."""
    name = build_lexicon(docs, vocab_path, text, lexicon_pieces)

    def compute(batch):
        out = {ids: _encoder(vocab_path, name).encode(batch.column(text))}
        return out | {decoded: _decoded(out[ids], vocab_path)} if decoded else out

    return add_columns(docs, compute, {ids: "array<int>"} | ({decoded: "string"} if decoded else {}))


@lru_cache(maxsize=2)
def _token_column(vocab_path: str) -> pa.Array:
    return pa.array(vocabulary(vocab_path).tokens, pa.string())


def _decoded(column: pa.Array, vocab_path: str) -> pa.Array:
    tokens, index = _token_column(vocab_path), pc.list_flatten(column)
    known = pc.and_kleene(pc.greater_equal(index, 0), pc.less(index, len(tokens)))
    found = tokens.take(pc.if_else(known, index, None))
    parent = pc.list_parent_indices(column).to_numpy()
    good = pc.is_valid(found).to_numpy(zero_copy_only=False)
    counts = np.bincount(parent[good], minlength=len(column)) if len(column) else np.zeros(0, np.int64)
    upto = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(upto, found.filter(pa.array(good))), " ")
    return pc.if_else(pc.is_null(column), pa.scalar(None, pa.string()), joined)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the text of its ids: their tokens joined by a space, special ones too."""

    return add_columns(df, lambda batch: {decoded: _decoded(batch.column(ids), vocab_path)}, {decoded: "string"})
