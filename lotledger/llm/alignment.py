"""Alignment of two tokenizers over whole texts, by an associative monoid of fragments.

The text with a space before it is cut into tokens twice: A is a byte-level vocabulary,
B a sentencepiece model that adds that space itself. Both cover the same bytes. Where
tokens of both end at one byte, the tokens since the last such place are a closed group;
within a group each overlap of an A and a B token is a link.

A **fragment** is what a byte range (low, high] knows of that: the tokens that end in
it, as an open prefix (up to the first common end; where its group begins is unknown),
closed groups, and an open suffix (behind the last common end). Fragments of neighbouring
ranges compose: suffix and prefix join to one closed group, or, where a side has no
common end, go on being open. Composition is associative, so ranges can be worked on
anywhere and put together in any tree (``Fragment``, ``compose``).

* Texts of up to ``range_bytes`` are one range each and closed.
* Longer ones are dealt out as byte ranges over the tasks and composed in a tree of
  ``FAN`` ranges a step. A range's tokens are exact, since its stretch is encoded from a
  safe cut before it to a safe cut behind it: before a space that stands behind a sign
  other than a space and before a sign that isn't white space. No piece of B may hold
  its space mark behind another sign (checked for the model; if one does, a long text is
  encoded in one task and only its fragments are dealt out), and A begins a piece there.

Each text is encoded once, its ids are written, and both later steps read them.

Counts of id pairs (in how many documents a pair is linked) are summed within tasks
first. The pairs of highest counts, up to ``HEAD_PAIRS``, go to all tasks; links of other
pairs, which no document shares with many, are joined by pair. So no hot pair is ever
shuffled by document, and what is sent to all has a fixed bound.

Defined results: texts that are null, empty, or whose tokens don't spell the text in both
ways have no tokens: zeros and the empty string. Repeated rows are documents of their
own. An empty table gives an empty result. Further columns pass through, ones named like
an added column are replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotledger.llm.bytelevel import WHITE, byte_level
from lotledger.llm.columns import field, steps, unused
from lotledger.session import settle

RANGE_BYTES = 1 << 16
FAN = 8
HEAD_PAIRS = 1 << 20
SLICE_CHARS = 1 << 20
SLICE_BYTES = 1 << 19
#: Entries of a worker's memories before they are emptied; speed and memory only.
KNOWN_UNITS = 400_000
COUNTED_PAIRS = 1 << 20

_MARK = "\u2581"
_UNCUT = re.compile(f"^ |  | $| (?=[{WHITE}])")
_STARTS_WHITE = re.compile(f"[{WHITE}]")
_NONE = np.zeros(0, np.int64)


def units(text: str) -> list[str]:
    """A text cut at its safe cuts, without the space before each unit: joined by a space they are
    the text."""
    words = text.split(" ")
    if _UNCUT.search(text) is None:
        return words
    out = [words[0]]
    for left, right in zip(words, words[1:]):
        if left and right and not _STARTS_WHITE.match(right):
            out.append(right)
        else:
            out[-1] += " " + right
    return out


class Tokenizers:
    """Both tokenizers, and the ids of the units they have met."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_a = byte_level(a_path).token_bytes
        self.a_bytes = [of_a.get(i, b"") for i in range(max(of_a, default=0) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (self.a_bytes, self.b_bytes)]
        # A token's id with what may follow it in the written groups: its own side, or the end of it.
        signs = [(",", "|"), (",", ";")]
        self.written = pa.array([f"{i}{sign}" for x, both in zip((self.a_bytes, self.b_bytes), signs) for i in range(len(x)) for sign in both], pa.large_string())
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.stored = np.min_scalar_type(max(len(self.a_bytes), len(self.b_bytes)))
        self.cuttable = not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._ids = [np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)]
        self._end = [np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)]
        self._good = np.zeros(1 << 14, bool)

    def cut(self, text: str) -> list[str]:
        return units(text) if self.cuttable else [text]

    def _learn(self, new: list[str]) -> None:
        of_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
        of_b = self.b.encode(new, num_threads=1)
        at = len(self._row)
        while len(self._good) < at + len(new) + 1:
            self._good = np.concatenate([self._good, np.zeros_like(self._good)])
            self._end = [np.concatenate([e, np.zeros_like(e)]) for e in self._end]
        want = pa.array([" " + u for u in new], pa.large_string()).cast(pa.large_binary())
        good = np.ones(len(new), bool)
        for side, lists in enumerate((of_a, of_b)):
            ids = np.array(list(chain.from_iterable(lists)), np.int32)
            n = np.cumsum([len(x) for x in lists])
            upto = self._end[side][at] + n
            while len(self._ids[side]) < upto[-1]:
                self._ids[side] = np.concatenate([self._ids[side], np.zeros_like(self._ids[side])])
            self._ids[side][self._end[side][at] : upto[-1]] = ids
            self._end[side][at + 1 : at + len(new) + 1] = upto
            good &= _spelled(self.bytes[side].take(pa.array(ids)), n, want)
        self._good[at : at + len(new)] = good
        self._row.update(zip(new, range(at, at + len(new)), strict=True))

    def encode(self, all_units: list[str], begins: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B of all units in a row, where the texts end among them (``begins``
        tells where they begin among the units), and which texts are spelled in full."""
        coded = pa.array(all_units, pa.large_string()).dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self._row) + len(distinct) > KNOWN_UNITS:
            self._forget()
        new = [u for u in distinct if u not in self._row]
        if new:
            self._learn(new)
        rows = np.array([self._row[u] for u in distinct], np.int64)[index] if distinct else _NONE
        ids, ends = [], []
        first = np.array([*begins, len(all_units)], np.int64)
        for side in (0, 1):
            start = self._end[side][rows]
            n = self._end[side][rows + 1] - start
            upto = np.cumsum(n)
            take = np.repeat(start - (upto - n), n) + np.arange(int(upto[-1]) if len(n) else 0)
            ids.append(self._ids[side][take])
            ends.append(np.append(0, upto)[first])
        wrong = np.append(0, np.cumsum(~self._good[rows]))[first]
        return ids, ends, np.diff(wrong) == 0


def _spelled(tokens: pa.LargeBinaryArray, upto: np.ndarray, want: pa.LargeBinaryArray) -> np.ndarray:
    """Which texts their tokens spell; text i has the tokens up to ``upto[i]``."""
    _, at, data = tokens.buffers()
    at = np.frombuffer(at, np.int64)[np.append(0, upto)]
    _, place, text = want.buffers()
    place = np.frombuffer(place, np.int64)[: len(want) + 1]
    data, text = memoryview(data)[: at[-1]], memoryview(text)[: place[-1]]
    if np.array_equal(at, place) and data == text:
        return np.ones(len(want), bool)
    return np.array([data[a:b] == text[c:d] for a, b, c, d in zip(at[:-1], at[1:], place[:-1], place[1:])], bool)


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _closed(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B there are up to each common end. Ends are in order; tokens
    without bytes share the end of the one before."""
    if not len(a_ends) or not len(b_ends):
        return _NONE, _NONE
    last = np.append(a_ends[1:] != a_ends[:-1], True)
    upto = np.searchsorted(b_ends, a_ends, "right")
    common = np.flatnonzero(last & (b_ends[np.maximum(upto, 1) - 1] == a_ends))
    return common + 1, upto[common]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (A, B) of all pairs of tokens whose bytes overlap; both cover the same bytes."""
    a_from, b_from = np.append(0, a_ends)[:-1], np.append(0, b_ends)[:-1]
    low = np.searchsorted(b_ends, a_from, "right")
    high = np.searchsorted(b_from, a_ends, "left")
    n = np.where(a_ends > a_from, np.maximum(high - low, 0), 0)
    a = np.repeat(np.arange(len(a_ends)), n)
    b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    real = b_ends[b] > b_from[b]
    return a[real], b[real]


@dataclass
class Fragment:
    """What a byte range knows. Group i has the A tokens up to ``a_upto[i]`` and the B tokens up to
    ``b_upto[i]`` behind those of group i - 1. Group 0 is the open prefix where ``open_left``; what
    is behind the last group is the open suffix. Without a common end all tokens are suffix."""

    a: np.ndarray = dataclass_field(default_factory=lambda: _NONE)
    b: np.ndarray = dataclass_field(default_factory=lambda: _NONE)
    a_upto: np.ndarray = dataclass_field(default_factory=lambda: _NONE)
    b_upto: np.ndarray = dataclass_field(default_factory=lambda: _NONE)
    open_left: bool = True

    @classmethod
    def of_range(cls, a, b, a_ends, b_ends, low: int, high: int) -> Fragment:
        """The fragment of (low, high] from tokens of a stretch and where they end in it."""
        i, j = (slice(*np.searchsorted(e, [low, high], "right")) for e in (a_ends, b_ends))
        return cls(a[i], b[j], *_closed(a_ends[i], b_ends[j]), low > 0)

    @property
    def groups(self) -> list[tuple[list[int], list[int]]]:
        """Groups as lists of ids, the open prefix first if there is one."""
        return [
            (self.a[i:k].tolist(), self.b[j:m].tolist())
            for i, k, j, m in zip(np.append(0, self.a_upto), self.a_upto, np.append(0, self.b_upto), self.b_upto)
        ]


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. The common ends of both stay; the group between the
    left's last and the right's first of them joins suffix and prefix by itself."""
    return Fragment(
        np.concatenate([left.a, right.a]), np.concatenate([left.b, right.b]),
        np.concatenate([left.a_upto, right.a_upto + len(left.a)]), np.concatenate([left.b_upto, right.b_upto + len(left.b)]),
        left.open_left,
    )


class Batch:
    """Aligned texts in a row: ids, where tokens, groups and links end, and links as pairs of ids.
    Texts that are one range each are found closed by their common ends alone."""

    def __init__(self, t: Tokenizers, a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray, closed=None):
        self.t, self.a, self.b, self.a_upto, self.b_upto = t, a, b, a_upto, b_upto
        a_ends, b_ends = np.cumsum(t.a_length[a]), np.cumsum(t.b_length[b])
        self.group_a, self.group_b = closed or _closed(a_ends, b_ends)
        of_a, of_b = links(a_ends, b_ends)
        pairs = pa.array(a[of_a].astype(np.int64) << 32 | b[of_b]).dictionary_encode()
        #: Distinct pairs, and which of them each link is.
        self.pairs, self.which = pairs.dictionary.to_numpy(), pairs.indices.to_numpy().astype(np.int64)
        self.group_upto = np.searchsorted(self.group_a, a_upto, "right")
        self.link_upto = np.searchsorted(of_a, a_upto, "left")

    def documents(self) -> np.ndarray:
        """In how many texts each distinct pair is linked."""
        doc = np.repeat(np.arange(len(self.link_upto)), np.diff(np.append(0, self.link_upto)))
        key = np.sort(doc * max(len(self.pairs), 1) + self.which)
        return np.bincount(key[np.append(True, key[1:] != key[:-1])[: len(key)]] % max(len(self.pairs), 1), minlength=len(self.pairs))

    def groups(self) -> list[bytes]:
        """The groups of each text: its A ids, a bar, its B ids; groups by semicolons."""
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[self.group_a - 1], ends_b[self.group_b - 1] = 1, 1
        n_a, n_b = np.diff(np.append(0, self.group_a)), np.diff(np.append(0, self.group_b))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        # A token stands behind all tokens of the groups before and of its own side before it.
        code[np.arange(len(self.a)) + np.repeat(self.group_b - n_b, n_a)] = 2 * self.a.astype(np.int64) + ends_a
        code[np.arange(len(self.b)) + np.repeat(self.group_a, n_b)] = 2 * (len(self.t.a_bytes) + self.b.astype(np.int64)) + ends_b
        _, at, data = self.t.written.take(pa.array(code)).buffers()
        upto = np.frombuffer(at, np.int64)[np.append(0, self.a_upto + self.b_upto)].tolist()
        return [bytes(memoryview(data)[x : max(x, y - 1)]) for x, y in zip(upto, upto[1:])]


def _encoded(t: Tokenizers, texts: list[str]):
    all_units: list[str] = []
    begins: list[int] = []
    for x in texts:
        begins.append(len(all_units))
        if x:
            all_units += t.cut(x)
    ids, ends, good = t.encode(all_units, begins)
    out = []
    for side in (0, 1):
        n = np.diff(ends[side])
        out.append((ids[side][np.repeat(good, n)], np.cumsum(np.where(good, n, 0))))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    at, some, size = 0, [], 0
    for i, t in enumerate(texts):
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= SLICE_CHARS:
            yield at, some
            at, some, size = i + 1, [], 0
    if some:
        yield at, some


_RANGE = "range_no long, low long, high long, stretch string"
_FRAGMENT = "range_no long, good boolean, open_left boolean, a array<int>, b array<int>, a_upto array<int>, b_upto array<int>"


def ranges(text: str, range_bytes: int, cut=units) -> Iterator[tuple[int, int, int, str]]:
    """(number, low, high, stretch) of the byte ranges of a text with a space before it: the units
    that the range touches, and where it begins and ends among their bytes. A unit longer than a
    range is not cut; its range reaches to its end."""
    text_units = cut(text)
    ends = np.cumsum([len(u.encode()) + 1 for u in text_units])
    size, low, no = int(ends[-1]), 0, 0
    while low < size:
        high = min(low + range_bytes, size)
        first, last = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left"))
        if int(ends[last]) - (int(ends[last - 1]) if last else 0) > range_bytes:
            high = int(ends[last])
        start = int(ends[first - 1]) if first else 0
        yield no, low - start, high - start, " ".join(text_units[first : last + 1])
        low, no = high, no + 1


def _dealt(docs: DataFrame, key: str, text: str, pair: tuple[str, str], range_bytes: int) -> DataFrame:
    """The byte ranges of texts, one a row, dealt out over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                for no, low, high, stretch in ranges(t.as_py(), range_bytes, _tokenizers(*pair).cut):
                    yield pa.RecordBatch.from_pylist([{key: k.as_py(), "range_no": no, "low": low, "high": high, "stretch": stretch}], pa.schema([(key, pa.int64()), ("range_no", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("stretch", pa.string())]))

    return docs.select(key, text).mapInArrow(run, f"{key} long, {_RANGE}").repartition(key, "range_no")


def _arrow(key: str) -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([(key, pa.int64()), ("range_no", pa.int64()), ("good", pa.bool_()), ("open_left", pa.bool_()), ("a", ints), ("b", ints), ("a_upto", ints), ("b_upto", ints)])


def _fragment_row(key: str, k: int, no: int, good: bool, f: Fragment) -> pa.RecordBatch:
    row = {key: k, "range_no": no, "good": good, "open_left": f.open_left, "a": f.a, "b": f.b, "a_upto": f.a_upto, "b_upto": f.b_upto}
    row = {n: v.astype(np.int32) if isinstance(v, np.ndarray) else v for n, v in row.items()}
    return pa.RecordBatch.from_arrays([pa.array([row[c.name]], c.type) for c in _arrow(key)], schema=_arrow(key))


def long_fragments(docs: DataFrame, key: str, text: str, pair: tuple[str, str], range_bytes: int, fan: int = FAN, fragment: str = "fragment") -> DataFrame:
    """(key, fragment) of each long text: fragments of its byte ranges, composed in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(*pair)
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, good = t.encode(t.cut(row["stretch"]), [0])
                a_ends, b_ends = np.cumsum(t.a_length[ids[0]]), np.cumsum(t.b_length[ids[1]])
                f = Fragment.of_range(*ids, a_ends, b_ends, row["low"], row["high"]) if good[0] else Fragment()
                f.open_left = row["range_no"] > 0
                yield _fragment_row(key, row[key], row["range_no"], bool(good[0]), f)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole, good = None, True
                for p in row["parts"]:
                    f = Fragment(*(np.array(p[c], np.int64) for c in ("a", "b", "a_upto", "b_upto")), p["open_left"])
                    whole, good = f if whole is None else compose(whole, f), good and p["good"]
                yield _fragment_row(key, row[key], row["range_no"], good, whole)

    parts = settle(_dealt(docs, key, text, pair, range_bytes).mapInArrow(run, f"{key} long, {_FRAGMENT}"))
    most = parts.agg(F.max("range_no")).first()[0] or 0
    names = [c for c in parts.columns if c not in (key, "range_no")]
    while most:
        grouped = parts.groupBy(key, F.expr(f"range_no div {fan}").alias("range_no")).agg(F.sort_array(F.collect_list(F.struct("range_no", *names))).alias("parts"))
        parts, most = grouped.mapInArrow(reduce, f"{key} long, {_FRAGMENT}"), most // fan
    return parts.select(key, F.struct("good", "a", "b", "a_upto", "b_upto").alias(fragment))


def _id_batches(batch: pa.RecordBatch, t: Tokenizers, ids: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Rows of written ids, some ``SLICE_BYTES`` of A at a time."""
    part = np.cumsum(pc.binary_length(batch.column(ids[0])).to_numpy().astype(np.int64)) // SLICE_BYTES
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    for i, k in zip(begins.tolist(), np.append(begins[1:], len(part)).tolist()):
        rows = batch.slice(i, k - i)
        written = [rows.column(c).to_pylist() for c in ids]
        of_a, of_b = (np.frombuffer(b"".join(w), t.stored).astype(np.int32) for w in written)
        yield rows, Batch(t, of_a, of_b, *(np.cumsum([len(x) // t.stored.itemsize for x in w]) for w in written))


def _row_batches(batch: pa.RecordBatch, t: Tokenizers, fragment: str) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """One composed fragment at a time; one that isn't spelled in full has no tokens."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        f = row.column(fragment)[0]
        a, b, a_upto, b_upto = (f[c].values.to_numpy() if f["good"].as_py() else _NONE for c in ("a", "b", "a_upto", "b_upto"))
        yield row, Batch(t, a, b, np.array([len(a)]), np.array([len(b)]), (a_upto, b_upto))


def _encode(names: list[str], text: str, ids: tuple[str, str], pair: tuple[str, str]):
    """Rows with the ids of their texts in place of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(*pair)
        for batch in batches:
            for at, some in _slices(batch.column(text)):
                a, b, a_upto, b_upto = _encoded(t, some)
                lists = []
                for x, upto in ((a, a_upto), (b, b_upto)):
                    data, at_byte = memoryview(x.astype(t.stored)).cast("B"), (np.append(0, upto) * t.stored.itemsize).tolist()
                    lists.append(pa.array([bytes(data[i:k]) for i, k in zip(at_byte, at_byte[1:])], pa.binary()))
                rows = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *lists], names=[*names, *ids])

    return run


def _counted(df: DataFrame, aligned, source, pair: tuple[str, str]) -> DataFrame:
    """(a, b, n) summed within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, found, held = _tokenizers(*pair), [], 0

        def out() -> pa.RecordBatch:
            keys, n = _summed(found)
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for _, x in aligned(batch, t, source):
                found.append((x.pairs, x.documents()))
                held += len(found[-1][0])
                if held > COUNTED_PAIRS:
                    found = [_summed(found)]
                    held = len(found[0][0])
                    if held > COUNTED_PAIRS // 2:
                        yield out()
                        found, held = [], 0
        yield out()

    return df.mapInArrow(run, "a int, b int, n long")


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([_NONE, *(f[0] for f in found)]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, which, np.concatenate([_NONE, *(f[1] for f in found)]))
    return keys, n


class _Head:
    """Counts of the pairs that all tasks hold, in order of pairs."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, best: np.ndarray):
        self.keys, self.n, self.best = keys, n, best

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        held = self.keys[at] == pairs
        return held, np.where(held, self.n[at], 0), held & self.best[at]


def _head(counts: DataFrame, head_pairs: int) -> tuple[_Head, int]:
    """The pairs of highest counts, at most ``head_pairs``, and how many others there are. Counts are told apart by steps of an eighth of a power of two, so few rows decide."""
    step = F.floor(F.log2(F.col("n")) * 8)
    held, lowest = 0, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if held + row["count"] > head_pairs:
            break
        held, lowest = held + row["count"], row["step"]
    if lowest is None:
        return _Head(_NONE, _NONE, np.zeros(0, bool)), counts.count()
    table = counts.filter(step >= lowest).select(F.expr("shiftleft(cast(a as bigint), 32) | cast(b as bigint)").alias("key"), "n", "best").toArrow()
    key, n, best = (table.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(key)
    return _Head(key[order], n[order], best[order]), counts.filter(step < lowest).count()


_ADDED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", groups: str | None = None, range_bytes: int = RANGE_BYTES,
          head_pairs: int = HEAD_PAIRS, fan: int = FAN) -> DataFrame:
    """Every row with its counts of tokens, groups and links, the links that are the best of their A
    id, the sum of their pairs' counts and a digest of the groups; with ``groups``, also the groups
    themselves in a column of that name."""
    pair = (a_path, b_path)
    added = _ADDED | ({groups: "string"} if groups else {})
    docs = docs.drop(*added)
    long_text = F.coalesce(F.octet_length(text) >= range_bytes, F.lit(False))
    key, fragment = unused(docs, "row"), unused(docs, "fragment")
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]
    ids = unused(docs, "a"), unused(docs, "b")
    # Ids are written once (two bytes a token where both vocabularies allow it); counts and results are read from them.
    short, long = settle(docs.filter(~long_text).mapInArrow(_encode(names, text, ids, pair), T.StructType([*kept, *(field(c, "binary") for c in ids)]))), None
    found = _counted(short.select(*ids), _id_batches, ids, pair)
    # Rows of long texts get a number in a written table, which no lost executor changes.
    numbered = settle(docs.filter(long_text).withColumn(key, F.monotonically_increasing_id()))
    if not numbered.isEmpty():
        long = settle(numbered.drop(text).join(long_fragments(numbered, key, text, pair, range_bytes, fan, fragment), key))
        found = found.unionByName(_counted(long.select(fragment), _row_batches, fragment, pair))
    counts = settle(found.groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = settle(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    head, rest = _head(counts, head_pairs)
    held = docs.sparkSession.sparkContext.broadcast(head)

    tail = unused(docs, "tail")
    schema = T.StructType([*kept, *(field(k, v) for k, v in added.items()), field(tail, "array<struct<a:int,b:int,times:long>>")])

    def results(aligned, source):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = _tokenizers(*pair)
            for batch in batches:
                for part in steps([batch]):
                    for rows, x in aligned(part, t, source):
                        yield _results(rows, x)

        return run

    def _results(rows: pa.RecordBatch, x: Batch) -> pa.RecordBatch:
        known, n, best = (v[x.which] for v in held.value.find(x.pairs))
        per = lambda v: np.diff(np.append(0, np.append(0, np.cumsum(v))[x.link_upto]))
        n_a = np.diff(np.append(0, x.a_upto))
        texts = x.groups()
        sha = [hashlib.sha256(s).hexdigest() if n else "" for s, n in zip(texts, n_a.tolist())]
        doc = np.repeat(np.arange(rows.num_rows), np.diff(np.append(0, x.link_upto)))[~known]
        pairs, times = np.unique(np.stack([doc, x.pairs[x.which[~known]]]), axis=1, return_counts=True) if len(doc) else (np.zeros((2, 0), np.int64), _NONE)
        tails = pa.StructArray.from_arrays([pa.array((pairs[1] >> 32).astype(np.int32)), pa.array((pairs[1] & 0xFFFFFFFF).astype(np.int32)), pa.array(times.astype(np.int64))], names=["a", "b", "times"])
        upto = pa.array(np.append(0, np.cumsum(np.bincount(pairs[0], minlength=rows.num_rows))), pa.int32())
        values = [n_a, np.diff(np.append(0, x.b_upto)), np.diff(np.append(0, x.group_upto)), np.diff(np.append(0, x.link_upto)), per(best), per(n)]
        return pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in names), *(pa.array(v, pa.int64()) for v in values), pa.array(sha, pa.string()), *([pa.array([s.decode() for s in texts], pa.string())] if groups else []), pa.ListArray.from_arrays(upto, tails)],
            names=[f.name for f in schema.fields],
        )

    out = short.mapInArrow(results(_id_batches, ids), schema)
    if long is not None:
        out = out.unionByName(long.mapInArrow(results(_row_batches, fragment), schema))
    if rest:
        out = _with_tail(out, counts, head, tail)
    return out.drop(tail)


def _with_tail(out: DataFrame, counts: DataFrame, head: _Head, tail: str) -> DataFrame:
    """Adds what the links of pairs outside the head are worth, joined by pair."""
    row = unused(out, "row")
    out = settle(out.withColumn(row, F.monotonically_increasing_id()))
    pairs = out.select(row, F.explode(tail).alias("t")).select(row, F.col("t.a").alias("a"), F.col("t.b").alias("b"), "t.times")
    # Pairs of the head never come up here, so that no pair has many documents.
    worth = pairs.join(counts, ["a", "b"]).groupBy(row).agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    joined = out.join(worth, row, "left")
    return joined.withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
    }).drop("_sum", "_best", row)
