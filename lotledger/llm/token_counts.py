"""Token counts of every prefix of a text, by dynamic programming over prefixes.

A sequence of tokens is what a byte-level BPE gives for its bytes exactly if each two
neighbours are what it gives for theirs. So the encoding of a prefix is the encoding of
a shorter prefix and one more token: of the tokens that end at a position (an
Aho-Corasick automaton lists them), the one that may stand behind the last token of the
prefix before it. One walk over a piece thus yields the last token, and with it the
exact number of tokens, of all its prefixes; no prefix is encoded.

A text is a row of pieces, and a prefix cuts one of them. What a cut changes in the
pieces themselves is put right: a run of white space at the end of a prefix is one piece,
a contraction or a special token that isn't complete is ordinary text.

``prefix_counts`` stores one array a row: entry i is the number of tokens of the first i
code points, as the library gives them for that prefix (special tokens found as it does
by default, none added). Native columns then answer questions without encoding anything:
``total``, ``of_prefix``, ``longest_within``, ``truncated``, ``over``.

Counts aren't monotone: a longer prefix may take fewer tokens. ``longest_within`` is the
longest prefix of at most so many tokens.

Defined results: null text counts as empty, an empty text has the array [0]; repeated
rows get equal arrays; an empty table gives an empty result; further columns pass
through, one named like the added column is replaced. Texts of any length are taken
whole; beside its array a long text needs the pieces of the text in memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.llm.bytelevel import LONG_SHORT, WHITE, ByteLevel, byte_level, plain_pieces
from lotledger.llm.columns import add_columns

SLICE_CHARS = 1 << 20
#: Pieces that are spread over their code points at once.
SPREAD_PIECES = 1 << 17
#: Entries of a worker's memories before they are emptied; speed only.
KNOWN_PIECES = 600_000
KNOWN_PAIRS = 1_000_000
#: Pieces of up to so many bytes are counted together, so many at once.
SHORT_BYTES = 32
SHORT_ROWS = 1 << 14

_STARTS_WHITE = re.compile(f"[{WHITE}]")
_ALL_WHITE = re.compile(f"[{WHITE}]+")


class _Trie:
    """Tokens by their bytes, as sorted edges: state * 256 + byte leads to ``target``."""

    def __init__(self, tokens: dict[int, bytes]):
        children: list[dict[int, int]] = [{}]
        token_of = [-1]
        for token, data in tokens.items():
            state = 0
            for byte in data:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    token_of.append(-1)
                state = children[state][byte]
            token_of[state] = token
        edges = sorted((state * 256 + byte, to) for state, out in enumerate(children) for byte, to in out.items())
        self.edge = np.array([e[0] for e in edges], np.int64)
        self.target = np.array([e[1] for e in edges], np.int64)
        self.token = np.array(token_of, np.int64)


class PrefixCounter:
    """The dynamic program, with what it has found about pieces and pairs of tokens."""

    def __init__(self, vocab: ByteLevel):
        self.vocab = vocab
        self.trie = _Trie(vocab.token_bytes)
        self.ending = ahocorasick.Automaton()
        for i, b in vocab.token_bytes.items():
            self.ending.add_word(b.decode("latin-1"), (i, len(b)))
        self.ending.make_automaton()
        self._made = {new: (rank, *pair) for pair, (rank, new) in vocab.merges.items()}
        self._pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {"": 0}
        self._flat = np.zeros(1 << 16, np.int32)  # counts of the prefixes of all known pieces
        self._end = np.ones(1 << 14, np.int64)  # where a piece's counts end there; the empty piece has one
        self._kind = np.zeros(1 << 14, np.int8)  # 1: starts with white space, 2: is white space

    def _together(self, left: int, right: int) -> bool:
        """Is [left, right] the encoding of its bytes? For left -1: is [right]?

        It isn't if a merge across the border comes before those that have made the tokens at the
        border part of larger ones. So the two are taken apart in reverse order of their merges, and
        each pair that ever met at the border is looked up. Of equal merges the leftmost is first.
        """
        if left < 0:
            return self.vocab.merge(self.vocab.token_bytes[right]) == [right]
        merges, made, never = self.vocab.merges, self._made, (-1, -1, -1)
        left_until = right_until = len(merges)
        while True:
            across = merges.get((left, right))
            if across is not None and across[0] < left_until and across[0] <= right_until:
                return False
            of_left, of_right = made.get(left, never), made.get(right, never)
            if of_left[0] > of_right[0]:
                left_until, left = of_left[0], of_left[2]
            elif of_right[0] >= 0:
                right_until, right = of_right[0], of_right[1]
            else:
                return True

    def _stands(self, pair: int) -> bool:
        """``_together`` with a memory; a pair is (left + 1) << 32 | right."""
        good = self._pairs.get(pair)
        if good is None:
            if len(self._pairs) >= KNOWN_PAIRS:
                self._pairs.clear()
            good = self._pairs[pair] = self._together((pair >> 32) - 1, pair & 0xFFFFFFFF)
        return good

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of one piece's bytes, the empty one first."""
        counts, last = [0] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (token, length) in self.ending.iter(data.decode("latin-1")):
            at = end + 1
            if not counts[at] and self._stands(last[at - length] << 32 | token):
                counts[at], last[at] = counts[at - length] + 1, token + 1
        return counts

    def _short_prefixes(self, pieces: list[bytes]) -> np.ndarray:
        """The same for many short pieces at once, one row each: position by position, for all
        tokens that are under way at once."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        width = int(lengths[order[0]])
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(pieces), width)
        counts, last = np.zeros((len(pieces), width + 1), np.int32), np.zeros((len(pieces), width + 1), np.int64)
        row = start = state = np.zeros(0, np.int64)
        for at in range(1, width + 1):
            m = int(np.searchsorted(-lengths[order], -at, "right"))
            held = row < m
            row = np.concatenate([row[held], np.arange(m)])
            start = np.concatenate([start[held], np.full(m, at - 1)])
            state = np.concatenate([state[held], np.zeros(m, np.int64)])
            key = state * 256 + data[row, at - 1]
            edge = np.minimum(np.searchsorted(self.trie.edge, key), len(self.trie.edge) - 1)
            on = self.trie.edge[edge] == key
            row, start, state = row[on], start[on], self.trie.target[edge[on]]
            token = self.trie.token[state]
            ends = np.flatnonzero(token >= 0)
            r, s, token = row[ends], start[ends], token[ends]
            pairs, which = np.unique(last[r, s] << 32 | token, return_inverse=True)
            good = np.array([self._stands(p) for p in pairs.tolist()], bool)[which]
            r, s, token = r[good], s[good], token[good]
            counts[r, at], last[r, at] = counts[r, s] + 1, token + 1
        out = np.empty_like(counts)
        out[order] = counts
        return out

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The rows of pieces in the table of known ones; what isn't known yet is found for all at once."""
        if len(self._row) + len(pieces) > KNOWN_PIECES:
            self._forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self._row]
        if new:
            data = [p.encode("utf-8") for p in new]
            short = [i for i, d in enumerate(data) if len(d) <= SHORT_BYTES]
            tables = [None] * len(new)
            for a in range(0, len(short), SHORT_ROWS):
                some = short[a : a + SHORT_ROWS]
                for i, t in zip(some, self._short_prefixes([data[i] for i in some]), strict=True):
                    tables[i] = t[1 : len(data[i]) + 1]
            for i, (piece, d) in enumerate(zip(new, data, strict=True)):
                t = tables[i] if tables[i] is not None else np.array(self.byte_prefixes(d)[1:], np.int32)
                if len(d) > len(piece):  # only whole code points
                    b = np.frombuffer(d, np.uint8)
                    t = t[np.append(np.flatnonzero((b & 0xC0) != 0x80)[1:], len(b)) - 1]
                if piece in LONG_SHORT:  # "'r" alone is a sign and a letter
                    t = np.array([t[0], t[0] + 1, t[2]], np.int32)
                tables[i] = t
            at = len(self._row)
            upto = self._end[at - 1] + np.cumsum([len(t) for t in tables])
            while len(self._flat) < upto[-1]:
                self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
            while len(self._end) < at + len(new):
                self._end, self._kind = np.concatenate([self._end, np.zeros_like(self._end)]), np.concatenate([self._kind, np.zeros_like(self._kind)])
            self._flat[self._end[at - 1] : upto[-1]] = np.concatenate(tables)
            self._end[at : at + len(new)] = upto
            self._kind[at : at + len(new)] = [0 if not _STARTS_WHITE.match(p) else 2 if _ALL_WHITE.fullmatch(p) else 1 for p in new]
            self._row.update(zip(new, range(at, at + len(new)), strict=True))
        return np.array([self._row[p] for p in pieces], np.int64)

    def n_tokens(self, piece: str) -> int:
        row = self.rows([piece])[0]  # may replace the tables
        return int(self._flat[self._end[row] - 1])

    def texts(self, texts: list[str]) -> pa.ListArray:
        """The prefix counts of each text, from the empty prefix on."""
        pieces: list[str] = []
        starts: list[int] = []  # an empty piece stands before each text, for the empty prefix
        special: list[int] = []
        for t in texts:
            starts.append(len(pieces))
            pieces.append("")
            at = 0
            for m in self.vocab.specials.finditer(t):
                pieces += plain_pieces(t[at : m.start()])
                special.append(len(pieces))
                pieces.append(m.group())
                at = m.end()
            pieces += plain_pieces(t[at:] if at else t)
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        rows = self.rows(distinct)
        begin, flat, kind = np.append(0, self._end)[rows], self._flat, self._kind[rows][index]
        n = (self._end[rows] - begin)[index]
        full = flat[self._end[rows] - 1][index]
        full[special] = 1

        # Tokens of the same text before each piece, and the piece's place among all entries.
        place, upto = np.cumsum(n) - n, np.cumsum(full)
        begins = np.array(starts, np.int64)
        before = upto - full
        before -= np.repeat(before[begins], np.diff(np.append(begins, len(index))))
        before = before.astype(np.int32)
        parts = [np.zeros(0, np.int32)]
        for a in range(0, len(index), SPREAD_PIECES):
            k = slice(a, a + SPREAD_PIECES)
            there = np.repeat(begin[index[k]] - place[k], n[k])
            there += np.arange(place[a], place[a] + len(there))
            part = flat[there]
            part += np.repeat(before[k], n[k])
            parts.append(part)
        out = np.concatenate(parts)
        self._white_runs(out, pieces, index, kind, before, place, special)
        for i in special:
            self._open_special(out, pieces, i, before, place)
        ends = np.append(place[begins], len(out))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))

    def _white_runs(self, out, pieces, index, kind, before, place, special) -> None:
        """A prefix that ends where the last white space of a run ends has the run as one piece,
        though the next sign takes that white space away from it."""
        hit = np.flatnonzero((kind[:-1] == 2) & (kind[1:] > 0))
        hit = hit[~np.isin(hit + 1, special)]
        if not len(hit):
            return
        pairs, first, which = np.unique(index[hit].astype(np.int64) << 32 | index[hit + 1], return_index=True, return_inverse=True)
        runs = self.rows([pieces[i] + pieces[i + 1][0] for i in hit[first]])
        out[place[hit + 1]] = before[hit] + self._flat[self._end[runs] - 1][which]

    def _open_special(self, out, pieces, i, before, place) -> None:
        """Prefixes that end within a special token hold its beginning as ordinary text."""
        token, lead, at = pieces[i], "", i
        if pieces[i - 1] and pieces[i - 1] not in self.vocab.special:
            lead, at = pieces[i - 1], i - 1
        for n in range(1, len(token)):
            out[place[i] + n - 1] = before[at] + sum(map(self.n_tokens, plain_pieces(lead + token[:n])))
        out[place[i] + len(token) - 1] = before[i] + 1


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(byte_level(path))


def prefix_counts(docs: DataFrame, vocab_path: str, text: str = "text", counts: str = "prefix_tokens") -> DataFrame:
    """Every row with the token counts of all prefixes of its text."""

    def compute(batch):
        parts, slice_, size = [], [], 0
        for t in batch.column(text):
            slice_.append(t.as_py() or "")
            size += len(slice_[-1])
            if size >= SLICE_CHARS:
                parts.append(_counter(vocab_path).texts(slice_))
                slice_, size = [], 0
        if slice_ or not parts:
            parts.append(_counter(vocab_path).texts(slice_))
        return {counts: pa.concat_arrays(parts)}

    return add_columns(docs, compute, {counts: "array<int>"})


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points; null beyond the text."""
    return F.get(counts, chars).cast("long")


def longest_within(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; null for a negative budget."""
    fits = F.reverse(F.transform(counts, lambda c: c <= budget))
    return F.when(budget >= 0, F.size(counts) - F.array_position(fits, True)).cast("long")


def truncated(text: Column, counts: Column, budget: Column) -> Column:
    """The longest prefix of the text of at most ``budget`` tokens."""
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), longest_within(counts, budget).cast("int"))


def over(counts: Column, limit: Column) -> Column:
    """Does the whole text take more than ``limit`` tokens?"""
    return total(counts) > limit
