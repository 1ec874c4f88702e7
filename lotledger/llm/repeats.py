"""Repeated passages: windows of 13 words that also start in an earlier document.

A word of a document is removed if a window of ``WINDOW`` consecutive words covers
it whose word sequence also starts in a document with a smaller id. Windows are
judged on the input.

1. Anchors. The anchor of a window is the smallest hash of the five-word phrases
   in it. Equal windows have equal anchors, and neighbouring windows mostly share
   one, so a text has one anchor for about five windows. Anchors held by two
   documents or more are counted in one aggregate with a partial step.
2. Confirmation. Texts are dealt into blocks of about ``BLOCK_BYTES`` by hash, so that
   copies of one text meet. A batch sends each of its texts once, however many of its
   rows hold it, and an aggregate behind the exchange makes one text with the smallest
   id of what the batches sent, so a block's group holds its distinct texts only.
   Each block learns which of its anchors recur, and names each of its distinct
   windows with such an anchor by a 96-bit hash and one place in the block. Over
   all blocks the smallest document of each window is found; a block keeps the
   windows that one of its documents holds after another document.
3. Automata. For each block, the confirmed windows are compiled into Aho-Corasick
   automata, at most ``SHARD_WINDOWS`` windows each, with the window's first
   document as the value. All documents of the block are streamed through each
   automaton, which locates every occurrence; those after the first document
   cover their words. Words are two signs of a code made once for the block, so that
   matches begin and end on words. Words of no window lead every automaton back to its
   root, so only runs of other words, a window long at least, are read. A later copy
   of a text starts all its windows in an earlier document: its words go if it has a
   window at all.

A passage that a third of all documents hold is one partial row a task in step 1
and one row a block in step 2. An automaton is never larger than a shard, nor
larger than its block needs, however many passages the corpus repeats. Texts are
shuffled once; both passes over blocks read that exchange.

Ids are integers. Defined results: null and empty texts have no words; a null id
is neither earlier nor later than any, so nothing of its document is removed and
it removes nothing; rows with one id don't remove from each other; documents of
fewer than 13 words keep all; an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress, pairwise, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from lotledger.llm import words as W
from lotledger.llm.columns import STEP_ROWS
from lotledger.session import settle

WINDOW = 13
PHRASE = 5
BLOCK_BYTES = 3 << 19
BLOCKS_A_PARTITION = 4
SHARD_WINDOWS = 16_000

#: Signs that stand for words in an automaton: two for each word, of ranges that don't meet.
_HIGH, _LOW, _OTHER = 0x100, 0x4000, (1, 2)
_SPAN = 0x3000


def anchors(part: W.Slice, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its anchor, the words' hashes)."""
    hashes = part.hashes()
    at, grams = part.shingles(hashes, phrase, 3)
    flat = np.full(len(hashes) + window, np.iinfo(np.uint64).max, np.uint64)
    flat[at] = grams
    last = np.repeat(part.first[1:], part.counts)
    starts = np.flatnonzero(np.arange(len(hashes)) + window <= last)
    low = flat[starts].copy()
    for j in range(1, window - phrase + 1):
        np.minimum(low, flat[starts + j], out=low)
    return starts, low.view(np.int64), hashes


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of one of each distinct (a, b)."""
    # Neighbours are mostly equal, so runs go before the sort.
    at = np.flatnonzero((np.diff(a, prepend=a[:1]) != 0) | (np.diff(b, prepend=b[:1]) != 0) | (np.arange(len(a)) == 0))
    order = at[np.lexsort((a[at], b[at]))]
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[first]


def _recurring(docs: DataFrame, window: int) -> DataFrame:
    """Anchors of two rows or more (rows with one id are told apart later)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("text")):
                starts, anchor, _ = anchors(part, window)
                one = _distinct_pairs(anchor, part.owner[starts])
                yield pa.RecordBatch.from_arrays([pa.array(np.sort(anchor[one]))], names=["anchor"])

    counted = docs.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    return settle(counted.filter("n > 1").select(F.col("anchor").alias("recurring")))


def _texts(docs: DataFrame, blocks: int) -> DataFrame:
    """(k1, k2, block, id, text): the distinct texts of each batch with their smallest ids."""
    base = docs.select("id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            ids = batch.column("id")
            # By key, rows with an id first and in its order: the first row of each key stands for the text.
            order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), k2, k1))
            a, b = k1[order], k2[order]
            first = np.ones(len(order), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            chosen = order[first]
            for at in range(0, len(chosen), STEP_ROWS):
                one = batch.take(pa.array(chosen[at : at + STEP_ROWS]))
                block = pa.array((one.column("k1").to_numpy().view(np.uint64) % np.uint64(blocks)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("k1", "k2")), block, one.column("id"), one.column("text")], names=["k1", "k2", "block", "id", "text"])

    return base.mapInArrow(run, "k1 long, k2 long, block int, id long, text string")


def _block_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, block), distinct within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            for part in W.slices(batch.column("text")):
                starts, anchor, _ = anchors(part, window)
                own = block[part.row + part.owner[starts]]
                one = _distinct_pairs(anchor, own)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[one]), pa.array(own[one])], names=["anchor", "block"])

    return docs.select("text", "block").mapInArrow(run, "anchor long, block int")


def _distinct_texts(dealt: DataFrame) -> DataFrame:
    """One row a text of each block, with its smallest id. The rows are dealt by block already, so
    this is a streaming aggregate without an exchange of its own."""
    return dealt.groupBy("block", "k1", "k2").agg(F.min("id").alias("id"), F.max("text").alias("text")).select("k1", "k2", "block", "id", "text")


def _ordered(block: pa.Table) -> pa.Table:
    """The block's texts in the order of their keys, the same for both passes."""
    return block.sort_by([("k1", "ascending"), ("k2", "ascending")])


def _windows(size: int):
    """For a block: its distinct windows whose anchor recurs (key, tag, block, place, first)."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        names = ["key", "tag", "block", "place", "first"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        if not docs.num_rows or not known.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        docs = _ordered(docs)
        ids = docs.column("id").combine_chunks().fill_null(0).to_numpy()
        has_id = docs.column("id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        wanted = np.unique(known.column("anchor").to_numpy())
        found = []
        for part in W.slices(docs.column("text").combine_chunks()):
            starts, anchor, hashes = anchors(part, size)
            doc = part.row + part.owner[starts]
            near = np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)
            take = (wanted[near] == anchor) & has_id[doc]
            if not take.any():
                continue
            _, key = part.shingles(hashes, size, 9)
            _, tag = part.shingles(hashes, size, 21)
            place = (doc.astype(np.int64) << 32) | (starts - part.first[part.owner[starts]])
            found.append((key[take].view(np.int64), (tag[take] >> np.uint64(32)).astype(np.uint32).view(np.int32), place[take], ids[doc[take]]))
        if not found:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        key, tag, place, ids_ = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, ids_, tag, key))
        key, tag, place, ids_ = key[order], tag[order], place[order], ids_[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
        at = np.flatnonzero(fresh)
        last = np.append(at[1:], len(key)) - 1
        # The sign bit says that a later document of the block holds the window as well.
        place = np.where(ids_[last] > ids_[at], place[at] | np.int64(-(2**63)), place[at])
        block = np.full(len(at), docs.column("block")[0].as_py(), np.int32)
        return pa.table([pa.array(x, k) for x, k in zip((key[at], tag[at], block, place, ids_[at]), kinds, strict=True)], names=names)

    return run


def _laid_out(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """(the words of all texts, with a blank behind each text; where each text begins)."""
    words: list[bytes] = []
    begins = np.zeros(len(texts) + 1, np.int64)
    for d, text in enumerate(texts):
        words += text
        words.append(b"")
        begins[d + 1] = len(words)
    return words, begins


def _coded(words: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the two signs of each word, whether it has any): the distinct words among those inside have a
    code of two signs, either of which has about as many values; the others and blanks share one."""
    number = {w: i for i, w in enumerate(dict.fromkeys(compress(words, inside.tolist())))}
    side = min(max(1, int(len(number) ** 0.5) + 1), _SPAN)
    at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    known = at >= 0
    signs = np.stack([_HIGH + at // side, _LOW + at % side], axis=1).astype("<u4")
    signs[~known] = _OTHER
    return signs, known


def _matchable(known: np.ndarray) -> np.ndarray:
    """Places in runs of known words that are as long as a window, and the place behind each run.
    Any other word leaves an automaton at its root, so it needn't be read."""
    edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
    lo, hi = edge[::2], edge[1::2]
    long = hi - lo >= WINDOW
    turn = np.zeros(len(known) + 2, np.int64)
    turn[lo[long]] += 1
    turn[hi[long] + 1] -= 1
    return np.flatnonzero(np.cumsum(turn)[: len(known)] > 0)


def _occurrences(words: list[bytes], starts: np.ndarray, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, windows) of every occurrence of the windows, each given by a place among the words
    where it occurs, through one automaton a shard. Words are coded once for all shards."""
    spans = starts[:, None] + np.arange(WINDOW)
    inside = np.zeros(len(words), bool)
    inside[spans.ravel()] = True
    signs, known = _coded(words, inside)
    read = _matchable(known)
    stream = signs[read].tobytes().decode("utf-32-le")
    step = 2 * WINDOW
    for lo in range(0, len(starts), shard):
        held = signs[spans[lo : lo + shard]].tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in range(len(held) // step):
            automaton.add_word(held[i * step : (i + 1) * step], lo + i)
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(stream)), np.int64).reshape(-1, 2)
        yield read[found[:, 0] // 2] - (WINDOW - 1), found[:, 1]


def locate(texts: list[list[bytes]], windows: list[tuple[int, int]], first: np.ndarray, shard: int = SHARD_WINDOWS) -> Iterator[tuple[int, int, int]]:
    """(text, first word, first document) of every occurrence of the windows, each given by a text
    and a word where it occurs."""
    words, begins = _laid_out(texts)
    given = np.array(windows, np.int64).reshape(-1, 2)
    for places, which in _occurrences(words, begins[given[:, 0]] + given[:, 1], shard):
        d = np.searchsorted(begins, places, "right") - 1
        yield from zip(d.tolist(), (places - begins[d]).tolist(), first[which].tolist(), strict=True)


def _covered(texts: list[list[bytes]], ids: pa.ChunkedArray, confirmed: pa.Table) -> list[np.ndarray]:
    """For each text, which words are covered by a window that starts in an earlier document."""
    if not confirmed.num_rows:
        return [np.zeros(len(t), bool) for t in texts]
    words, begins = _laid_out(texts)
    place = confirmed.column("place").to_numpy() & np.int64(2**63 - 1)
    earliest = confirmed.column("earliest").to_numpy()
    ids = ids.combine_chunks()
    has_id, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    turn = np.zeros(len(words), np.int64)
    for places, which in _occurrences(words, begins[place >> 32] + (place & 0xFFFFFFFF), SHARD_WINDOWS):
        d = np.searchsorted(begins, places, "right") - 1
        places = places[has_id[d] & (earliest[which] < ids[d])]
        turn += np.bincount(places, minlength=len(words)) - np.bincount(places + WINDOW, minlength=len(words))
    gone = np.cumsum(turn) > 0
    return [gone[lo : hi - 1] for lo, hi in pairwise(begins.tolist())]


def _judged(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
    """For a block: each text with its words counted and, for its first document, the kept ones digested."""
    docs = _ordered(docs)
    texts = [(t.as_py() or "").encode("utf-8").split() for t in docs.column("text")]
    removed, digests, kept_texts, whole = [], [], [], []
    for t, gone in zip(texts, _covered(texts, docs.column("id"), confirmed), strict=True):
        kept = b" ".join(compress(t, (~gone).tolist()) if gone.any() else t)
        removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(kept).hexdigest())
        kept_texts.append(kept.decode("utf-8"))
        whole.append(b" ".join(t).decode("utf-8") if gone.any() else kept_texts[-1])
    return pa.table({
        "t1": docs.column("k1"), "t2": docs.column("k2"), "first": docs.column("id"), "n_words": pa.array(map(len, texts), pa.int64()),
        "gone": pa.array(removed, pa.int64()), "sha": pa.array(digests, pa.string()),
        "whole_sha": pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in whole], pa.string()),
        "rest": pa.array(kept_texts, pa.string()), "whole": pa.array(whole, pa.string()),
    })


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of every row; kept is the kept words joined by
    one space, and left out if ``with_text`` is false."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = max(1, -(-blocks // BLOCKS_A_PARTITION))
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    texts = _texts(d, blocks)
    recurring = _recurring(d.filter("id IS NOT NULL"), WINDOW)
    known = _block_anchors(texts.filter("id IS NOT NULL"), WINDOW).join(recurring, F.col("anchor") == F.col("recurring"), "left_semi")
    by_block = _distinct_texts(texts.repartition(parts, "block"))
    windows = by_block.groupBy("block").cogroup(known.repartition(parts, "block").groupBy("block")).applyInArrow(
        _windows(WINDOW), "key long, tag int, block int, place long, first long"
    )
    # One row a block and window: a window's group is as large as the number of blocks that hold it.
    earliest = F.min("first").over(Win.partitionBy("key", "tag"))
    confirmed = windows.withColumn("earliest", earliest).filter((F.col("earliest") < F.col("first")) | (F.col("place") < 0))
    confirmed = confirmed.select("block", "place", "earliest")
    judged = by_block.groupBy("block").cogroup(confirmed.repartition(parts, "block").groupBy("block")).applyInArrow(
        _judged if with_text else _without_text,
        "t1 long, t2 long, first long, n_words long, gone long, sha string, whole_sha string" + (", rest string, whole string" if with_text else ""),
    )
    rows = d.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    out = rows.join(judged, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")))
    own, copy = F.col("id") == F.col("first"), (F.col("id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    pick = lambda mine, none, every: F.when(own, mine).when(copy, none).otherwise(every)
    return out.select(
        F.col("id").alias(id_col), "n_words", pick(F.col("gone"), F.col("n_words"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.col("sha"), F.sha2(F.lit("").cast("binary"), 256), F.col("whole_sha")).alias("kept_sha256"),
        *([pick(F.col("rest"), F.lit(""), F.col("whole")).alias("kept")] if with_text else []),
    )


def _without_text(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
    return _judged(docs, confirmed).drop_columns(["rest", "whole"])
