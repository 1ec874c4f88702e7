"""Near-duplicate classes by BagMinHash.

A text is the multiset of its shingles of five words (a text of one to four words
is one shingle). Similarity of two texts is the weighted Jaccard of these
multisets, sum of minima over sum of maxima of the counts; texts are linked from
0.8 on, and a class is a connected component of links.

1. Signatures. A count is a weight on the levels 1, 2, 3, ... The levels lie in
   dyadic blocks (1; 2; 3-4; 5-8; ...), and each (shingle, block) carries a Poisson
   process of rate block length, drawn point by point in rising order from a hash
   of the two. A point falls on one register and on one level of its block; it
   counts if the level is within the text's count. The smallest point of each
   register is the signature: two texts agree in a register with probability
   exactly their weighted Jaccard. An element stops once its next point can't
   lower any register, so long texts take about one point a shingle.
2. Bands. 32 bands of 5 registers; at similarity 0.8 a pair shares no band with
   probability (1 - 0.8^5)^32 < 3.1e-6, at 0.3 it shares one with 7 %.
3. Links. Every pair that shares a bucket is accounted for, but within one class
   pairs are not listed:
   a. each node is compared, on the exact multiset overlap, with the most central
      node of its buckets (the one that shares most places with others), which
      settles most copies of one text;
   b. buckets that hold two components or more are dealt in blocks. There the
      nodes outside the bucket's largest component meet all members by sketches:
      counts of shingles in ``CLASSES`` hash classes, whose sum of minima is an
      upper bound of the overlap. Pairs of two components whose bound reaches the
      threshold are compared exactly; first the best of each node and foreign
      component, then, where a node had more and is still apart, all the others.
   A pair is passed over only if it lies within one component or its bound is too
   low, so no link between two components is lost.

Ids are integers. Equal texts are one node from the start. Nothing of a class, a bucket or the
graph is gathered in one row, on one task or on the driver.

Defined results: null, empty and blank texts have no shingles and are linked to
nothing; rows with one id are one document; a null id follows the class of equal
texts and has a null class if there is none with an id; an empty table gives an
empty result; further columns are passed by ``keep_one`` and left out by
``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.llm import words as W
from lotledger.llm.columns import steps, unused
from lotledger.llm.graph import components
from lotledger.session import settle

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
CLASSES = 512
CELLS = 1 << 20
BLOCK = 2048
BEST = 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(part: W.Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of a slice, ordered by text and shingle."""
    hashes = part.hashes()
    at, grams = part.shingles(hashes, size)
    owner = part.owner
    text = owner[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((part.counts > 0) & (part.counts < size))
    if len(short):
        own = [W.mix64((hashes[part.first[d] : part.first[d + 1]] * W.stream(size, 77)[: part.counts[d]]).sum(keepdims=True))[0] for d in short]
        text, grams = np.concatenate([text, short]), np.concatenate([grams, np.array(own, np.uint64)])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    starts = np.flatnonzero(first)
    return text[starts], grams[starts], np.diff(starts, append=len(text))


def bag_min_hash(text: np.ndarray, item: np.ndarray, count: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """Registers (texts x registers) of multisets; infinite where a text has no items."""
    out = np.full(n_texts * registers, np.inf)
    blocks = np.zeros(len(count), np.int64)
    more = count > 1
    blocks[more] = np.ceil(np.log2(count[more])).astype(np.int64)
    element = np.repeat(np.arange(len(count)), blocks + 1)
    j = np.arange(len(element)) - np.repeat(np.cumsum(blocks + 1) - blocks - 1, blocks + 1)
    length = np.where(j > 0, 2 ** np.maximum(j - 1, 0), 1)  # levels below + 1 .. below + length
    below = np.where(j > 0, length, 0)
    owner, limit = text[element], count[element] - below
    seed = W.mix64(item[element] + j.astype(np.uint64) * _GOLDEN)
    now, drawn, step = np.zeros(len(element)), 0, 1
    pace = 1.0 / (length * registers)
    while len(owner):
        turns = np.arange(drawn + 1, drawn + step + 1, dtype=np.uint64) * _GOLDEN
        z = W.mix64(seed[:, None] + turns[None, :])
        gaps = -np.log1p(-((z >> np.uint64(11)) * 2.0**-53)) * pace[:, None]
        points = now[:, None] + np.cumsum(gaps, axis=1)
        z = W.mix64(z)
        register = ((z >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        level = ((z & np.uint64(0xFFFFFFFF)) * length[:, None].astype(np.uint64)) >> np.uint64(32)
        counts = level.astype(np.int64) < limit[:, None]
        cell = owner[:, None] * registers + register.astype(np.int64)
        np.minimum.at(out, cell[counts], points[counts])
        worst = out.reshape(n_texts, registers).max(axis=1)
        now = points[:, -1]
        live = now < worst[owner]
        owner, limit, seed, now, pace, length = (x[live] for x in (owner, limit, seed, now, pace, length))
        drawn += step
        step = min(256, 2 * step) if len(owner) * step < 1 << 16 else step
    return out.reshape(n_texts, registers)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each text and band."""
    bits = registers.view(np.uint64).reshape(len(registers), bands, -1)
    factors = W.stream(bits.shape[2], 31)
    total = (W.mix64(bits) * factors).sum(axis=2, dtype=np.uint64)
    return W.mix64(total + W.stream(bands, 5)[None, :])


def _signed(docs: DataFrame, id_col: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, k1, k2, keys): one row a text; keys is null for texts without shingles."""
    t = F.col(f"`{text}`")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), t.alias("t"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))
    kind = base.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            keys, has = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for part in W.slices(batch.column("t")):
                found = shingles(part, size)
                keys.append(band_keys(bag_min_hash(*found, len(part), bands * rows), bands).ravel())
                has.append(part.counts > 0)
            has = np.concatenate(has)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys).view(np.int64)), bands).cast(pa.list_(pa.int64()))
            lists = lists.take(pa.array(np.where(has, np.arange(len(has)), -1), mask=~has))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"), lists], names=["id", "k1", "k2", "keys"])

    return base.mapInArrow(run, f"id {kind.simpleString()}, k1 long, k2 long, keys array<long>")


def _of(df: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The rows of df that may belong to the nodes. A table of the nodes' hash cells, of at most
    ``CELLS`` numbers whatever the corpus, is broadcast and takes out most of the others before
    what is left is dealt by node."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS))
    cells = nodes.select(cell(nodes.columns[0]).alias("cell")).distinct()
    return df.join(F.broadcast(cells), cell(column) == F.col("cell"), "left_semi")


def _bags(docs: DataFrame, id_col: str, text: str, nodes: DataFrame, size: int) -> DataFrame:
    """(node, bag): the sorted shingle hashes, repeats included, of the nodes' texts."""
    wanted = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"))
    wanted = _of(wanted, "id", nodes).join(nodes, F.col("id") == F.col("node"), "left_semi")
    kind = wanted.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            bags: list[bytes] = []
            for part in W.slices(batch.column("t")):
                text_, grams, n = shingles(part, size)
                flat, upto = np.repeat(grams, n), np.concatenate([[0], np.cumsum(np.bincount(text_, n, len(part)))]).astype(np.int64)
                bags += [flat[upto[d] : upto[d + 1]].tobytes() for d in range(len(part))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bags, pa.binary())], names=["node", "bag"])

    return wanted.mapInArrow(run, f"node {kind}, bag binary").filter("length(bag) > 0")


def _sketches(bags: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, sketch) of the nodes, and maybe of others: how many shingles fall in each hash
    class. Sketches are made where the bags lie, so no bag is dealt by node for them."""
    kind = bags.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            size, out = [], []
            for bag in batch.column("bag"):
                hashes = np.frombuffer(bag.as_py(), np.uint64)
                size.append(len(hashes))
                classes = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES)
                out.append(np.minimum(classes, 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["node", "size", "sketch"])

    # Nodes that share a cell with a wanted one come along; the join with the buckets drops them.
    return _of(bags, "node", nodes).mapInArrow(run, f"node {kind}, size long, sketch binary")


def bounds(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarity of every row of a and of b, from sketches and sizes. What a
    full class couldn't count is taken as shared."""
    both = np.empty((len(a), len(b)))
    over_a, over_b = size_a - a.sum(axis=1, dtype=np.int64), size_b - b.sum(axis=1, dtype=np.int64)
    for i in range(len(a)):
        both[i] = np.minimum(a[i], b).sum(axis=1, dtype=np.int64) + np.minimum(over_a[i], over_b)
    return both / np.maximum(size_a[:, None] + size_b[None, :] - both, 1)


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two sorted bags."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    (x, nx), (y, ny) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / max(int(nx.sum() + ny.sum()) - both, 1)


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. The bag of a travels to b."""
    left = pairs.join(_of(bags, "node", pairs.select("a")).select(F.col("node").alias("na"), F.col("bag").alias("bag_a")), F.col("a") == F.col("na")).select("a", "b", "bag_a")
    both = left.join(_of(bags, "node", pairs.select("b")).select(F.col("node").alias("nb"), F.col("bag").alias("bag_b")), F.col("b") == F.col("nb")).select("a", "b", "bag_a", "bag_b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            good = [overlap(x.as_py(), y.as_py()) >= threshold for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _ordered(a: Column, b: Column) -> Column:
    return F.when(a < b, F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))


def _central(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the most central node of its buckets."""
    shared = members.groupBy("node").agg(F.sum("n").alias("s")).select(F.col("node").alias("m"), "s")
    near = members.join(shared, F.col("node") == F.col("m")).select("key", "node", F.struct("s", "node").alias("c"))
    lead = near.groupBy("key").agg(F.max("c").alias("lead")).select(F.col("key").alias("k"), "lead")
    best = near.join(lead, F.col("key") == F.col("k")).groupBy("node").agg(F.max("lead").alias("lead")).filter(F.col("node") != F.col("lead.node"))
    return best.select(_ordered(F.col("lead.node"), F.col("node")).alias("p")).select("p.*").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, head): members of buckets with two components or more; head marks those
    outside the bucket's largest component."""
    near = members.join(labels.select(F.col("node").alias("m"), "label"), F.col("node") == F.col("m"), "left")
    near = near.select("key", "node", F.coalesce("label", "node").alias("label"))
    by = near.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
    by = by.filter("labels > 1").select(F.col("key").alias("k"), F.col("top.label").alias("largest"))
    return near.join(by, F.col("key") == F.col("k")).select("key", "node", "label", (F.col("label") != F.col("largest")).alias("head"))


def _near_pairs(opened: DataFrame, sketches: DataFrame, threshold: float, best: int | None) -> DataFrame:
    """Pairs (a, b, more) of two components in a bucket whose bound reaches the threshold. With
    ``best``, only so many for each node and foreign component, the highest bounds; ``more`` marks
    pairs of nodes that have others."""
    # A bucket's members in blocks; its heads in blocks as well, each sent to all blocks of members.
    n = opened.groupBy("key").agg(F.count("*").alias("all"), F.count(F.when(F.col("head"), 1)).alias("heads"))
    n = n.select(F.col("key").alias("k"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("heads") / BLOCK).cast("int").alias("cuts"))
    rows = opened.join(n, F.col("key") == F.col("k")).drop("k")
    rows = rows.join(sketches.select(F.col("node").alias("m"), "size", "sketch"), F.col("node") == F.col("m")).drop("m")
    # Buckets of one block are dealt by many in a cell; a larger one has cells of its own.
    cells = max(1, opened.count() // BLOCK)
    alone = (F.col("blocks") > 1) | (F.col("cuts") > 1)
    rows = rows.withColumn("cell", F.when(alone, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(cells))))
    deal = F.xxhash64("node")
    one = lambda c: F.pmod(deal, F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    heads = rows.filter("head").withColumn("cut", one("cuts")).withColumn("block", every("blocks"))
    tails = rows.withColumn("block", one("blocks")).withColumn("cut", every("cuts"))
    names = ["cell", "cut", "block", "key", "node", "label", "size", "sketch"]
    heads, tails = (x.select(*(F.col(c).alias(c) for c in names)).groupBy("cell", "cut", "block") for x in (heads, tails))
    kind = opened.schema["node"].dataType.simpleString()

    def columns(t: pa.Table) -> list[np.ndarray]:
        key, label = t.column("key").to_numpy(), t.column("label").to_numpy()
        order = np.lexsort((label, key))
        sketch = np.frombuffer(b"".join(t.column("sketch").take(pa.array(order)).to_pylist()), np.uint16).reshape(-1, CLASSES)
        return [key[order], label[order], t.column("node").to_numpy()[order], t.column("size").to_numpy()[order], sketch]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        if left.num_rows and right.num_rows:
            left, right = columns(left), columns(right)
            keys, begins = np.unique(left[0], return_index=True)
            for key, lo, hi in zip(keys, begins, np.append(begins[1:], len(left[0])), strict=True):
                start, stop = np.searchsorted(right[0], key), np.searchsorted(right[0], key, "right")
                y = [c[start:stop] for c in right]
                for at in range(lo, hi, 256):
                    x = [c[at : min(at + 256, hi)] for c in left]
                    bound = bounds(x[4], x[3], y[4], y[3])
                    bound[x[1][:, None] == y[1][None, :]] = 0
                    i, j = np.nonzero(bound >= threshold)
                    rest = np.zeros(len(i), bool)
                    if best is not None and len(i):
                        order = np.lexsort((-bound[i, j], y[1][j], i))
                        i, j = i[order], j[order]
                        first = np.flatnonzero(np.append(True, (np.diff(i) != 0) | (np.diff(y[1][j]) != 0)))
                        lengths = np.diff(first, append=len(i))
                        keep = np.arange(len(i)) - np.repeat(first, lengths) < best
                        rest = np.repeat(lengths > best, lengths)[keep]
                        i, j = i[keep], j[keep]
                    a.append(x[2][i])
                    b.append(y[2][j])
                    more.append(rest)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "more": pa.array(np.concatenate(more))})

    met = heads.cogroup(tails).applyInArrow(meet, f"a {kind}, b {kind}, more boolean")
    return met.groupBy("a", "b").agg(F.max("more").alias("more"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node) of the pairs that had others and are still in two components."""
    more = pairs.filter("more")
    for side in ("a", "b"):
        of = labels.select(F.col("node").alias(f"n{side}"), F.col("label").alias(f"l{side}"))
        more = more.join(of, F.col(side) == F.col(f"n{side}"), "left")
    more = more.filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    return more.select(F.col("a").alias("node")).union(more.select("b")).distinct()


def _buckets_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """All members of the buckets that hold one of the nodes.

    A pair left out of the first turn has a node with more pairs to the other's component than
    ``BEST``. If this node is apart from none of those compared, the pair lies in one component;
    else the node is among ``nodes``, and the pair's bucket is kept whole.
    """
    keys = members.join(nodes.select(F.col("node").alias("m")), F.col("node") == F.col("m"), "left_semi")
    return members.join(keys.select(F.col("key").alias("k")).distinct(), F.col("key") == F.col("k"), "left_semi")


def _links(docs: DataFrame, id_col: str, text: str, members: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, label) from the buckets (key, node, n)."""
    bags = settle(_bags(docs, id_col, text, members.select("node").distinct(), size))
    links = settle(_verified(settle(_central(members)), bags, threshold))
    labels = settle(components(links))
    left = members
    for best in (BEST, None):
        opened = settle(_open(left, labels))
        if opened.isEmpty():
            break
        sketches = _sketches(bags, opened.select("node").distinct())
        pairs = settle(_near_pairs(opened, sketches, threshold, best))
        found = settle(_verified(pairs.select("a", "b"), bags, threshold))
        if not found.isEmpty():
            links = links.union(found)
            labels = settle(components(links))
        if best is None:
            break
        apart = settle(_apart(pairs, labels))
        if apart.isEmpty():
            break
        left = _buckets_of(members, apart)
    return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) of every row; class_id is the smallest id of the class."""
    signed = settle(_signed(docs, id_col, text, size, bands, rows))
    texts = signed.filter("keys IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.any_value("keys").alias("keys"))
    texts = settle(texts)
    spread = texts.filter("node IS NOT NULL").select("node", F.explode("keys").alias("key"))
    full = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), "n")
    members = settle(spread.join(full, F.col("key") == F.col("k")).select("key", "node", "n").distinct())
    labels = _links(docs, id_col, text, members, size, threshold)
    node = texts.join(labels.select(F.col("node").alias("n"), "label"), F.col("node") == F.col("n"), "left")
    node = node.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.coalesce("label", "node").alias("class"))
    out = signed.join(node, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left")
    out = out.select("id", F.coalesce("class", "id").alias("class_id"))
    # One id with several texts is one document: it takes the smallest class of them.
    several = out.groupBy("id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low < high")
    several = several.select(F.col("id").alias("i"), "low", "high")
    out = out.join(several, F.col("id") == F.col("i"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("low", "class_id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs with the smallest id of their class, each id once; rows without an id stay."""
    mark, id_ = unused(docs, "keep"), F.col(f"`{id_col}`")
    found = classes(docs, id_col, text, **how).filter(F.col(id_col) == F.col("class_id"))
    found = found.groupBy(id_col).agg(F.count("*").alias("n")).select(F.col(id_col).alias(mark), "n")
    n = unused(docs, "n")
    held = docs.join(found.withColumnRenamed("n", n), id_ == F.col(mark))
    once = held.filter(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    again = held.filter(F.col(n) > 1).select(*(F.col(f"`{c}`") for c in docs.columns)).dropDuplicates([id_col])
    return once.unionByName(again).unionByName(docs.filter(id_.isNull()))
