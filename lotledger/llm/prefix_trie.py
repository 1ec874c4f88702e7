"""Prefix trie of rebuilt conversations: every distinct beginning, and what sharing it saves.

Conversations are rebuilt first (``rebuild``): a conversation takes its first ``h`` turns
from the conversation that opens its block of ids, then goes on with its own turns behind
its first ``h``. A node is a distinct sequence of first turns, named by a digest of 128
bits: the exclusive or of a hash of each turn and its place, so that a beginning's digest
follows from any split of the turns (``running``), and a parent's from the child's.

* A node of one conversation needs no trie: it is a chain to that conversation's end.
* Shared nodes go to shards, whole subtrees together. A node is heavy if more than
  ``LIGHT`` turns stand on or below it; the first node on a path that isn't heavy opens a
  subtree, and subtrees are dealt out by digest, so no shard holds much more than
  ``SHARD_NODES`` and the largest subtree. In a shard the digests get the slots of a
  minimal perfect hash table, each checked against the digest that it stores. Counts are
  scattered into flat arrays by slot, and each depth, the deepest first, is added to its
  parents through the array of parent slots.
* Heavy nodes and the root are the last shard. Their number is at most the depth times the
  turns over ``LIGHT``; they start with the sums of the subtrees that hang on them.

Ids of the conversations that end at a node are joined in blocks of 4096 ids, and blocks
are hashed one after the other, so that a node at which a third of all conversations ends
is never held as a whole.

Defined results: null roles and texts count as empty; turns are ordered by turn (null
first), then role, then text; rows without a ``conv_id`` take no part; repeated rows are
turns of their own; an empty table gives no node. Only the four columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotledger.session import settle

LIGHT = 1 << 18
SHARD_NODES = 1 << 20
#: Turns of one conversation that a window orders at once.
BLOCK_BITS = 10
#: Ids of a block whose joined text is built at once.
ENDS_BITS = 12


def running(df: DataFrame, key: str, place: Column, order: list[Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with running aggregates (name: "count" or "bit_xor", and of what) along each key.

    Rows of a key are cut into blocks by ``place``, so a key with very many rows is many windows;
    only one row a block is ordered along a whole key.
    """
    agg = {n: (F.count if how == "count" else F.bit_xor, of) for n, (how, of) in values.items()}
    df = df.withColumn("_block", F.coalesce(F.shiftright(place.cast("long"), BLOCK_BITS), F.lit(-(1 << 62))))
    blocks = df.groupBy(key, "_block").agg(*(f(of).alias(f"_{n}") for n, (f, of) in agg.items()))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    add = {n: F.sum if how == "count" else F.bit_xor for n, (how, _) in values.items()}
    blocks = blocks.select(key, "_block", *(F.coalesce(add[n](f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values))
    upto = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns({n: f(of).over(upto) for n, (f, of) in agg.items()})
    joined = inside.join(blocks, [key, "_block"])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") if how == "count" else F.col(n).bitwiseXOR(F.col(f"_{n}")) for n, (how, _) in values.items()}).drop("_block", *(f"_{n}" for n in values))


def rebuild(conversations: DataFrame, block: int = 100, longest: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, place from 1, two hashes of the turn, code points of its text) and the
    conversations (conv_id, n_turns rebuilt), those without a turn too. A conversation c opens with the
    first crc32(c as text) % ``longest`` turns of conversation c - c % ``block``."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    ranked = running(turns, "conv_id", F.col("turn"), order, {"place": ("count", F.lit(1))})
    ranked = settle(ranked.select(
        "conv_id", "place", F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "text", "role").alias("y"), F.length("text").cast("long").alias("chars")
    ))
    taken = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("long")
    opener = F.col("conv_id") - F.col("conv_id") % block
    convs = ranked.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    openers = ranked.filter((F.col("conv_id") % block == 0) & (F.col("place") < longest))
    has = openers.groupBy(F.col("conv_id").alias("opener")).agg(F.max("place").alias("n_opener"))
    convs = convs.withColumns({"taken": taken, "opener": opener}).join(has, "opener", "left")
    convs = settle(convs.withColumn("n_lent", F.least("taken", F.coalesce("n_opener", F.lit(0)))).select(
        "conv_id", "opener", "taken", "n_lent", (F.col("n_lent") + F.greatest(F.col("n_own") - F.col("taken"), F.lit(0))).alias("n_turns")
    ))
    lent = convs.select("conv_id", "opener", "n_lent").join(openers.withColumnRenamed("conv_id", "opener"), "opener").filter("place <= n_lent")
    own = ranked.join(convs.select("conv_id", "taken", "n_lent"), "conv_id").filter("place > taken").withColumn("place", F.expr("place - taken + n_lent"))
    names = ["conv_id", "place", "x", "y", "chars"]
    return lent.select(names).unionByName(own.select(names)), convs.select("conv_id", "n_turns")


class Slots:
    """A minimal perfect hash table of distinct pairs of 64-bit keys: on each level the keys that no
    other key meets get the next slots, the rest go on. Slots store their key, so that a key that the
    table doesn't hold is told apart."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        left, used = np.arange(len(a)), 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._hash(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slot = used + np.cumsum(alone) - 1
            held = alone[at]
            self.a[slot[at[held]]], self.b[slot[at[held]]] = a[left[held]], b[left[held]]
            self.levels.append((alone, slot))
            left, used = left[~held], used + int(alone.sum())
            if len(self.levels) > 200:
                raise ValueError("a key stands twice")

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        # The multipliers of a well-known 64-bit mixing function.
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the table doesn't hold it."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._hash(a[left], b[left], level, len(alone))
            held = alone[at]
            found = slot[at[held]]
            same = (self.a[found] == a[left[held]]) & (self.b[found] == b[left[held]])
            out[left[held][same]] = found[same]
            left = left[~held]
        return out


_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, chars long"
_DONE = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: nodes with what already hangs on them (children, leaves, saved) to nodes with the
    sums of their subtrees. A parent outside the shard gives no parent_conv_id."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    get = {c: table.column(c).to_numpy() for c in table.column_names}
    key = {c: get[c].astype(np.int64).view(np.uint64) for c in ("k1", "k2", "p1", "p2")}
    slots = Slots(key["k1"], key["k2"])
    slot = slots.find(key["k1"], key["k2"])
    n = len(slot)
    flat = {c: np.zeros(n, np.int64) for c in ("depth", "conv_id", "children", "leaves", "saved")}
    for c in ("depth", "conv_id", "children", "leaves"):
        flat[c][slot] = get[c]
    flat["saved"][slot] = get["saved"] + (get["n_convs"] - 1) * get["chars"]
    parent = np.full(n, -1, np.int64)
    inner = get["depth"] > 0  # the root is nobody's child
    parent[slot[inner]] = slots.find(key["p1"][inner], key["p2"][inner])

    np.add.at(flat["children"], parent[parent >= 0], 1)
    flat["leaves"][flat["children"] == 0] = 1
    order = np.argsort(-flat["depth"], kind="stable")
    edges = np.flatnonzero(np.diff(flat["depth"][order], prepend=flat["depth"][order[0]] + 1, append=-1))
    for at, upto in zip(edges, edges[1:]):
        level = order[at:upto]
        level = level[parent[level] >= 0]
        for c in ("leaves", "saved"):
            np.add.at(flat[c], parent[level], flat[c][level])
    of = parent[slot]
    out = {c: get[c] for c in ("k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs")}
    out |= {"n_children": flat["children"][slot], "n_leaves": flat["leaves"][slot], "saved_tokens": flat["saved"][slot]}
    arrays = {c: pa.array(v, pa.int64()) for c, v in out.items()}
    arrays["parent_conv_id"] = pa.array(flat["conv_id"][of], pa.int64(), mask=of < 0)
    names = [f.split()[0] for f in _DONE.split(", ")]
    yield from pa.table([arrays[c] for c in names], names=names).to_batches(1 << 16)


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which a conversation ends."""
    ends = paths.filter("place = n_turns").select("k1", "k2", "conv_id")
    ends = ends.unionByName(convs.filter("n_turns = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))
    joined = ends.groupBy("k1", "k2", F.shiftright("conv_id", ENDS_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    joined = settle(joined)
    counted = joined.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    few = counted.filter("n = 1").select("k1", "k2", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        row = lambda: pa.RecordBatch.from_pylist([{"k1": now[0], "k2": now[1], "ends_sha256": state.hexdigest()}])
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (a, b) != now:
                    if now is not None:
                        yield row()
                    now, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            yield row()

    many = joined.join(counted.filter("n > 1").select("k1", "k2"), ["k1", "k2"], "left_semi").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
    return few.unionByName(many.mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, light: int = LIGHT, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row a node, from what ``rebuild`` returns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    marks = turns.select("*", F.xxhash64(F.lit(3), "place", "x", "y").alias("z1"), F.xxhash64(F.lit(4), "place", "y", "x").alias("z2"))
    paths = running(marks, "conv_id", F.col("place"), [F.col("place")], {"k1": ("bit_xor", F.col("z1")), "k2": ("bit_xor", F.col("z2"))})
    paths = settle(paths.join(convs, "conv_id").select(
        "conv_id", "place", "n_turns", "k1", "k2", F.expr("k1 ^ z1").alias("p1"), F.expr("k2 ^ z2").alias("p2"), "chars", "x"
    ))

    # Distinct digests; what is below a node, and a check that no two beginnings share one.
    check = F.xxhash64("place", "p1", "p2", "x")
    nodes = settle(paths.groupBy("k1", "k2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("place").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"), F.sum(F.expr("n_turns - place + 1")).alias("weight"), (F.min(check) != F.max(check)).alias("clash"),
    ))
    nodes = nodes.withColumn("depth", F.when(F.col("clash"), F.raise_error(F.lit("two beginnings share a digest"))).otherwise(F.col("depth"))).drop("clash")
    shared, single = nodes.filter("n_convs > 1"), nodes.filter("n_convs = 1")

    # Chains of one conversation: where they begin, and what they are to the node they hang on.
    chains = settle(single.groupBy("conv_id").agg(F.min_by(F.struct("p1", "p2", "depth"), "depth").alias("c")).select("conv_id", "c.*"))
    hung = chains.groupBy("p1", "p2").agg(F.count("*").alias("hung")).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "hung")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"), F.lit(True).alias("heavy")
    )
    marked = shared.withColumn("heavy", F.col("weight") > light).drop("weight").unionByName(root)
    n = F.coalesce("hung", zero)
    marked = settle(marked.join(hung, ["k1", "k2"], "left").withColumns({"children": n, "leaves": n, "saved": zero}).drop("hung"))

    # The subtree a shared node belongs to, through the path of its smallest member.
    heavy = marked.filter("heavy").select("k1", "k2", F.lit(True).alias("heavy"))
    opens = paths.select("conv_id", "place", "k1", "k2").join(heavy, ["k1", "k2"], "left").filter("heavy is null")
    opens = opens.groupBy("conv_id").agg(F.min_by(F.struct(F.col("k1").alias("s1"), F.col("k2").alias("s2")), "place").alias("s")).select("conv_id", "s.*")
    below = marked.filter("not heavy").drop("heavy").join(opens, "conv_id")
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // shard_nodes))
    done = settle(below.repartition(n_shards, "s1", "s2").drop("s1", "s2").mapInArrow(accumulate, _DONE))

    sums = done.filter("parent_conv_id is null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s")
    )
    top = marked.filter("heavy").drop("heavy").join(sums, ["k1", "k2"], "left")
    top = top.withColumns({a: F.col(a) + F.coalesce(b, zero) for a, b in (("children", "_c"), ("leaves", "_l"), ("saved", "_s"))}).drop("_c", "_l", "_s")
    top = settle(top.repartition(1).mapInArrow(accumulate, _DONE))

    # Parents that stand in another shard, or in none.
    def parent(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias(name))

    opened = done.filter("parent_conv_id is null").drop("parent_conv_id").join(parent(top, "parent_conv_id"), ["p1", "p2"])
    inner = done.filter("parent_conv_id is not null").unionByName(opened)
    above = parent(done.select("k1", "k2", "conv_id").unionByName(top.select("k1", "k2", "conv_id")), "above")
    first = chains.join(above, ["p1", "p2"]).select("conv_id", F.col("depth").alias("first"), "above")
    chained = single.join(convs, "conv_id").join(first, "conv_id").select(
        "k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", F.when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.when(F.col("depth") < F.col("n_turns"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
    )
    out = inner.unionByName(top).unionByName(chained).join(_ends(paths, convs), ["k1", "k2"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
