"""Nearest neighbours by largest inner product: a hierarchical k-means tree.

1. Rows with one vector become one entry with its smallest ids (as many as a
   result can need), so a vector held by a third of all rows is searched once.
2. The tree is fitted on at most ``SAMPLE`` entries: each node is split by k-means
   into ``BRANCH`` children until it holds ``LEAF`` of them or fewer. Every entry of
   the table is then sent down to its leaf, and leaves are packed into cells of
   about ``BLOCK`` entries, a larger leaf into several cells of its own.
3. A query goes through the tree best bin first: a priority queue holds nodes by
   the inner product of query and centroid, the best is taken, children go in, and
   a leaf is a visit. The number of visits is calibrated: ``CALIBRATION`` queries are
   compared with all entries, and visits are widened until their true neighbours
   lie in visited leaves at ``RECALL``. A query visits on until its leaves hold
   enough rows.
4. Queries and entries meet by cell and block of at most about ``ASKED`` queries, where a
   query looks at the leaves it visits;
   the best of each cell are scored exactly (double precision, summed in order of
   components), and the best of all cells are the result.

The tree, the leaf counts, the sample and the calibration queries are bounded by
parameters; everything else is dealt by cell.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither do those whose length isn't the most frequent one
(the smaller of two); rows with one id and one vector count once; a row never
finds rows of its own id; ties go to the smaller id; a query with fewer candidates
than ``k`` gets all of them; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from lotledger.llm.columns import steps
from lotledger.session import settle

K = 20
SAMPLE = 20_000
BRANCH = 12
LEAF = 48
BLOCK = 8192
ASKED = 16_384
CALIBRATION = 256
RECALL = 0.95
ROUNDS = 12


@dataclass
class Tree:
    """Nodes by number, 0 the root: centroids, children (empty for a leaf) and the leaf's number."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    @classmethod
    def fit(cls, points: np.ndarray, branch: int = BRANCH, leaf_size: int = LEAF, seed: int = 0) -> Tree:
        rng = np.random.default_rng(seed)
        centres, children, leaf, n_leaves = [points.mean(axis=0)], [[]], [-1], 0
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            groups = _k_means(points[rows], branch, rng) if len(rows) > leaf_size else []
            if len(groups) < 2:
                leaf[node] = n_leaves
                n_leaves += 1
                continue
            for g in groups:
                children[node].append(len(centres))
                todo.append((len(centres), rows[g]))
                centres.append(points[rows[g]].mean(axis=0))
                children.append([])
                leaf.append(-1)
        return cls(np.stack(centres), children, leaf)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: at every node on to the nearest child."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = np.array(self.children[node])
                best = _nearest(points[rows], self.centres[kids])
                todo += [(int(kid), rows[best == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        value = self.centres @ query
        queue = [(-value[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (-value[kid], kid))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Non-empty groups of rows; one group where the points can't be told apart."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        best = _nearest(points, centres)
        held = np.unique(best)
        centres = np.stack([points[best == g].mean(axis=0) for g in held])
    best = _nearest(points, centres)
    return [np.flatnonzero(best == g) for g in np.unique(best)]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _exact(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of components."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * points[:, j]
    return total


def best_of(queries: np.ndarray, points: np.ndarray, vids: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the k best points of each query, ties to the smaller of ``vids``.
    What the fast product puts within rounding of the k-th place, all its ties too, is scored
    exactly before the cut. ``seen`` (queries x points) leaves out what a query doesn't look at."""
    product = queries @ points.T
    if seen is not None:
        product[~seen] = -np.inf
    near = np.ones(product.shape, bool) if seen is None else seen
    if k < len(points):
        last = np.partition(product, len(points) - k, axis=1)[:, len(points) - k]
        lengths = np.linalg.norm(queries, axis=1) * np.linalg.norm(points, axis=1).max()
        rounding = 4 * (queries.shape[1] + 1) * np.finfo(np.float64).eps * lengths
        near = near & (product >= (last - rounding)[:, None])
    q, p = np.nonzero(near)
    score = _exact(queries[q], points[p])
    order = np.lexsort((vids[p], -score, q))
    q, p, score = q[order], p[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    take = np.arange(len(q)) - first[q] < k
    return q[take], p[take], score[take]


def _entries(vectors: DataFrame, id_col: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): rows are (id, v); entries are (v, vid, ids), one a distinct vector, with its
    k + 1 smallest ids of which vid is the first."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).filter(F.col("id").isNotNull())
    rows = rows.filter(_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    rows = rows.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))
    first = F.dense_rank().over(Win.partitionBy("v").orderBy("id"))
    held = rows.withColumn("r", first).filter(F.col("r") <= k + 1)
    held = held.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return rows, settle(held.select("v", F.col("ids")[0].alias("vid"), "ids"))


def _fitted(entries: DataFrame, sample: int) -> Tree | None:
    points = entries.select("v", "vid").orderBy(F.xxhash64("vid"), "vid").limit(sample).select("v").toArrow()
    return Tree.fit(matrix(points.column("v").combine_chunks())) if points.num_rows else None


def _indexed(entries: DataFrame, tree) -> DataFrame:
    """Entries with their leaf."""
    kind = entries.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            leaf = pa.array(tree.value.place(matrix(batch.column("v"))))
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("vid"), batch.column("ids"), leaf], names=["v", "vid", "ids", "leaf"])

    return settle(entries.mapInArrow(run, f"v {kind}, vid long, ids array<long>, leaf long"))


def _calibrated(index: DataFrame, asked: DataFrame, tree, k: int, recall: float, sample: int) -> int:
    """The number of visits after which the sample's true neighbours lie in visited leaves at ``recall``."""
    queries = asked.orderBy(F.xxhash64("vid", F.lit(1)), "vid").limit(sample).toArrow()
    if not queries.num_rows:
        return 1
    points = matrix(queries.column("v").combine_chunks())
    own = queries.column("vid").to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((points, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, own = shared.value
        for batch in batches:
            if batch.num_rows:
                vids = batch.column("vid").to_numpy()
                q, p, score = best_of(points, matrix(batch.column("v")), vids, k + 1)
                leaf, vid = batch.column("leaf").to_numpy()[p], vids[p]
                other = vid != own[q]
                yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (q, score, vid, leaf)], names=["q", "score", "vid", "leaf"])

    near = index.mapInArrow(run, "q long, score double, vid long, leaf long")
    near = near.withColumn("r", F.row_number().over(Win.partitionBy("q").orderBy(F.desc("score"), "vid"))).filter(F.col("r") <= k)
    true = near.groupBy("q", "leaf").agg(F.count("*").alias("n")).collect()
    place = [{leaf: i for i, leaf in enumerate(tree.value.visits(p))} for p in points]
    needed = np.sort(np.repeat([place[r["q"]][r["leaf"]] for r in true], [r["n"] for r in true]))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL,
           sample: int = SAMPLE, visits: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of every row where ``is_query`` (over the column
    "id") holds. ``visits`` overrides the calibrated number of leaves."""
    rows, entries = _entries(vectors, id_col, vector, k)
    session = vectors.sparkSession
    fitted = _fitted(entries, sample)
    out = f"query_id long, rank int, {id_col} long, score double"
    if fitted is None:
        return session.createDataFrame([], out)
    tree = session.sparkContext.broadcast(fitted)
    index = _indexed(entries, tree)
    asking = rows.filter(is_query).distinct()
    asking = settle(asking.join(entries.select(F.col("v").alias("ev"), "vid"), F.col("v") == F.col("ev")).select("id", "v", "vid"))
    asked = settle(asking.select("v", "vid").distinct())
    sizes = {r["leaf"]: (r["n"], r["ids"]) for r in index.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    # Leaves in their order in the tree, so that neighbours share a cell: (first cell, cells) of each.
    cells, cell, filled = {}, 0, 0
    for leaf, (n, _) in sorted(sizes.items()):
        if filled and filled + n > BLOCK:
            cell, filled = cell + 1, 0
        cells[leaf] = (cell, max(1, -(-n // BLOCK)))
        cell, filled = cell + cells[leaf][1] - 1, filled + n
    held = {leaf: ids for leaf, (_, ids) in sizes.items()}
    if visits is None:
        visits = _calibrated(index, asked, tree, k, recall, CALIBRATION)
    plan = session.sparkContext.broadcast((cells, held))
    kind = entries.schema["v"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = plan.value
        for batch in steps(batches):
            row, cell, leaves = [], [], []
            for i, q in enumerate(matrix(batch.column("v"))):
                seen, rows_, by = 0, 0, {}
                for at in tree.value.visits(q):
                    if seen >= visits and rows_ > k:
                        break
                    seen, rows_ = seen + 1, rows_ + held.get(at, 0)
                    first, n = cells.get(at, (0, 0))
                    for c in range(first, first + n):
                        by.setdefault(c, []).append(at)
                row += [i] * len(by)
                cell += by.keys()
                leaves += by.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), batch.column("vid").take(take), batch.column("v").take(take), pa.array(leaves, pa.list_(pa.int64()))],
                names=["cell", "qid", "q", "leaves"],
            )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, _ = plan.value
        for batch in batches:
            vid = batch.column("vid").to_numpy()
            first, n = np.array([cells[x] for x in batch.column("leaf").to_pylist()], np.int64).reshape(-1, 2).T
            cell = first + (vid * 0x9E3779B1 >> 7) % n
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(batch.column(c) for c in ("leaf", "vid", "v", "ids"))], names=["cell", "leaf", "vid", "v", "ids"])

    def meet(queries: pa.Table, points: pa.Table) -> pa.Table:
        names, kinds = ["qid", "score", "ids"], [pa.int64(), pa.float64(), pa.list_(pa.int64())]
        if not queries.num_rows or not points.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        there = matrix(points.column("v").combine_chunks())
        vids = points.column("vid").to_numpy()
        here, column = np.unique(points.column("leaf").to_numpy(), return_inverse=True)
        parts = []
        for at in range(0, queries.num_rows, 256):
            some = queries.slice(at, 256)
            visited = np.stack([np.isin(here, x) for x in some.column("leaves").to_pylist()])
            q, p, score = best_of(matrix(some.column("q").combine_chunks()), there, vids, k + 1, visited[:, column])
            parts.append(pa.table([some.column("qid").take(pa.array(q)), pa.array(score), points.column("ids").take(pa.array(p))], names=names))
        return pa.concat_tables(parts)

    # The queries of a cell are dealt out as blocks of about ASKED, each with the entries of the cell.
    routed = settle(asked.mapInArrow(route, f"cell long, qid long, q {kind}, leaves array<long>"))
    blocks = settle(routed.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks")))
    routed = routed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).drop("blocks").groupBy("cell", "block")
    dealt = index.mapInArrow(split, f"cell long, leaf long, vid long, v {kind}, ids array<long>").join(blocks, "cell")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").groupBy("cell", "block")
    found = routed.cogroup(dealt).applyInArrow(meet, "qid long, score double, ids array<long>")
    # Of all cells, the k + 1 best rows of each distinct query vector: a bounded list.
    found = found.select("qid", "score", F.explode("ids").alias("found"))
    found = found.withColumn("r", F.row_number().over(Win.partitionBy("qid").orderBy(F.desc("score"), "found"))).filter(F.col("r") <= k + 1)
    best = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "found", "score"))).alias("best"))
    each = asking.join(best, F.col("vid") == F.col("qid")).select("id", F.slice(F.filter("best", lambda x: x["found"] != F.col("id")), 1, k).alias("best"))
    each = each.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.found").alias(id_col), F.col("b.score").alias("score"))
