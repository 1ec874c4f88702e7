"""Quality by ordinal regression on graded ratings (cumulative links).

A rating has ordered grades 0 .. K - 1. One weight vector over hashed text
features is shared by all grades; ordered thresholds cut the score:
P(grade <= k) = sigmoid(threshold_k - score). A text's expected grade is the sum
of its tail probabilities P(grade >= k), and texts are selected by one of them.

Features are the presence of words (lower case, without ASCII signs), of word
beginnings that one, two or four words of the text share, and of word shapes in steps of their share of the text, hashed into ``BUCKETS``; a bucket
counts if ``MIN_TEXTS`` rated texts of the sample hold it and if, for some grade,
texts below it hold the bucket at another rate than the rest (two-proportion
score of ``MIN_SCORE`` or more). So words that only single texts share, of which
a large vocabulary has very many, can't be learned by heart. The fit takes at most
``SAMPLE_ROWS`` rated rows, in the order of a hash of the id, so it costs the same
at every size; all texts are scored, whole.

Defined results: rows without an id or a grade are not learned from; an id rated
several times has its lowest grade; null and empty texts have no features and get
the score 0; with no ratings every text has tail probability 0.5; repeated rows
get equal scores; an empty table gives an empty result; further columns pass
through, ones named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm import words as W
from lotledger.llm.columns import add_columns, steps

BUCKETS = 1 << 20
SAMPLE_ROWS = 8000
MIN_TEXTS = 8
MIN_SCORE = 4.5
EPOCHS = 40
RIDGE = 1e-4
SELECT_FROM = 0.5

#: Lengths of word beginnings, in bytes.
BEGINNINGS = (5, 6, 7, 8)

_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_SIGNS, b" " * len(_SIGNS))
#: Shape classes of bytes: small letter, capital, digit, other sign, beyond ASCII.
_SHAPE = np.full(256, 4, np.uint8)
_SHAPE[:128] = 3
_SHAPE[ord("a") : ord("z") + 1] = 0
_SHAPE[ord("A") : ord("Z") + 1] = 1
_SHAPE[ord("0") : ord("9") + 1] = 2


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), distinct, of a column."""
    low = pa.array([(t.as_py() or "").lower().encode().translate(_PLAIN).decode() for t in texts], pa.string())
    owner, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in W.slices(low):
        owner.append(part.row + part.owner)
        bucket.append((part.hashes(1) % np.uint64(BUCKETS)).astype(np.int64))
        for k in BEGINNINGS:
            longer = np.flatnonzero(part.ends - part.starts >= k)
            begins = (part.hashes(k + 2, k)[longer] % np.uint64(1 << 40)).astype(np.int64)
            order = np.lexsort((begins, part.owner[longer]))
            text, begins = part.owner[longer][order], begins[order]
            first = np.flatnonzero(np.diff(text, prepend=-1).astype(bool) | np.diff(begins, prepend=-1).astype(bool))
            n = np.diff(first, append=len(text))
            for least in (1, 2, 4):
                some = first[n >= least]
                owner.append(part.row + text[some])
                bucket.append((W.mix64(begins[some].astype(np.uint64) + np.uint64(least << 50)) % np.uint64(BUCKETS)).astype(np.int64))
    for part in W.slices(texts):
        if not len(part.starts):
            continue
        # Of each word: the classes of its first and last two signs; of each text: which share has each shape.
        last = part.ends - 1
        shape = (_SHAPE[part.data[part.starts]] * 5 + _SHAPE[part.data[np.maximum(last - 1, part.starts)]]) * 5 + _SHAPE[part.data[last]]
        key, n = np.unique(part.owner * 125 + shape, return_counts=True)
        text = key // 125
        tenth = np.minimum(9, 10 * n // part.counts[text])
        owner.append(part.row + text)
        bucket.append((W.mix64((key % 125 * 10 + tenth).astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(BUCKETS)).astype(np.int64))
        # How much of the text is words said before, in tenths.
        again = part.counts - np.bincount(np.unique(part.owner * (1 << 20) + (part.hashes(2) % np.uint64(1 << 20)).astype(np.int64)) >> 20, minlength=len(part))
        some = np.flatnonzero(part.counts)
        tenth = 10 * again[some] // part.counts[some]
        owner.append(part.row + some)
        bucket.append((W.mix64(tenth.astype(np.uint64) + np.uint64(1 << 41)) % np.uint64(BUCKETS)).astype(np.int64))
    key = np.unique(np.concatenate(owner) * BUCKETS + np.concatenate(bucket))
    return key // BUCKETS, key % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, bucket = features(texts)
        return np.bincount(owner, self.weights[bucket], len(texts)) if len(texts) else np.zeros(0)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1 (texts x K - 1)."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _telling(owner: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """Which buckets enough texts hold, at rates that differ between the grades below and above some cut."""
    n, every = len(grade), np.bincount(bucket, minlength=BUCKETS)
    rate, most = every / n, np.zeros(BUCKETS)
    for k in range(1, grades):
        low = grade < k
        a, b = low.sum(), n - low.sum()
        if a and b:
            below = np.bincount(bucket[low[owner]], minlength=BUCKETS)
            spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / a + 1 / b))
            most = np.maximum(most, np.abs(below / a - (every - below) / b) / spread)
    return (every >= MIN_TEXTS) & (most >= MIN_SCORE)


def fit(owner: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: int, epochs: int = EPOCHS, ridge: float = RIDGE) -> Model:
    """Stochastic gradient with adaptive steps on the cumulative-link likelihood. Thresholds are
    kept in order by learning the first one and the logarithms of the gaps."""
    weights = np.zeros(BUCKETS)
    n = len(grade)
    share = np.array([(grade <= k).mean() if n else (k + 1) / grades for k in range(grades - 1)]).clip(0.01, 0.99)
    cuts = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cuts), 0.05))
    first = cuts[:1].copy()
    if not n:
        return Model(weights, np.zeros(grades - 1))
    held = _telling(owner, bucket, grade, grades)
    owner, bucket = owner[held[bucket]], bucket[held[bucket]]
    begin = np.searchsorted(owner, np.arange(n + 1))
    seen, seen_cut = np.full(BUCKETS, 1e-2), np.full(grades - 1, 1e-2)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 64)):
            lengths = begin[rows + 1] - begin[rows]
            at = np.repeat(begin[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            local, b = np.repeat(np.arange(len(rows)), lengths), bucket[at]
            cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
            score, y = np.bincount(local, weights[b], len(rows)), grade[rows]
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            hi, lo = _sigmoid(edges[y + 1] - score), _sigmoid(edges[y] - score)
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = -hi * (1 - hi) / p, lo * (1 - lo) / p  # of -log p by the upper and lower edge
            slope = -(d_hi + d_lo)
            g = np.bincount(b, slope[local], BUCKETS) / len(rows)
            hit = np.unique(b)
            g = g[hit] + ridge * weights[hit]
            seen[hit] += g * g
            weights[hit] -= 0.1 * g / np.sqrt(seen[hit])
            by_cut = np.array([d_hi[y == k].sum() + d_lo[y == k + 1].sum() for k in range(grades - 1)]) / len(rows)
            onward = np.cumsum(by_cut[::-1])[::-1]
            step = np.concatenate([onward[:1], onward[1:] * np.exp(gaps)])
            seen_cut += step * step
            step = 0.05 * step / np.sqrt(seen_cut)
            first -= step[:1]
            gaps -= step[1:]
    return Model(weights, np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def learn(docs: DataFrame, ratings: DataFrame, grade: str = "grade", id_col: str = "doc_id", text: str = "text", grades: int | None = None,
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the texts of at most ``sample_rows`` rated ids. The sample's ids are broadcast (they
    are bounded by the parameter), its features gathered on the driver."""
    rated = ratings.select(F.col(id_col).alias("i"), F.col(grade).cast("int").alias("g")).filter("i IS NOT NULL AND g IS NOT NULL")
    rated = rated.groupBy("i").agg(F.min("g").alias("g"))
    some = rated.orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t")).join(F.broadcast(some), "i").select("g", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            owner, bucket = features(batch.column("t"))
            upto = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(bucket, pa.int32()))], names=["g", "buckets"]
            )

    rows = texts.mapInArrow(run, "g int, buckets array<int>").toArrow().sort_by("g")
    lists = rows.column("buckets").combine_chunks()
    y = rows.column("g").to_numpy()
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())) if len(y) else np.zeros(0, np.int64)
    bucket = lists.flatten().to_numpy().astype(np.int64)
    return fit(owner, bucket, y, grades or (int(y.max()) + 1 if len(y) else 2))


def grade_texts(docs: DataFrame, model: Model, text: str = "text", expected: str = "expected_grade", tails: str = "tails", kept: str = "kept",
                select_from: float = SELECT_FROM) -> DataFrame:
    """Every row with its expected grade, its tail probabilities, and whether the top grade has
    probability ``select_from`` or more."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch):
        m = broadcast.value
        p = m.tails(m.scores(batch.column(text)))
        upto = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
        return {expected: pa.array(p.sum(axis=1)), tails: pa.ListArray.from_arrays(upto, pa.array(p.ravel())), kept: pa.array(p[:, -1] >= select_from)}

    return add_columns(docs, compute, {expected: "double", tails: "array<double>", kept: "boolean"})


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table: 0 toxic, 1 of low quality, 2 good. Toxic is the end of
    the scale, where every further sign of it points the same way."""
    bad, toxic = F.col("quality") == 0, F.coalesce(F.col("toxic"), F.lit(0)) == 1
    grade = F.when(F.col("quality").isNotNull(), F.when(toxic, 0).when(bad, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))
