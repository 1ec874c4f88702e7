"""Languages of a text by mixture inference over character n-grams.

A text's letters, in lower case, give its n-grams: trigrams of letters and word
edges, hashed into ``BUCKETS``. Learning counts them for each language over all
labelled texts; a language is then a smoothed distribution over buckets. A text
is taken as a mixture: expectation-maximisation estimates the share of each
language from the likelihoods of its n-grams. The set of languages is chosen by
penalised likelihood: each language beyond the first costs half the logarithm of
the number of n-grams, and sets grow in order of the shares in the full mixture
until a larger set no longer pays. Since the full mixture bounds every set, texts
where even it gains less than one language's cost are of one language at once.

The model has languages x ``BUCKETS`` numbers, whatever the size of the corpus.

Defined results: a null text and one without a letter are ``und`` with score 0
and no languages, as is every text if nothing was learned; ties go to the
language earlier in order; texts without a language, or without letters, teach
nothing; repeated rows count each; an empty table gives an empty result; further
columns pass through, ones named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm.columns import add_columns, steps

BUCKETS = 1 << 17
SMOOTHING = 0.2
ROUNDS = 30
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le"), np.uint32) if low else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one sign after each run of letters is its edge
    signs, owner, letter = np.where(letter, points, 0)[kept], owner[kept], letter[kept]
    if not len(signs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.roll(signs, 1), np.roll(signs, -1)
    before[0] = after[-1] = 0
    code = before * np.uint32(0x9E3779B1) ^ (signs * np.uint32(0x85EBCA6B)) ^ ((after + np.uint32(1)) * np.uint32(0xC2B2AE35))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return owner[letter], ((code ^ (code >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int64)[letter]


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> Model:
        names = sorted(counts)
        n = np.stack([counts[k] for k in names], axis=1).astype(np.float64) if names else np.zeros((BUCKETS, 0))
        return cls(names, (np.log(n + SMOOTHING) - np.log(n.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count the n-grams of all texts with a language; tasks add up their own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            langs = np.array(batch.column(1).to_pylist(), object)
            owner, bucket = ngrams(batch.column(0).to_pylist())
            for name in set(langs):
                counts = np.bincount(bucket[langs[owner] == name], minlength=BUCKETS)
                own[name] = own[name] + counts if name in own else counts
        for name, counts in own.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    labelled = docs.select(F.col(f"`{text}`"), F.col(f"`{lang}`")).filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = labelled.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, np.ndarray] = {}
    for name, part in rows.groupby("lang"):
        counts[name] = np.bincount(part["bucket"], part["n"], BUCKETS)
    return Model.of(counts)


def _em(start: np.ndarray, likelihood: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares (texts x languages) and mixed log likelihood of texts whose entries begin at ``start``."""
    lengths = np.diff(start, append=len(n))
    total = np.add.reduceat(n, start)[:, None]
    for _ in range(rounds):
        weight = np.repeat(share, lengths, axis=0)
        weight *= likelihood
        weight *= (n / weight.sum(axis=1))[:, None]
        new = np.add.reduceat(weight, start, axis=0) / total
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < 1e-3:
            break
    mixed = (np.repeat(share, lengths, axis=0) * likelihood).sum(axis=1)
    return share, np.add.reduceat(n * np.log(mixed), start)


def infer(model: Model, texts: list[str | None]) -> np.ndarray:
    """Shares (texts x languages); languages outside the chosen set, and texts without letters, have 0."""
    out = np.zeros((len(texts), len(model.languages)))
    owner, bucket = ngrams(texts)
    if not len(owner) or not model.languages:
        return out
    key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
    owner, n = key // BUCKETS, n.astype(np.float64)
    logp = model.logp[key % BUCKETS].astype(np.float64)
    peak = logp.max(axis=1, keepdims=True)
    likelihood = np.exp(logp - peak)
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    rows = owner[start]
    total, base = np.add.reduceat(n, start), np.add.reduceat(n * peak[:, 0], start)
    single = np.add.reduceat(n[:, None] * logp, start, axis=0)
    best = single.argmax(axis=1)
    out[rows, best] = 1.0
    chosen = single.max(axis=1)
    k = len(model.languages)
    if k == 1:
        return out
    full, most = _em(start, likelihood, n, np.full((len(rows), k), 1.0 / k))
    cost = 0.5 * np.log(np.maximum(total, 2))
    left = np.flatnonzero(most + base - cost > chosen)
    order = np.argsort(-full, axis=1, kind="stable")
    lengths = np.diff(start, append=len(n))
    for size in range(2, k + 1):
        if not len(left):
            break
        take = np.repeat(np.isin(np.arange(len(rows)), left), lengths)
        begin = np.cumsum(lengths[left]) - lengths[left]
        allowed = np.zeros((len(left), k))
        np.put_along_axis(allowed, order[left, :size], 1.0, axis=1)
        share, got = _em(begin, likelihood[take], n[take], allowed / size)
        got += base[left] - (size - 1) * cost[left]
        better = got > chosen[left]
        chosen[left[better]] = got[better]
        out[rows[left[better]]] = share[better]
        # A still larger set pays only if the full mixture leaves room for its cost.
        left = left[most[left] + base[left] - size * cost[left] > chosen[left]]
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", languages: str | None = "languages") -> DataFrame:
    """Every row with its main language, that language's share, and the whole set with shares."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch):
        m = broadcast.value
        names = np.array([*m.languages, UNKNOWN], object)
        shares = infer(m, batch.column(text).to_pylist())
        none = shares.sum(axis=1) == 0
        best = np.where(none, len(m.languages), shares.argmax(axis=1) if m.languages else 0)
        out = {lang: pa.array(names[best], pa.string()), score: pa.array(np.minimum(shares.max(axis=1, initial=0.0), 1.0))}
        if languages:
            order = np.argsort(-shares, axis=1, kind="stable")
            out[languages] = pa.array(
                [[{"lang": m.languages[j], "share": float(s[j])} for j in o if s[j] > 0] for s, o in zip(shares, order, strict=True)],
                pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])),
            )
        return out

    kinds = {lang: "string", score: "double"} | ({languages: "array<struct<lang:string,share:double>>"} if languages else {})
    return add_columns(docs, compute, kinds)
