"""Quality rules as a short-circuit cascade.

Each rule is a predicate over features of a text. On a sample the cascade
measures what each feature costs (seconds a text) and what share of texts each
rule rejects; rules then run in the order of rejection per cost (greedy, each
next rule measured on the texts that the earlier ones left, so that correlated
rules don't count twice). In a run each rule sees only texts that no earlier
rule rejected, and a feature is computed when the first rule asks for it, only
for those texts. The order changes the cost, never the verdict: a text is
rejected if any rule rejects it.

Defined results: null text counts as empty; a text without words has zero
counts and is rejected by the base rule; repeated rows get the same verdict; an
empty table gives an empty result and the rules' listed order; further columns
pass through, ones named like an added column are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm import words as W
from lotledger.llm.columns import add_columns

SAMPLE_ROWS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Features:
    """Features of the texts of a slice, each computed once and only for the texts
    still alive when it is first asked for (others hold 0)."""

    def __init__(self, part: W.Slice):
        self.part = part
        self.alive = np.ones(len(part), bool)
        self.seconds: dict[str, float] = {}
        self._known: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            began = time.perf_counter()
            self._known[name] = FEATURES[name](self)
            self.seconds[name] = time.perf_counter() - began
        return self._known[name]

    def per_text(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.part.offsets[1:]] - total[self.part.offsets[:-1]]

    def alive_words(self) -> tuple[W.Slice, np.ndarray]:
        """The slice reduced to words of texts still alive, and those texts' rows."""
        p, rows = self.part, np.flatnonzero(self.alive)
        if len(rows) == len(p):
            return p, rows
        take = np.concatenate([np.arange(p.first[r], p.first[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(p.counts[rows])])
        return W.Slice(p.row, p.data, np.zeros(len(rows) + 1, np.int64), p.starts[take], p.ends[take], first), rows


def _n_words(f: Features) -> np.ndarray:
    return f.part.counts.astype(np.int64)


def _word_chars(f: Features) -> np.ndarray:
    data = f.part.data
    return f.per_text(~W._SPACE[data] & ((data & 0xC0) != 0x80))


def _n_symbols(f: Features) -> np.ndarray:
    return f.per_text(_SYMBOL[f.part.data])


def _n_alpha_words(f: Features) -> np.ndarray:
    """Words that begin and end in a letter, a trailing comma or stop aside; bytes
    past ASCII count as letters."""
    p = f.part
    if not len(p.starts):
        return np.zeros(len(p), np.int64)
    letter = np.zeros(256, bool)
    letter[128:] = True
    letter[ord("a") : ord("z") + 1] = letter[ord("A") : ord("Z") + 1] = True
    last = p.ends - 1
    stop = np.isin(p.data[last], np.frombuffer(b".,;:", np.uint8)) & (last > p.starts)
    good = np.concatenate([[0], np.cumsum(letter[p.data[p.starts]] & letter[p.data[last - stop]])])
    return good[p.first[1:]] - good[p.first[:-1]]


def _n_dup_lines(f: Features) -> np.ndarray:
    out = np.zeros(len(f.part), np.int64)
    o = f.part.offsets
    for i in np.flatnonzero(f.alive):
        text = f.part.data[o[i] : o[i + 1]].tobytes()
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            out[i] = len(lines) - len(set(lines))
    return out


def _n_repeat_words(f: Features) -> np.ndarray:
    """Words inside a three-word window that the text holds twice or more."""
    out = np.zeros(len(f.part), np.int64)
    if not f.alive.any():
        return out
    hashes = f["_hashes"]
    p, rows = f.part, np.flatnonzero(f.alive)
    at, grams = p.shingles(hashes, 3)
    owner = p.owner
    live = f.alive[owner[at]]
    at, grams = at[live], grams[live]
    if not len(at):
        return out
    key = W.mix64(grams + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    covered = np.zeros(len(owner), bool)
    for j in range(3):
        covered[hit + j] = True
    out[:] = np.bincount(owner[covered], minlength=len(p))
    out[np.setdiff1d(np.arange(len(p)), rows)] = 0
    return out


FEATURES: dict[str, Callable[[Features], np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_alpha_words": _n_alpha_words,
    "n_dup_lines": _n_dup_lines,
    "_hashes": lambda f: f.part.hashes(),
    "n_repeat_words": _n_repeat_words,
    "n_lines": lambda f: f.per_text(f.part.data == ord("\n")) + 1,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``test`` holds."""

    name: str
    test: Callable[[Features], np.ndarray]


#: Rules that decide the base verdict.
BASE = (
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeated_phrases", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)

#: Rules of the published web-corpus heuristics, as wide margins round ordinary prose.
RULES = (
    *BASE,
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("symbols", lambda f: 5 * f["n_symbols"] > f["n_words"]),
    Rule("not_words", lambda f: 100 * f["n_alpha_words"] < 60 * f["n_words"]),
    Rule("repeated_lines", lambda f: (f["n_dup_lines"] > 2) & (10 * f["n_dup_lines"] > 3 * f["n_lines"])),
)


def measure(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules in the order of rejection per cost on these texts.

    Ties, and rules that reject nothing, keep the cheaper first and then the listed order.
    """
    parts = [Features(p) for p in W.slices(texts)]
    tests = {r.name: [] for r in rules}
    cost = dict.fromkeys(tests, 0.0)
    for f in parts:
        for r in rules:
            known = set(f.seconds)
            began = time.perf_counter()
            tests[r.name].append(r.test(f))
            cost[r.name] += time.perf_counter() - began
            # Features that an earlier rule has paid for here are charged as well: which comes first isn't known yet.
            cost[r.name] += sum(f.seconds[k] for k in known & _uses(r, f))
    left = {k: np.concatenate(v) if v else np.zeros(0, bool) for k, v in tests.items()}
    order, rest = [], list(rules)
    while rest:
        best = max(rest, key=lambda r: (left[r.name].sum() / max(cost[r.name], 1e-9), -cost[r.name] * (not left[r.name].any())))
        order.append(best)
        rest.remove(best)
        alive = ~left[best.name]
        left = {r.name: left[r.name][alive] for r in rest}
    return order


def _uses(rule: Rule, f: Features) -> set[str]:
    class Probe:
        def __init__(self):
            self.asked = set()

        def __getitem__(self, name):
            self.asked.add(name)
            return f[name]

    probe = Probe()
    rule.test(probe)
    return probe.asked | ({"_hashes"} if "n_repeat_words" in probe.asked else set())


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order the rules on a random sample of about ``sample_rows`` whole texts. The sample decides
    only what a run costs."""
    share = min(1.0, 1.2 * sample_rows / max(docs.count(), 1))
    picked = docs.select(F.col(text).alias("t")).sample(share, 7).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.chunked_array([b.column(0) for b in batches], pa.string())
        names = [r.name for r in measure(texts, rules)] if len(texts) else []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    names = [r.name for r in picked.coalesce(1).mapInArrow(run, "name string").collect()]
    by = {r.name: r for r in rules}
    return [by[n] for n in names] if len(names) == len(rules) else list(rules)


def verdicts(f: Features, rules: list[Rule]) -> np.ndarray:
    """The place of the first rule that rejects each text, -1 for none."""
    out = np.full(len(f.part), -1)
    for i, rule in enumerate(rules):
        hit = f.alive & rule.test(f)
        out[hit] = i
        f.alive &= ~hit
        if not f.alive.any():
            break
    return out


def cascade(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, rejected_by: str = "rejected_by") -> DataFrame:
    """Every row with the name of the rule that rejected it, null if none did."""
    rules = order_rules(docs, text) if rules is None else rules
    names = np.array([*(r.name for r in rules), None], object)

    def compute(batch):
        parts = [verdicts(Features(p), rules) for p in W.slices(batch.column(text))]
        found = np.concatenate(parts) if parts else np.zeros(0, int)
        return {rejected_by: pa.array(names[found], pa.string())}

    return add_columns(docs, compute, {rejected_by: "string"})


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def report(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Every row with the five counts, the base verdict and the cascade's verdict. The counts are
    asked for on every text, so they are taken before the cascade runs on what the base rules left."""
    rules = order_rules(docs, text) if rules is None else rules

    def compute(batch):
        out = {k: [np.zeros(0, np.int64)] for k in COUNTS} | {"base_failed": [np.zeros(0, bool)], "kept": [np.zeros(0, bool)]}
        for p in W.slices(batch.column(text)):
            f = Features(p)
            for k in COUNTS:
                out[k].append(f[k])
            failed = np.logical_or.reduce([r.test(f) for r in BASE])
            f.alive &= ~failed
            out["base_failed"].append(failed)
            out["kept"].append((verdicts(f, rules) < 0) & ~failed)
        return {k: pa.array(np.concatenate(v)) for k, v in out.items()}

    return add_columns(docs, compute, dict.fromkeys(COUNTS, "long") | {"base_failed": "boolean", "kept": "boolean"})
