"""Personal data: base spans, and identifiers found by bootstrapped contexts.

Base spans come from four fixed patterns (email, ip, card, phone), each leftmost
and non-overlapping in its kind; a match that fails its check is dropped without
a retry. They are also the seeds of the bootstrapping:

* a mention is a base span, or an identifier-like word (``MIN_LENGTH`` or more code
  points with a digit among them) or run of digit groups joined by single spaces
  (as long) that overlaps no base span; its instance is its value. The floor is
  there because an accepted instance is taken wherever it stands, and a shorter
  number stands in many places that have nothing to do with it;
* its lexical patterns are the word before it, the word after it, and both;
* the graph of patterns and instances is scored in rounds. A pattern's confidence
  for a kind is the share of its distinct instances that are known to be of that
  kind, if at least ``MIN_SUPPORT`` are; it is trusted from ``PATTERN_TRUST`` on.
  A new instance's score is 1 - the product of (1 - confidence) over its trusted
  patterns, and it is accepted from ``INSTANCE_TRUST`` on, so that one pattern
  alone does not do unless it is nearly certain. Accepted instances are known in
  the next round, with the kind they were accepted for, and rounds go on until one
  accepts no new instance.

Mentions of accepted instances are added to the spans. All of it is DataFrame
work: positions come from the lengths of the parts that a pattern splits a text
into, and the graph is a few equality joins and two aggregates a round over edges
that are distinct beforehand. A context or a copied text that holds a third of
all mentions is reduced to its distinct edges before any shuffle by it.

Defined results: null and empty text have no spans; rows are kept as they are,
equal texts get equal spans; an empty table gives an empty result; further
columns pass through, ones named like an added column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions.text import bound, sealed
from lotledger.llm.columns import unused
from lotledger.session import settle

#: Rounds of the loops in the tests; ``discover`` goes on until nothing new is accepted.
ROUNDS = 3
MIN_SUPPORT = 3
MIN_LENGTH = 6
CHUNK = 128
PATTERN_TRUST = 0.8
INSTANCE_TRUST = 0.9

#: Kinds in their order. The patterns match what the plain forms in the comments match: a run is
#: taken whole (possessive), and tried from its first character or the end of the match before.
KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
_GATES = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}"}
_WORD_WITH_DIGIT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_GROUP = r"\x20[().+/-]*+[0-9][0-9().+/-]*+"
_END = r"(?![^\x20\x09-\x0D])"
#: Two or more words of digits and marks, one space between them; marks that end a clause only after the last.
_GROUPS = rf"(?<![^\x20\x09-\x0D]){_GROUP[4:]}{_END}(?:(?:{_GROUP}{_END})++(?:{_GROUP}[,;:!?]++{_END})?+|{_GROUP}[,;:!?]++{_END})"

_SPAN = "array<struct<start:int,end:int,turn:int,kind:string,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _gate(kind: str, text: Column) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike(_GATES[kind]) if kind in _GATES else F.lit(True))


def _found(text: Column, pattern: str, kind: str | None) -> Column:
    """Matches with their places and neighbouring words. The parts between matches and the matches
    themselves, laid end to end, are the text: a running sum of lengths places them."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    spaced = lambda g: F.translate(g, "\t\n\x0b\f\r", "     ")

    def rows(p: Column) -> Column:
        around = lambda h, i: F.struct(h.alias("hit"), F.get(p["gaps"], i).alias("gap"), F.get(p["gaps"], i + 1).alias("after"))
        return F.transform(p["hits"], around)

    turn = KINDS.index(kind) if kind else len(KINDS)
    none = F.array().cast(_SPAN)

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(
            begin.alias("start"), end.alias("end"), F.lit(turn).alias("turn"), F.lit(kind).cast("string").alias("kind"), x["hit"].alias("value"),
            F.lower(F.substring_index(F.rtrim(spaced(x["gap"])), " ", -1)).alias("left"),
            F.lower(F.substring_index(F.ltrim(spaced(x["after"])), " ", 1)).alias("right"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(r: Column) -> Column:
        """In chunks: a sum that appends copies what it has, so it must not run over all matches of a long text."""
        chunk = lambda c: F.slice(r, c * CHUNK + 1, F.lit(CHUNK))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int")), chunk)
        width = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x["gap"]) + F.length(x["hit"]))
        before = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        more = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        begins = lambda cs: F.aggregate(F.transform(cs, width), before, more, lambda a: a["out"])
        begin = lambda at: F.struct(at.alias("at"), none.alias("out"))
        spans = lambda cs, at: F.transform(cs, lambda c, i: F.aggregate(c, begin(F.get(at, i)), step, lambda a: a["out"]))
        all_of = lambda cs: bound(begins(cs), lambda at: F.flatten(spans(cs, at)))
        return F.when(F.size(r) > 0, bound(chunks, all_of)).otherwise(none)

    return bound(parts, lambda p: bound(rows(p), placed))


def _base(text: Column) -> Column:
    none = F.array().cast(_SPAN)

    def of(kind: str) -> Column:
        good = F.filter(_found(text, _PATTERNS[kind], kind), lambda s: _valid(kind, s["value"]))
        return F.when(_gate(kind, text), good).otherwise(none)

    return F.array_sort(F.concat(*map(of, KINDS)))


def _scan(docs: DataFrame, text: str) -> DataFrame:
    """(_k1, _k2, _base, _more) beside the columns: the text's key, base spans, and the
    identifier-like words and runs of digit groups outside them."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    of = lambda gate, pattern: F.when(t.rlike(gate), _found(t, pattern, None)).otherwise(F.array().cast(_SPAN))
    words = F.concat(of("[0-9]", _WORD_WITH_DIGIT), of(_GROUPS, _GROUPS))

    def split(x: Column) -> Column:
        free = lambda w: ~F.exists(x["base"], lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"]))
        long = lambda w: w["end"] - w["start"] >= MIN_LENGTH
        return F.struct(x["base"].alias("base"), F.filter(x["words"], lambda w: long(w) & free(w)).alias("more"))

    # Sealed: were the spans' expression merged into the steps above it, it would run for each word.
    found = sealed(bound(F.struct(_base(t).alias("base"), words.alias("words")), split))
    out = docs.select("*", F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"), found.alias("_found"))
    return out.withColumns({"_base": F.col("_found.base"), "_more": F.col("_found.more")}).drop("_found")


def _edges(scanned: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, kind): kind is null for identifier-like words."""
    m = scanned.select(F.explode(F.concat("_base", "_more")).alias("m"))
    left, right = F.col("m.left"), F.col("m.right")
    both = F.concat(F.lit("B:"), left, F.lit(" "), right)
    patterns = F.array(F.when(left != "", F.concat(F.lit("L:"), left)), F.when(right != "", F.concat(F.lit("R:"), right)), F.when((left != "") & (right != ""), both))
    e = m.select(F.explode(patterns).alias("pattern"), F.col("m.value").alias("instance"), F.col("m.kind").alias("kind"))
    return e.filter("pattern IS NOT NULL").distinct()


def discover(scanned: DataFrame, min_support: int = MIN_SUPPORT, pattern_trust: float = PATTERN_TRUST,
             instance_trust: float = INSTANCE_TRUST) -> DataFrame:
    """(instance, kind, score): the identifier-like words and runs that trusted patterns vouch for."""
    edges = settle(_edges(scanned))
    known = None
    while True:
        e = edges
        if known is not None:
            learnt = known.select(F.col("instance").alias("i"), F.col("kind").alias("learnt"))
            e = edges.join(learnt, (F.col("instance") == F.col("i")) & F.col("kind").isNull(), "left")
            e = e.select("pattern", "instance", F.coalesce("kind", "learnt").alias("kind"))
        # One pattern's counts by kind, side by side: a hot pattern is one row after the first, partial step.
        counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS]
        p = e.groupBy("pattern").agg(F.count("*").alias("n"), *counts)
        best = F.greatest(*(F.struct(F.col(k).alias("c"), F.lit(-i).alias("o")) for i, k in enumerate(KINDS)))
        p = p.withColumn("best", best).select(
            F.col("pattern").alias("p"), F.element_at(F.array(*map(F.lit, KINDS)), (1 - F.col("best.o")).cast("int")).alias("p_kind"),
            F.col("best.c").alias("support"), (F.col("best.c") / F.col("n")).alias("confidence"),
        )
        p = p.filter((F.col("support") >= min_support) & (F.col("confidence") >= pattern_trust))
        hits = edges.filter("kind IS NULL").join(p, F.col("pattern") == F.col("p"))
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        s = hits.groupBy("instance", "p_kind").agg((1 - F.exp(doubt)).alias("score"))
        s = s.groupBy("instance").agg(F.max_by(F.struct("p_kind", "score"), F.struct("score", "p_kind")).alias("b"))
        accepted = s.select("instance", F.col("b.p_kind").alias("kind"), F.col("b.score").alias("score")).filter(F.col("score") >= instance_trust)
        fresh = settle(accepted if known is None else accepted.join(known, "instance", "left_anti"))
        if fresh.isEmpty():
            return fresh if known is None else known
        known = fresh if known is None else settle(known.unionByName(fresh))


def _spans(df: DataFrame, scanned: DataFrame, base: str, spans: str) -> DataFrame:
    """df holds the scan's columns; adds base spans and all spans, ordered by start and kind."""
    known = discover(scanned)
    words = scanned.select("_k1", "_k2", F.explode("_more").alias("m")).select("_k1", "_k2", "m.start", "m.end", "m.value").distinct()
    turn = reduce(lambda c, i: F.when(F.col("kind") == KINDS[i], i).otherwise(c), range(len(KINDS)), F.lit(len(KINDS)))
    added = words.join(known, F.col("value") == F.col("instance")).withColumn("turn", turn)
    added = added.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "end", "turn", "kind")).alias("_added"))
    added = added.select(F.col("_k1").alias("_a1"), F.col("_k2").alias("_a2"), "_added")
    out = df.join(added, (F.col("_k1") == F.col("_a1")) & (F.col("_k2") == F.col("_a2")), "left")
    plain = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["turn"].alias("turn"), s["kind"].alias("kind")))
    every = F.array_sort(F.concat(plain, F.coalesce("_added", F.expr("slice(array(named_struct('start',0,'end',0,'turn',0,'kind','')),1,0)"))))
    return out.withColumns({base: plain, spans: every}).drop("_a1", "_a2", "_added")


def find(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """Every row, without its text, with its base spans and all its spans: arrays of (start, end,
    turn, kind), in code points, ordered by start and kind. The text is read once."""
    kept = [c for c in docs.columns if c not in (text, base, spans)]
    # The caller's columns travel in one struct, so that no name meets one of the scan.
    row = F.struct(F.lit(0).alias(unused(docs, "row")), *(F.col(f"`{c}`") for c in kept))
    scanned = settle(_scan(docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text")), "_text").select("_row", "_k1", "_k2", "_base", "_more"))
    found = _spans(scanned, scanned, "_b", "_s")
    return found.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), F.col("_b").alias(base), F.col("_s").alias(spans))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its spans replaced by <KIND>; spans that overlap become one, named after the
    first. Rows keep their columns and order of columns; null text stays null."""
    key, scan_text, spans = (unused(docs, x) for x in ("key", "t", "spans"))
    distinct = docs.select(F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL")
    scanned = settle(_scan(distinct, "t").select("_k1", "_k2", "_base", "_more"))
    found = _spans(scanned, scanned, "b", "s").filter("size(s) > 0")
    found = found.groupBy("_k1", "_k2").agg(F.min("s").alias(spans)).select(F.col("_k1").alias(f"{key}1"), F.col("_k2").alias(f"{key}2"), spans)
    t = F.col(f"`{text}`")
    out = docs.join(found, (F.xxhash64(t) == F.col(f"{key}1")) & (F.xxhash64(F.lit(1), t) == F.col(f"{key}2")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], t.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))))
    masked = F.when(F.col(spans).isNull(), t).otherwise(whole)
    return out.select(*(masked.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
