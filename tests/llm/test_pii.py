"""Base spans against plain regular expressions; bootstrapping against loops."""

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lotledger.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for turn, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), m.end(), turn, kind))
    return sorted(out)


def got(df):
    return {r["doc_id"]: r for r in pii.find(df).collect()}


TEXTS = [
    None, "", "a.b@c.d_e@f.g@h.i x@y @z.w a@b. a@b..c q@r.s.t.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 999999999999.1.1.1 1.2.3.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 12345678901234567890123", "+1 (724) 555-7058 +49 30 1234567). +12 +1+2345678901 +1234567890123456",
    "é😀 x@y.zz 😀 +44 20 7946 0958 ü 10.0.0.255.", "x@y.z" * 50, "1" * 4000 + ".2.3.4", "a" * 5000, "+1 4111111111111111 8.8.8.8@x.y", "\n\t5105105105105100\r\n",
    "٣٤.1.1.1 ١.١.١.١ x٣@y.z",
]


def random_texts(n):
    r = random.Random(11)
    pool = ["@", ".", "-", " ", "+", "(", ")", "1", "23", "4111111111111111", "a", "x.y", "é", "😀", "%", "_", "\n", "10.0.0.1", "@mail.example.com", "+1 555 123 4567"]
    return ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(n)]


def test_base_spans_match_the_plain_patterns(documents):
    texts = TEXTS + random_texts(400)
    rows = got(documents(list(enumerate(texts))))
    for i, t in enumerate(texts):
        assert [tuple(s) for s in rows[i]["base_spans"]] == base(t), t
        assert set(map(tuple, rows[i]["base_spans"])) <= set(map(tuple, rows[i]["spans"]))


def bootstrap(texts):
    """(doc, start, end, kind) that the method adds, by loops."""
    mentions = []
    for i, t in texts:
        spans = base(t)
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", t or "")]
        free = [(a, b, 4, None) for a, b in words if b - a >= pii.MIN_LENGTH and not any(s[0] < b and s[1] > a for s in spans)]
        groups = [[s for s in spans if s[2] == k] for k in range(4)] + [free]
        for g in groups:
            everything = g
            if g and g is not free:  # neighbours lie between all matches of the kind, failed ones too
                kind = g[0][3]
                everything = [(m.start(), m.end()) for m in re.finditer(BASE[kind], t)]
            elif g is free:
                everything = words
            for s in g:
                at = [x[:2] for x in everything].index(s[:2])
                lo = everything[at - 1][1] if at else 0
                hi = everything[at + 1][0] if at + 1 < len(everything) else len(t)
                left = re.findall(r"[^\x20\x09-\x0D]+", t[lo : s[0]]) or [""]
                right = re.findall(r"[^\x20\x09-\x0D]+", t[s[1] : hi]) or [""]
                left = left[-1].lower() if t[lo : s[0]].strip(" \t\n\v\f\r") else ""
                right = right[0].lower() if t[s[1] : hi].strip(" \t\n\v\f\r") else ""
                mentions.append((i, s[0], s[1], s[3], t[s[0] : s[1]], left, right))
    edges = set()
    for _, _, _, kind, value, left, right in mentions:
        if left:
            edges.add(("L:" + left, value, kind))
        if right:
            edges.add(("R:" + right, value, kind))
        if left and right:
            edges.add((f"B:{left} {right}", value, kind))
    known = {}
    for _ in range(pii.ROUNDS):
        by = defaultdict(list)
        for p, v, k in edges:
            by[p].append(k or known.get(v))
        trusted = {}
        for p, kinds in by.items():
            best = max(pii.KINDS, key=lambda k: (kinds.count(k), -pii.KINDS.index(k)))
            if kinds.count(best) >= pii.MIN_SUPPORT and kinds.count(best) / len(kinds) >= pii.PATTERN_TRUST:
                trusted[p] = (best, kinds.count(best) / len(kinds))
        doubt = defaultdict(float)
        for p, v, k in edges:
            if k is None and p in trusted:
                doubt[v, trusted[p][0]] += math.log(max(1e-9, 1 - trusted[p][1]))
        known = {}
        for v in {v for v, _ in doubt}:
            score, kind = max((1 - math.exp(d), k) for (w, k), d in doubt.items() if w == v)
            if score >= pii.INSTANCE_TRUST:
                known[v] = kind
    return {(i, a, b, known[v]) for i, a, b, k, v, _, _ in mentions if k is None and v in known}


def contexts():
    r = random.Random(4)
    names = ["ana", "bo", "cy", "di"]
    out = []
    for i in range(60):
        out.append(f"please write to user{i}@mail.example.com or wait {r.choice(names)}")
        out.append(f"call me on +1 555 01{i:02d} 2{i:02d}9 today {r.choice(names)}")
    for i in range(8):
        out.append(f"please write to user{i}(at)mail or wait")
        out.append(f"call me on 555-01{i:02d}-{i:02d}19 today")
        out.append(f"chapter {i} has 1{i} pages of 199{i}")
    out += ["handle user1(at)mail alone", "user1(at)mail", "room 5 or 6"]
    return list(enumerate(out))


def test_discovers_what_contexts_vouch_for(documents):
    texts = contexts()
    want = bootstrap(texts)
    assert any(k == "email" for *_, k in want) and any(k == "phone" for *_, k in want)
    rows = got(documents(texts))
    added = {(i, s["start"], s["end"], s["kind"]) for i, r in rows.items() for s in r["spans"] if s not in r["base_spans"]}
    assert added == want
    assert not any(i for i, *_ in added if "chapter" in texts[i][1])


def test_mask_replaces_spans(documents):
    texts = contexts()[:20] + [(900, None), (901, ""), (902, "mail x@y.zz\nand +1 555 123 4567, 4111111111111111 é"), (902, "mail x@y.zz\nand +1 555 123 4567, 4111111111111111 é")]
    df = documents(texts).withColumn("kind", F.lit("k")).withColumn("spans", F.lit(1)).withColumn("_base", F.lit(2))
    out = pii.mask(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[900] is None and by[901] == ""
    assert by[902] == "mail <EMAIL>\nand <PHONE>, <CARD> é"
    assert not any(base(t) for t in by.values())


def test_repeated_rows_empty_table_and_clashing_columns(documents):
    assert pii.find(documents([])).collect() == []
    assert pii.mask(documents([])).collect() == []
    df = documents([(1, "a@b.cc"), (1, "a@b.cc"), (None, "a@b.cc")]).withColumn("start", F.lit(0)).withColumn("spans", F.lit("x")).withColumn("_k1", F.lit("k"))
    rows = pii.find(df).collect()
    assert len(rows) == 3 and all(len(r["spans"]) == 1 and r["start"] == 0 and r["_k1"] == "k" for r in rows)


def test_runs_of_digit_groups_are_found(documents):
    texts = [f"call me on +1 555 01{i:02d} 2{i:02d}9 today" for i in range(60)] + [
        "call me on 555 014 0199 today", "call me on (030) 12 34567 today", "ring 555 014 0199", "1 2 3 4 5 6 7 8",
    ]
    rows = got(documents(list(enumerate(texts))))
    added = {(i, texts[i][s["start"] : s["end"]], s["kind"]) for i, r in rows.items() for s in r["spans"] if s not in r["base_spans"]}
    assert added == {(60, "555 014 0199", "phone"), (61, "(030) 12 34567", "phone"), (62, "555 014 0199", "phone")}


def test_rounds_go_on_until_nothing_is_new(documents):
    near = "abcdefg"
    texts = [f"prea mail{j}@a.bc posta" for j in range(9)] + ["prea word1n0 posta", "prea word1n1 posta"]
    for k in range(1, 7):
        texts += [f"pre{near[k]} mail{k}x{j}@a.bc post{near[k]}" for j in range(7)]
        texts += [f"pre{near[k]} word{n}n{j} post{near[k]}" for n in (k, k + 1) for j in range(2)]
    rows = got(documents(list(enumerate(texts))))
    added = {texts[i][s["start"] : s["end"]] for i, r in rows.items() for s in r["spans"] if s not in r["base_spans"]}
    assert added == {f"word{k}n{j}" for k in range(1, 8) for j in range(2)}
