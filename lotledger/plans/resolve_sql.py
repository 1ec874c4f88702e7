"""Oracle-side SQL for catalog resolution: every value against every option."""

from __future__ import annotations

from lotledger.functions.vocab import FEATURE_ACRONYMS, FEATURE_SYNONYMS, NUMERIC_PARENTS, SPEC_LABEL_HINTS
from lotledger.functions.text import ABBREVIATIONS
from lotledger.plans.parse_sql import fp, quoted

WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def tokens(c: str) -> str:
    kept = f"regexp_replace(regexp_replace(lower({c}), '([0-9])\\.', '\\1ȹ', 'g'), '\\.([0-9])', 'ȹ\\1', 'g')"
    return f"list_distinct({WORDS(f'''regexp_replace({kept}, '[^\\pL\\pN_\\s]', ' ', 'g')''')})"


def stem(c: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({c}, '^.{{3,}}ing$') THEN {c}[1:-4] WHEN regexp_matches({c}, '^.{{3,}}ed$') THEN {c}[1:-3] "
        f"WHEN regexp_matches({c}, '^.{{3,}}es$') THEN {c}[1:-3] WHEN regexp_matches({c}, '^.{{3,}}s$') THEN {c}[1:-2] ELSE {c} END)"
    )


def stem_tokens(c: str) -> str:
    words = WORDS(f"regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g')")
    full = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ABBREVIATIONS.items()) + " ELSE '' END"
    return (
        f"list_distinct(list_concat(list_transform({words}, lambda w: {stem('w')}), "
        f"list_transform(flatten(list_transform({words}, lambda w: list_filter(string_split({full}, ' '), lambda x: x <> ''))), lambda w: {stem('w')})))"
    )


def score(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN {n} = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST({n} AS DOUBLE) / (len({a}) + len({b}) - {n}), "
        f"CAST({n} AS DOUBLE) / least(len({a}), len({b})) * CAST(0.85 AS DOUBLE)) END"
    )


def resolve_ctes(values: str, options: str, out: str) -> str:
    """``values``: (scope, value); ``options``: (scope, id, name, alias, ord)."""
    p = out
    norm = lambda c: fp(c)
    return f"""{p}_v AS (SELECT DISTINCT scope, trim(value) AS value FROM {values}),
{p}_t AS (SELECT v.scope, v.value, o.id, o.name, o.ord, {score('o.t', 'v.t')} AS s FROM
    (SELECT *, {tokens('value')} AS t FROM {p}_v) v JOIN (SELECT *, {tokens('name')} AS t FROM {options}) o ON o.scope = v.scope),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY scope, value ORDER BY s DESC, ord) AS rn FROM {p}_t),
{p}_k AS (SELECT scope, value, max(CASE WHEN rn = 1 THEN s END) AS s1, coalesce(max(CASE WHEN rn = 2 THEN s END), 0) AS s2,
    max(CASE WHEN rn = 1 THEN id END) AS id1, max(CASE WHEN rn = 1 THEN name END) AS name1,
    coalesce(string_agg(CASE WHEN s >= CAST(0.35 AS DOUBLE) THEN concat(id, ':', CAST(CAST(round_even(s * 1000, 0) AS INT) AS STRING)) END, ';' ORDER BY rn), '') AS cands
    FROM {p}_r WHERE rn <= 5 GROUP BY scope, value),
{p}_e AS (SELECT v.scope, v.value, arg_min(o.id, o.ord) AS id, arg_min(o.name, o.ord) AS name FROM {p}_v v
    JOIN {options} o ON o.scope = v.scope AND (o.name = v.value OR o.alias = v.value) GROUP BY ALL),
{p}_n AS (SELECT v.scope, v.value, arg_min(o.id, o.ord) AS id, arg_min(o.name, o.ord) AS name FROM {p}_v v
    JOIN {options} o ON o.scope = v.scope AND ({norm('o.name')} = {norm('v.value')} OR (o.alias IS NOT NULL AND {norm('o.alias')} = {norm('v.value')})) GROUP BY ALL),
{out} AS (SELECT v.scope, v.value,
    CASE WHEN v.value = '' THEN 'absent' WHEN k.value IS NULL THEN 'missing' WHEN e.value IS NOT NULL OR n.value IS NOT NULL THEN 'matched'
         WHEN s1 >= CAST(0.82 AS DOUBLE) AND s1 - s2 >= CAST(0.10 AS DOUBLE) THEN 'matched' WHEN cands <> '' THEN 'ambiguous' ELSE 'missing' END AS status,
    CASE WHEN v.value = '' OR k.value IS NULL THEN '' WHEN e.value IS NOT NULL THEN 'exact' WHEN n.value IS NOT NULL THEN 'normalized' ELSE 'token' END AS method,
    CASE WHEN v.value = '' OR k.value IS NULL THEN 0 WHEN e.value IS NOT NULL THEN 1000 WHEN n.value IS NOT NULL THEN 980 ELSE CAST(round_even(s1 * 1000, 0) AS INT) END AS conf_milli,
    CASE WHEN v.value = '' THEN NULL WHEN e.value IS NOT NULL THEN e.id WHEN n.value IS NOT NULL THEN n.id
         WHEN s1 >= CAST(0.82 AS DOUBLE) AND s1 - s2 >= CAST(0.10 AS DOUBLE) THEN id1 END AS id,
    CASE WHEN v.value = '' THEN NULL WHEN e.value IS NOT NULL THEN e.name WHEN n.value IS NOT NULL THEN n.name
         WHEN s1 >= CAST(0.82 AS DOUBLE) AND s1 - s2 >= CAST(0.10 AS DOUBLE) THEN name1 END AS name,
    CASE WHEN v.value <> '' AND e.value IS NULL AND n.value IS NULL AND NOT (s1 >= CAST(0.82 AS DOUBLE) AND s1 - s2 >= CAST(0.10 AS DOUBLE)) THEN cands ELSE '' END AS candidates
  FROM {p}_v v LEFT JOIN {p}_k k ON k.scope = v.scope AND k.value = v.value LEFT JOIN {p}_e e ON e.scope = v.scope AND e.value = v.value
  LEFT JOIN {p}_n n ON n.scope = v.scope AND n.value = v.value)"""


def parent_case(label: str) -> str:
    """Hinted parent of a label, null if no hint fits."""
    plain = f"trim(regexp_replace(regexp_replace(lower({label}), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g'))"
    whole = " ".join(f"WHEN {plain} = '{h}' THEN '{p}'" for h, p in SPEC_LABEL_HINTS.items())
    inside = " ".join(f"WHEN contains({plain}, '{h}') THEN '{p}'" for h, p in SPEC_LABEL_HINTS.items())
    return f"CASE {whole} {inside} END"


def spec_value_ctes(values: str, catalog: str, out: str) -> str:
    """``values``: (parent, value) -> resolution within the parent, numbers first."""
    p = out
    num = lambda c: f"TRY_CAST(nullif(regexp_extract({c}, '([0-9]+)', 1), '') AS BIGINT)"
    return f"""{p}_a AS (SELECT DISTINCT parent, value FROM {values}),
{p}_b AS (SELECT a.parent, a.value, arg_min(CAST(c.id_n AS STRING), c.ord) AS id, arg_min(c.name, c.ord) AS name FROM {p}_a a JOIN {catalog} c
    ON c.parent = a.parent AND c.parent IN ({quoted(NUMERIC_PARENTS)}) AND {num('c.name')} = {num('a.value')} GROUP BY ALL),
{p}_o AS (SELECT parent AS scope, CAST(id_n AS STRING) AS id, name, slug AS alias, ord FROM {catalog}),
{p}_c AS (SELECT parent AS scope, value FROM {p}_a),
{resolve_ctes(f'{p}_c', f'{p}_o', f'{p}_m')},
{out} AS (SELECT a.parent, a.value,
    CASE WHEN a.parent NOT IN (SELECT parent FROM {catalog}) THEN 'missing' WHEN b.id IS NOT NULL THEN 'matched' ELSE m.status END AS status,
    CASE WHEN a.parent NOT IN (SELECT parent FROM {catalog}) THEN 'unknown_parent' WHEN b.id IS NOT NULL THEN 'numeric' ELSE m.method END AS method,
    coalesce(b.id, m.id) AS id, coalesce(b.name, m.name) AS name, CASE WHEN b.id IS NULL THEN m.candidates ELSE '' END AS candidates
  FROM {p}_a a LEFT JOIN {p}_b b ON b.parent = a.parent AND b.value = a.value
  LEFT JOIN {p}_m m ON m.scope = a.parent AND m.value = trim(a.value))"""


def vocab_ctes(items: str, vocab: str, flat: bool, out: str) -> str:
    """``items``: (item); ``vocab``: (grp, label, ord) -> best label per item."""
    p = out
    low = "lower(item)"
    words = WORDS(f"regexp_replace({low}, '[^\\w\\s]', ' ', 'g')")
    rules = [(f"contains({low}, '{k}')", t) for k, t in FEATURE_SYNONYMS.items()]
    rules += [(f"list_contains({words}, '{k}')", t) for k, t in FEATURE_ACRONYMS.items()]
    need = lambda t: f" AND '{t[1]}' IN (SELECT label FROM {vocab})" if flat else ""
    pick = lambda i: "CASE " + " ".join(f"WHEN {c}{need(t)} THEN '{t[i]}'" for c, t in rules) + " END"
    return f"""{p}_i AS (SELECT item, {pick(0)} AS rg, {pick(1)} AS rl FROM (SELECT DISTINCT item FROM {items})),
{p}_s AS (SELECT i.item, v.grp, v.label, v.ord, {score('i.t', 'v.t')} AS s FROM (SELECT *, {stem_tokens('item')} AS t FROM {p}_i) i
    CROSS JOIN (SELECT *, {stem_tokens('label')} AS t FROM {vocab}) v),
{p}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC, ord) AS rn FROM {p}_s) WHERE rn = 1 AND s >= CAST(0.6 AS DOUBLE)),
{out} AS (SELECT i.item, CASE WHEN rl IS NOT NULL THEN rg ELSE b.grp END AS grp, coalesce(rl, b.label) AS label FROM {p}_i i LEFT JOIN {p}_b b ON b.item = i.item)"""
