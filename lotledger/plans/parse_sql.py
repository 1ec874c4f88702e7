"""Oracle-side SQL for the parsers, written once and reused by later oracles."""

from __future__ import annotations

from lotledger.functions.carkey import FUEL_FINGERPRINTS, TRANSMISSION_FINGERPRINTS
from lotledger.functions.modelcode import FUEL_WORDS, STANDALONE_BRANDS, TRANSMISSION_WORDS


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def fp(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '', 'g')"


def clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def tidy(c: str) -> str:
    return f"regexp_replace({clean(c)}, '^[ \\-\\t.]+|[ \\-\\t.]+$', '', 'g')"


def year4(c: str) -> str:
    y = f"CASE WHEN regexp_matches({c}, '^\\d{{2}}$') THEN 2000 + TRY_CAST({c} AS INT) WHEN regexp_matches({c}, '^\\d{{4}}$') THEN TRY_CAST({c} AS INT) END"
    return f"(CASE WHEN ({y}) BETWEEN 1990 AND 2100 THEN ({y}) END)"


def vin(c: str) -> str:
    u = f"upper({clean(c)})"
    return f"(regexp_matches({u}, '^[A-Z0-9]{{15,17}}$') AND regexp_matches({u}, '[0-9]') AND regexp_matches({u}, '[A-Z]'))"


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), '')"
    )


def car_ctes(src: str, key: str, text: str, out: str) -> str:
    """CTEs ending in ``out``: one row per ``key`` with flat parsed fields."""
    shape = "'^([^F]*)(F+)([^T]*)(T+)'"
    keep_tidy = lambda a: f"list_filter(list_transform({a}, lambda x: {tidy('x')}), lambda x: x <> '')"
    lead = "'^\\s*(\\d{2}|\\d{4})\\b(.*)$'"
    p = out
    return f"""{p}_1 AS (SELECT {key}, {clean(text)} AS raw, string_split({clean(text)}, '-') AS seg FROM {src}),
{p}_2 AS (SELECT *, array_to_string(list_transform(seg, lambda x: CASE WHEN {fp('x')} IN ({quoted(FUEL_FINGERPRINTS)}) THEN 'F'
    WHEN {fp('x')} IN ({quoted(TRANSMISSION_FINGERPRINTS)}) THEN 'T' ELSE 'x' END), '') AS cls FROM {p}_1),
{p}_3 AS (SELECT *, regexp_matches(cls, {shape}) AS found,
    length(regexp_extract(cls, {shape}, 1)) + length(regexp_extract(cls, {shape}, 2)) AS fpos,
    length(regexp_extract(cls, {shape}, 3)) AS win, length(regexp_extract(cls, {shape}, 4)) AS trun FROM {p}_2),
{p}_4 AS (SELECT *, seg[1:fpos - 1] AS head, {tidy('seg[fpos]')} AS fuel, {tidy('seg[fpos + win + 1]')} AS trans,
    list_transform(seg[fpos + win + 2:fpos + win + trun], lambda x: {tidy('x')}) AS repeats,
    {keep_tidy('seg[fpos + 1:fpos + win]')} AS eng,
    list_filter(seg[fpos + win + trun + 1:], lambda x: {tidy('x')} <> '') AS tail FROM {p}_3),
{p}_5 AS (SELECT *, {tidy('head[1]')} AS head0, list_transform(list_filter(tail, lambda x: {vin('x')}), lambda x: upper({tidy('x')})) AS vins,
    list_filter(tail, lambda x: NOT {vin('x')}) AS rest FROM {p}_4),
{p}_6 AS (SELECT *, {year4('head0')} AS hy, len(rest) AS nr,
    regexp_extract(coalesce(rest[len(rest)], ''), {lead}, 1) AS y1raw, {tidy(f"regexp_extract(coalesce(rest[len(rest)], ''), {lead}, 2)")} AS y1tail,
    CASE WHEN len(rest) >= 2 THEN regexp_extract(rest[len(rest) - 1], {lead}, 1) ELSE '' END AS y2raw,
    CASE WHEN len(rest) >= 2 THEN {tidy(f"regexp_extract(rest[len(rest) - 1], {lead}, 2)")} ELSE '' END AS y2tail FROM {p}_5),
{p}_7 AS (SELECT *, {keep_tidy('CASE WHEN hy IS NOT NULL THEN head[2:] ELSE head END')} AS parts,
    {year4('y1raw')} AS y1, {year4('y2raw')} AS y2 FROM {p}_6),
{p}_8 AS (SELECT *, CASE WHEN y1 IS NOT NULL THEN 1 WHEN nr >= 2 AND y2 IS NOT NULL AND y2tail = '' THEN 2 ELSE 0 END AS used FROM {p}_7),
{p}_9 AS (SELECT *, array_to_string(parts, '-') AS name, len(parts) AS np, len(eng) AS ne,
    {keep_tidy('rest[1:nr - used]')} AS cols,
    TRY_CAST(nullif(regexp_extract(replace(replace(lower(eng[1]), '_', '.'), ',', '.'), '\\d+(?:\\.\\d+)?', 0), '') AS DECIMAL(12,6)) AS litres,
    CASE used WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE hy END AS yr,
    CASE used WHEN 1 THEN y1tail WHEN 2 THEN {tidy('rest[nr]')} ELSE '' END AS sfx,
    CASE WHEN raw = '' THEN 'silent' ELSE 'unparseable' END AS lost FROM {p}_8),
{out} AS (SELECT {key}, raw, CASE WHEN found THEN name ELSE '' END AS designation,
    CASE WHEN found THEN {fp('name')} ELSE '' END AS desig_fp,
    CASE WHEN NOT found THEN lost WHEN np >= 3 THEN 'stated' WHEN np = 0 THEN 'silent' ELSE 'unparseable' END AS name_state,
    CASE WHEN found AND np >= 3 THEN parts[1] END AS brand, CASE WHEN found AND np >= 3 THEN parts[2] END AS model_head,
    CASE WHEN found AND np >= 3 THEN array_to_string(parts[3:], ' ') END AS trim,
    CASE WHEN NOT found THEN lost WHEN fuel <> '' THEN 'stated' ELSE 'silent' END AS fuel_state, CASE WHEN found THEN fuel END AS fuel,
    CASE WHEN NOT found THEN lost WHEN ne = 0 THEN 'silent' WHEN ne = 1 AND litres BETWEEN 0.5 AND 10.0 THEN 'stated' ELSE 'unparseable' END AS engine_state,
    CASE WHEN found AND ne = 1 AND litres BETWEEN 0.5 AND 10.0 THEN litres END AS engine_l,
    CASE WHEN NOT found THEN lost WHEN trans <> '' THEN 'stated' ELSE 'silent' END AS transmission_state, CASE WHEN found THEN trans END AS transmission,
    CASE WHEN found THEN yr END AS model_year, CASE WHEN found AND yr IS NOT NULL THEN CASE used WHEN 1 THEN y1raw WHEN 2 THEN y2raw ELSE head0 END END AS year_raw,
    CASE WHEN NOT found THEN raw WHEN ne > 1 THEN array_to_string(eng, '-') ELSE eng[1] END AS engine_raw,
    CASE WHEN NOT found OR len(cols) = 0 THEN 'silent' WHEN len(cols) >= 3 THEN 'unparseable' ELSE 'stated' END AS exterior_state,
    CASE WHEN found AND len(cols) IN (1, 2) THEN cols[1] END AS exterior,
    CASE WHEN NOT found OR len(cols) < 2 THEN 'silent' WHEN len(cols) >= 3 THEN 'unparseable' ELSE 'stated' END AS interior_state,
    CASE WHEN found AND len(cols) = 2 THEN cols[2] END AS interior,
    CASE WHEN found THEN vins[1] END AS vin_tag, CASE WHEN found THEN nullif(sfx, '') END AS variant_suffix,
    CASE WHEN found THEN CAST(np > 0 AND np < 3 AS INT) + len(repeats) + CAST(ne > 1 AS INT)
         + CAST(ne = 1 AND NOT coalesce(litres BETWEEN 0.5 AND 10.0, false) AS INT) + greatest(len(vins) - 1, 0) + CAST(len(cols) >= 3 AS INT)
         ELSE 1 END AS n_notes,
    found AND {fp('name')} <> '' AS ok,
    CASE WHEN NOT found THEN '' WHEN np >= 3 AND {fp('parts[1]')} <> '' THEN {fp('parts[1]')}
         ELSE coalesce(nullif(split_part(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ', 1), ''), '') END AS brand_key
  FROM {p}_9)"""


def code_ctes(src: str, key: str, text: str, out: str) -> str:
    """CTEs ending in ``out``: the strict model-code grammar, all null where it fails."""
    p = out
    shape = "'^([^F]*)F[^T](T+)'"
    cyear = lambda c: (
        f"CASE WHEN regexp_matches(trim({c}), '^\\d{{2}}$') THEN 2000 + TRY_CAST(trim({c}) AS INT) "
        f"WHEN regexp_matches(trim({c}), '^20\\d{{2}}$') THEN TRY_CAST(trim({c}) AS INT) END"
    )
    words = lambda c, m: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
    lone = f"upper(trim(b[1])) IN ({quoted(STANDALONE_BRANDS)})"
    return f"""{p}_1 AS (SELECT {key}, trim({text}) AS stem, string_split(trim({text}), '-') AS seg FROM {src}),
{p}_2 AS (SELECT *, list_transform(seg, lambda x: upper(trim(x))) AS up FROM {p}_1),
{p}_3 AS (SELECT *, array_to_string(list_transform(up, lambda x: CASE WHEN x IN ({quoted(FUEL_WORDS)}) THEN 'F'
    WHEN x IN ({quoted(TRANSMISSION_WORDS)}) THEN 'T' ELSE 'x' END), '') AS cls FROM {p}_2),
{p}_4 AS (SELECT *, length(regexp_extract(cls, {shape}, 1)) AS ld, length(regexp_extract(cls, {shape}, 2)) AS run,
    regexp_matches(cls, {shape}) AND len(seg) >= 5 AS fits FROM {p}_3),
{p}_5 AS (SELECT *, seg[1:ld] AS b0, seg[ld + run + 3:] AS a0, replace(trim(seg[ld + 2]), '_', '.') AS eng FROM {p}_4),
{p}_6 AS (SELECT *, {cyear('b0[1]')} AS yh, {cyear('a0[len(a0)]')} AS yt FROM {p}_5),
{p}_7 AS (SELECT *, CASE WHEN yh IS NOT NULL THEN b0[2:] ELSE b0 END AS b,
    CASE WHEN yh IS NULL AND yt IS NOT NULL THEN a0[1:len(a0) - 1] ELSE a0 END AS a FROM {p}_6),
{p}_8 AS (SELECT *, fits AND len(b) > 0 AND (eng = '' OR regexp_matches(eng, '^\\d+(\\.\\d+)?$')) AS good FROM {p}_7),
{out} AS (SELECT {key}, coalesce(good, false) AS parsed,
    CASE WHEN good THEN {title("trim(CASE WHEN len(b) >= 3 OR (len(b) = 2 AND " + lone + ") THEN b[1] ELSE '' END)")} END AS brand,
    CASE WHEN good THEN {title("trim(CASE WHEN len(b) >= 3 OR (len(b) = 2 AND " + lone + ") THEN b[2] ELSE b[1] END)")} END AS model,
    CASE WHEN good THEN {title("trim(CASE WHEN len(b) >= 3 THEN array_to_string(b[3:], ' ') WHEN len(b) = 2 AND NOT " + lone + " THEN b[2] ELSE '' END)")} END AS trim,
    CASE WHEN good THEN {words('up[ld + 1]', FUEL_WORDS)} END AS fuel_type, CASE WHEN good THEN nullif(eng, '') END AS engine_size,
    CASE WHEN good THEN {words('up[ld + 3]', TRANSMISSION_WORDS)} END AS transmission,
    CASE WHEN good AND len(a) >= 1 THEN trim(a[1]) END AS exterior_color, CASE WHEN good AND len(a) >= 2 THEN trim(a[2]) END AS interior_color,
    CASE WHEN good THEN coalesce(yh, yt) END AS year FROM {p}_8)"""


def leaf_ctes(src: str, key: str, text: str, out: str) -> str:
    """CTEs ending in ``out``: both colour readings of a folder name."""
    p = out
    run = "'^(.*?)[\\s\\-]+([A-Za-z0-9]+)\\s*$'"
    yr = "'^(.*?)[\\s\\-]+(\\d{2}|\\d{4})\\s*$'"
    vin2 = "'^(.*?)[\\s\\-]+([A-Za-z0-9]{11,17})\\s*$'"
    ins = "'(?i)\\bINSIDE?\\b'"
    bare = lambda c: f"trim(regexp_replace(trim({c}, ' -'), '\\s{{2,}}', ' ', 'g'), ' -')"
    halves = lambda c: f"regexp_extract({c}, '(?i)^(.*?)\\bINSIDE?\\b(.*)$', 1) AS l, regexp_extract({c}, '(?i)^(.*?)\\bINSIDE?\\b(.*)$', 2) AS r"
    return f"""{p}_1 AS (SELECT {key}, coalesce({text}, '') AS nm, {clean(text)} AS t FROM {src}),
{p}_2 AS (SELECT *, regexp_extract(t, {run}, 2) AS rn, regexp_extract(nm, {vin2}, 2) AS vn FROM {p}_1),
{p}_3 AS (SELECT *, CASE WHEN {vin('rn')} THEN upper(rn) END AS vin_tag, CASE WHEN {vin('rn')} THEN regexp_extract(t, {run}, 1) ELSE t END AS t1,
    CASE WHEN regexp_matches(vn, '[0-9]') AND regexp_matches(vn, '(?i)[A-Z]') THEN regexp_extract(nm, {vin2}, 1) ELSE nm END AS n1 FROM {p}_2),
{p}_4 AS (SELECT *, CASE WHEN {year4(f"regexp_extract(t1, {yr}, 2)")} IS NOT NULL THEN regexp_extract(t1, {yr}, 1) ELSE t1 END AS t2,
    regexp_replace(n1, '[\\s\\-]+(?:19|20)?\\d{{2}}\\s*$', '') AS n2 FROM {p}_3),
{p}_5 AS (SELECT {key}, vin_tag, regexp_matches(t2, {ins}) AS s1, {halves('t2')}, regexp_matches(n2, {ins}) AS s2,
    {halves('n2').replace(' AS l', ' AS l2').replace(' AS r', ' AS r2')} FROM {p}_4),
{p}_6 AS (SELECT {key}, vin_tag, s1 AND {tidy('l')} <> '' AND {tidy('r')} <> '' AS ok1, {tidy('l')} AS e1, {tidy('r')} AS i1,
    s2 AND {bare('l2')} <> '' AND {bare('r2')} <> '' AS ok2, {bare('l2')} AS e2, {bare('r2')} AS i2 FROM {p}_5),
{out} AS (SELECT {key}, vin_tag, CASE WHEN ok1 THEN e1 END AS exterior, CASE WHEN ok1 THEN i1 END AS interior,
    CASE WHEN ok2 THEN e2 END AS loose_exterior, CASE WHEN ok2 THEN i2 END AS loose_interior FROM {p}_6)"""
