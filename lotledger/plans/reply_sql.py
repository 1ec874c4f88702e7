"""Oracle parts over model replies: unwrapping, repair by search, judging, the report of a car.

Repair is stated otherwise than in the operator: of all prefixes that end after a closing bracket or
before a comma, and the ways to close them that the replies can need, the longest that is valid JSON.
"""

from __future__ import annotations

from lotledger.functions import replies as rp
from lotledger.plans.derive import with_clause

_CLOSINGS = ("}", "]}", "}}", "}]}")


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def reply_ctes(source: str = "sheet_replies", key: str = "event_id", closings: tuple[str, ...] = _CLOSINGS) -> str:
    """CTEs ending in ``rec``: every reply with its body, its usable JSON text and the characters lost."""
    text = _strip("content")
    opened = f"CASE WHEN contains({text}, chr(10)) THEN regexp_replace({text}, '^[^\\n]*\\n', '') ELSE substring({text}, 4) END"
    body = f"CASE WHEN starts_with({text}, '```') THEN regexp_replace({opened}, '```\\s*$', '') ELSE {text} END"
    listed = ", ".join(f"'{c}'" for c in closings)
    return f"""{with_clause(source)},
  bd AS (SELECT *, {_strip(body)} AS body FROM {source}),
  wh AS MATERIALIZED (SELECT *, json_valid(body) AS whole FROM bd),
  px AS (SELECT {key}, n, closing, rtrim(rtrim(substring(body, 1, n)), ',') AS kept
    FROM (SELECT {key}, body, unnest(generate_series(1, length(body))) AS n FROM wh WHERE NOT whole AND starts_with(body, '{{')) p, (SELECT unnest([{listed}]) AS closing) c
    WHERE substring(body, n, 1) IN ('}}', ']') OR substring(body, n + 1, 1) = ','),
  ok AS (SELECT {key}, arg_max(kept || closing, n) AS json, arg_max(length(kept), n) AS kept FROM px WHERE json_valid(kept || closing) GROUP BY {key}),
  rec AS MATERIALIZED (SELECT w.*, CASE WHEN whole THEN body ELSE ok.json END AS json, CASE WHEN whole OR body = '' THEN 0 ELSE length(body) - coalesce(ok.kept, 0) END AS dropped
    FROM wh w LEFT JOIN ok ON ok.{key} = w.{key})"""


def judge_ctes(key: str = "event_id") -> str:
    """CTEs ending in ``jd``: ``rec`` with the kind of error, null if usable."""
    kinds = "json_type(json, '$.raw_specifications') AS ts, json_type(json, '$.raw_features') AS tf, json_keys(json) AS ks"
    present = " AND ".join(f"list_contains(ks, '{k}')" for k in rp.REQUIRED_KEYS)
    return f"""sh AS (SELECT {key}, {present} AND ts = 'ARRAY' AND tf = 'ARRAY' AND json_array_length(json, '$.raw_specifications') > 0 AS shaped
    FROM (SELECT {key}, json, {kinds} FROM rec WHERE json IS NOT NULL)),
  jd AS (SELECT r.*, finish_reason IN ('length', 'max_tokens') AND NOT whole AND {_strip('content')} <> '' AS truncated,
      CASE WHEN {_strip('content')} = '' THEN 'empty' WHEN NOT whole AND finish_reason NOT IN ('length', 'max_tokens') THEN 'invalid'
        WHEN r.json IS NULL THEN 'truncated' WHEN NOT shaped THEN 'shape' END AS error
    FROM rec r LEFT JOIN sh ON sh.{key} = r.{key})"""


REPORT_CTES = f"""{reply_ctes()}, {judge_ctes()},
  pd AS (SELECT car, pdf, (lower(trim(pdf)) <> lower(trim(search_key)) || '.pdf')::INT * 1000 + pdf_ord AS place, count(*) AS n_attempts,
      min(attempt) FILTER (WHERE error IS NULL) AS attempt, arg_min(truncated, attempt) FILTER (WHERE error IS NULL) AS truncated, bool_or(coalesce(error = 'truncated', false)) AS cut
    FROM jd GROUP BY car, pdf, pdf_ord, search_key),
  sp AS (SELECT car, min(place) FILTER (WHERE attempt IS NOT NULL OR cut) AS stop FROM pd GROUP BY car),
  tr AS (SELECT pd.* FROM pd JOIN sp ON sp.car = pd.car WHERE stop IS NULL OR place <= stop),
  rp AS (SELECT car, count(*) AS n_pdfs_tried, CAST(sum(n_attempts) AS BIGINT) AS n_attempts, arg_min(pdf, place) FILTER (WHERE attempt IS NOT NULL) AS pdf,
      arg_min(attempt, place) FILTER (WHERE attempt IS NOT NULL) AS attempt, arg_min(truncated, place) FILTER (WHERE attempt IS NOT NULL) AS truncated,
      bool_or(cut AND attempt IS NULL) AS stopped_on_truncation FROM tr GROUP BY car)"""

REPORT = """SELECT car, n_pdfs_tried, n_attempts, pdf, attempt,
    CASE WHEN attempt IS NULL THEN 0 ELSE CAST(truncated AS INT) + CAST(attempt > 1 AS INT) END AS n_notes, stopped_on_truncation FROM rp"""
