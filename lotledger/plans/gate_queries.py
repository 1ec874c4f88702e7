"""Registered queries over attempts, replies, gates and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotledger.functions import replies as rp
from lotledger.operators import attempts, library, scoring
from lotledger.operators import locate as loc
from lotledger.plans import parse_sql as ps
from lotledger.plans import reply_sql as rs
from lotledger.plans.derive import table, with_clause
from lotledger.plans.library_queries import _SUFFIX, entries
from lotledger.plans.locate_queries import _PLAIN, _located
from lotledger.session import settle
from lotledger.sources import uploads


def attempt_stop(spark, sf):
    e = table(spark, sf, "events")
    stop = F.col("event_type").isin("purchase", "signup")
    return attempts.until_stop(e, "user_id", F.struct("ts", "event_id"), stop).select("user_id", "event_id", "event_type")


def reply_recovery(spark, sf):
    r = table(spark, sf, "sheet_replies").withColumn("body", rp.strip_fences(F.col("content")))
    return rp.recover_json(r, "body").select("event_id", "recovered.json", "recovered.dropped")


def reply_shape(spark, sf):
    """Shape issues of every reply; one that holds no JSON object has that as its issue."""
    r = table(spark, sf, "sheet_replies").withColumn("json", rp.json_text(F.col("content")))
    issues = (
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", F.lit("empty content"))
        .when(F.try_parse_json("json").isNull() & F.col("finish_reason").isin("length", "max_tokens"), F.lit("invalid JSON, cut off at the token cap"))
        .when(F.try_parse_json("json").isNull(), F.lit("invalid JSON"))
        .when(F.json_object_keys("json").isNull(), F.lit("not a JSON object"))
        .otherwise(F.array_join(rp.shape_issues(F.col("json")), "; "))
    )
    return r.select("event_id", issues.alias("issues"))


def _report(spark, sf):
    return attempts.extraction_report(attempts.judge_replies(table(spark, sf, "sheet_replies", deal=True)))


def extraction_report(spark, sf):
    return _report(spark, sf).select(
        "car", "n_pdfs_tried", "n_attempts", "pdf", "attempt", F.size("low_confidence_fields").alias("n_notes"), "stopped_on_truncation"
    )


def located_cars(messages):
    """What ``car_status`` asks of each located car: its folder, or the sentence why it has none.
    A lookup that could not be made has failed."""
    return messages.select(
        F.concat(F.lit("car"), F.col("car_id").cast("string")).alias("car"), F.col("located_path").alias("folder_path"),
        F.col("message").alias("lookup_error"), (F.col("outcome") == "blocked").alias("failed"),
    )


def car_status(spark, sf):
    """Status of every car: located folder, sheet, extraction."""
    cars = settle(located_cars(loc.messages(_located(spark, sf), "car_string")))
    files = library.car_files(entries(spark, sf), cars.select("folder_path").filter("folder_path IS NOT NULL"))
    out = attempts.car_status(cars, files, _report(spark, sf), photos_ok=F.col("n_photos") > 3)
    return out.select("car", "status", "folder_path", "n_pdfs", "n_photos", F.col("json").isNotNull().alias("extracted"), "completed")


def page_boundary(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.length("text").alias("n"))
    photo = scoring.is_photo_page((F.col("n") % 100) / F.lit(100.0), (F.col("n") % 7) / F.lit(2.0))
    return scoring.spec_page_boundary(pages.withColumn("photo", photo))


def photo_gate(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("embedding", "probs")
    names = {i: ("Exterior", "Interior", "detail")[i % 3] for i in range(64)}
    return scoring.gate_photos(e, names, threshold=0.3).select("vec_id", F.col("confidence").cast("double").alias("confidence"), F.col("label"), "slot")


def photo_slots(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("embedding", "probs").withColumn("car", F.col("label")).drop("label")
    names = {i: ("Exterior", "Interior", "detail")[i % 3] for i in range(64)}
    return scoring.photo_slots(scoring.gate_photos(e, names, threshold=0.3))


def text_layer_gate(spark, sf):
    return uploads.route_text_layers(table(spark, sf, "documents")).select("doc_id", "n_words", "route")


def upload_guard(spark, sf):
    name = F.concat(F.col("source"), F.when(F.col("lang") == "en", F.lit(".PDF")).when(F.col("lang") == "fr", F.lit(".txt")).otherwise(F.lit("")))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", uploads.rejection(name, F.col("n_chars"), [".pdf"], 2000).isNull().alias("accepted"),
                       uploads.rejection(name, F.col("n_chars"), [".pdf"], 2000).alias("reason"))


QUERIES = {
    f.__name__: f
    for f in (
        attempt_stop, reply_recovery, reply_shape, extraction_report, car_status, page_boundary, photo_gate, photo_slots,
        text_layer_gate, upload_guard,
    )
}

_GATED = """g AS (SELECT vec_id, label AS car, list_max(embedding) AS m, (list_position(embedding, list_max(embedding)) - 1) % 3 AS k FROM embeddings),
  s AS (SELECT vec_id, car, CAST(m AS DOUBLE) AS confidence, CASE WHEN m >= CAST(0.3 AS FLOAT) THEN ['exterior', 'interior', 'detail'][k + 1] END AS label FROM g),
  t AS (SELECT *, CASE WHEN label IN ('exterior', 'interior') THEN label ELSE 'unclassified' END AS slot FROM s)"""

ORACLES = {
    "attempt_stop": """WITH s AS (SELECT user_id, min((ts, event_id)) AS stop FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id)
      SELECT e.user_id, e.event_id, e.event_type FROM events e LEFT JOIN s ON s.user_id = e.user_id WHERE s.stop IS NULL OR (e.ts, e.event_id) <= s.stop""",
    "reply_shape": f"""WITH {with_clause('sheet_replies')}, j AS (SELECT event_id, trim(regexp_replace(regexp_replace(content, '^\\s*```(json)?\\s*', ''), '\\s*```\\s*$', '')) AS json FROM sheet_replies),
      k AS (SELECT event_id, json, json_keys(json) AS ks, json_type(json, '$.raw_specifications') AS ts, json_type(json, '$.raw_features') AS tf FROM j WHERE trim(json) <> '' AND json_valid(json))
      SELECT r.event_id, CASE WHEN trim(content) = '' THEN 'empty content' WHEN k.event_id IS NULL AND finish_reason IN ('length', 'max_tokens') THEN 'invalid JSON, cut off at the token cap'
        WHEN k.event_id IS NULL THEN 'invalid JSON' ELSE concat_ws('; ', {", ".join(f"CASE WHEN NOT list_contains(ks, '{k}') THEN 'missing top-level key ''{k}''' END" for k in rp.REQUIRED_KEYS)},
        CASE WHEN ts <> 'ARRAY' THEN '''raw_specifications'' should be an array, got str' END, CASE WHEN tf <> 'ARRAY' THEN '''raw_features'' should be an array, got dict' END,
        CASE WHEN ts = 'ARRAY' AND json_array_length(json, '$.raw_specifications') = 0 THEN '''raw_specifications'' is empty — the model returned a skeleton, not an extraction' END) END AS issues
      FROM sheet_replies r LEFT JOIN k ON k.event_id = r.event_id""",
    "reply_recovery": f"WITH {rs.reply_ctes()} SELECT event_id, json, dropped FROM rec",
    "extraction_report": f"WITH {rs.REPORT_CTES} {rs.REPORT}",
    "car_status": f"""WITH {_PLAIN}, {rs.REPORT_CTES},
      vp AS (SELECT DISTINCT variant_path AS path FROM located WHERE variant_path IS NOT NULL),
      fl AS (SELECT vp.path, count(*) FILTER (WHERE sfx = '.pdf') AS n_pdfs, count(*) FILTER (WHERE sfx IN ({ps.quoted(library.IMAGE_SUFFIXES)})) AS n_photos
        FROM vp JOIN (SELECT path, {_SUFFIX} AS sfx FROM library_entries) e ON starts_with(e.path, vp.path || '/') GROUP BY vp.path),
      cs AS (SELECT concat('car', l.car_id) AS car, variant_path AS folder_path, coalesce(n_pdfs, 0) AS n_pdfs, coalesce(n_photos, 0) AS n_photos, coalesce(n_pdfs, 0) > 0 AS reached, rp.attempt IS NOT NULL AS usable
        FROM located l LEFT JOIN fl ON fl.path = variant_path LEFT JOIN rp ON rp.car = concat('car', l.car_id))
      SELECT car, CASE WHEN reached THEN 'ok' ELSE 'needs_folder_link' END AS status, folder_path, n_pdfs, n_photos, reached AND usable AS extracted,
        NOT (reached AND NOT usable AND n_photos <= 3) AS completed FROM cs""",
    "page_boundary": """WITH p AS (SELECT conv_id AS doc, turn AS page, length(text) % 100 < 50 AND length(text) % 7 >= 3 AS photo FROM conversations),
      n AS (SELECT doc, page, photo AND lead(photo) OVER (PARTITION BY doc ORDER BY page) AS pair FROM p)
      SELECT doc, count(*) AS n_pages, coalesce(min(page) FILTER (WHERE pair AND page >= 1), count(*)) AS boundary FROM n GROUP BY doc""",
    "photo_gate": f"WITH {_GATED} SELECT vec_id, confidence, label, slot FROM t",
    "photo_slots": f"""WITH {_GATED} SELECT car, count(*) FILTER (WHERE slot = 'exterior') AS exterior, count(*) FILTER (WHERE slot = 'interior') AS interior,
      count(*) FILTER (WHERE slot = 'unclassified') AS unclassified FROM t GROUP BY car""",
    "text_layer_gate": f"""WITH w AS (SELECT doc_id, CASE WHEN {ps.clean('text')} = '' THEN 0 ELSE len(string_split({ps.clean('text')}, ' ')) END AS n_words FROM documents)
      SELECT doc_id, n_words, CASE WHEN n_words >= 50 THEN 'text' ELSE 'vision' END AS route FROM w""",
    "upload_guard": """SELECT doc_id, lang = 'en' AND n_chars BETWEEN 1 AND 2000 AS accepted,
      CASE WHEN lang = 'fr' THEN 'Unsupported file type ''.txt'' — expected one of [''.pdf'']' WHEN lang <> 'en' THEN 'Unsupported file type ''(none)'' — expected one of [''.pdf'']'
        WHEN n_chars = 0 THEN 'Uploaded file is empty' WHEN n_chars > 2000 THEN printf('File too large (%.1fMB) — max 0MB', n_chars / 1024.0 / 1024.0) END AS reason FROM documents""",
}
