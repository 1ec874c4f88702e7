"""Registered queries over what is handed in or kept: catalog payloads, pending reports, uploaded sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotledger.operators import attempts, sheets
from lotledger.plans import parse_sql as ps
from lotledger.plans import reply_sql as rs
from lotledger.plans import resolve_sql
from lotledger.plans.catalog_queries import _spec_catalog
from lotledger.plans.derive import table, with_clause
from lotledger.plans.evidence_queries import _BODY
from lotledger.session import shared_dir
from lotledger.sources import catalogs, pending_store

_SUPPLIERS = 64


def taxonomy_payload(spark, sf):
    """Nested catalog JSON, one payload a region and block of suppliers, flattened to taxonomy rows.
    A node that several payloads hold is one row, at its first place."""
    supplier = table(spark, sf, "supplier").select("s_nationkey", F.floor(F.col("s_suppkey") / _SUPPLIERS).alias("part"), "s_suppkey", "s_name")
    trims = supplier.groupBy("s_nationkey", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label")))).alias("trims")
    )
    models = table(spark, sf, "nation").join(trims, F.col("s_nationkey") == F.col("n_nationkey"), "left").withColumn("part", F.coalesce("part", F.lit(0)))
    models = models.groupBy("n_regionkey", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), "trims"))).alias("models")
    )
    payload = table(spark, sf, "region").join(models, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.format_string("%012d.%02d", F.coalesce("part", F.lit(0)), "r_regionkey").alias("payload_id"),
        F.to_json(F.array(F.struct(F.concat(F.lit("R"), "r_regionkey").alias("value"), F.col("r_name").alias("name"), "models"))).alias("payload"),
    )
    rows = catalogs.parse_taxonomy(payload)
    return rows.groupBy("level", "id").agg(F.min("name").alias("name"), F.min("parent_id").alias("parent_id"), F.min("ord").alias("ord"))


def catalog_payloads(spark, sf):
    """Feature and specification catalogs read from JSON payloads of at most 200 rows, with their parents."""
    rows, groups = table(spark, sf, "payload_rows"), table(spark, sf, "payload_groups")
    value = F.struct(
        F.col("p_partkey").alias("at"), "id", F.when(F.col("p_partkey") % 3 == 0, F.col("name")).alias("label"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("name")).alias("name"), F.col("parent").alias("parent_feature"), F.col("parent").alias("parent_specification"),
        "status",
    )
    listed = rows.groupBy("payload_id").agg(F.array_sort(F.collect_list(value)).alias("features"))
    above = groups.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", "mandatory"))).alias("parents"))
    both = listed.join(above, "payload_id", "left")
    of = lambda parents, values: both.select(
        "payload_id", F.to_json(F.struct(F.col("parents").alias(parents), F.col("features").alias(values))).alias("payload")
    )
    tag = lambda kind, df: df.withColumn("kind", F.lit(kind))
    feature_groups, features = catalogs.parse_feature_catalog(of("parent_features", "features"))
    parents, values = catalogs.parse_spec_catalog(of("parent_specifications", "values"))
    out = tag("feature", features).unionByName(tag("specification", values)).drop("slug")
    heads = tag("feature group", feature_groups).unionByName(tag("parent specification", parents)).withColumnRenamed("parent_id", "id")
    return out.unionByName(heads, allowMissingColumns=True)


def pending_reloaded(spark, sf):
    """Three pending reports saved, one of them again, the latest cleared; then the latest there is."""
    rows = table(spark, sf, "pending_all")
    path = f"{shared_dir(spark)}/pending/{uuid.uuid4().hex}"
    for turn in (0, 1, 2, 1):
        pending_store.save_report(rows.filter(F.col("row_id") % 3 == turn), path, f"report{turn}", f"stock{turn}.xlsx", F.timestamp_seconds(F.lit(1_700_000_000 + turn)))
    pending_store.clear_report(spark, path, "report2")
    return pending_store.load_report(spark, path).withColumn("uploaded_at", F.unix_seconds("uploaded_at"))


def uploaded_sheets(spark, sf):
    """Every uploaded sheet with its car's vehicle fields, price and extraction."""
    replies = table(spark, sf, "sheet_replies").withColumn("upload", F.floor(F.col("event_id") / 3))
    out = sheets.uploaded_sheets(
        table(spark, sf, "uploads"), table(spark, sf, "pending_all"), attempts.judge_replies(replies), _spec_catalog(spark, sf), None
    )
    return out.select(
        "upload", "model_number", "stock_id", "price_aed", "brand", "model", "trim", "year", "fuel_type", "engine_size", "transmission", "parsed_by",
        "ext_raw", "int_raw", F.col("ext_res.status").alias("ext_status"), F.col("ext_res.id").alias("ext_id"), F.col("int_res.status").alias("int_status"),
        F.col("int_res.id").alias("int_id"), F.array_join("unresolved_colors", ";").alias("unresolved"), "n_attempts", "attempt",
        F.size("low_confidence_fields").alias("n_notes"), F.split("extraction_error", " — ")[0].alias("extraction_error"),
    )


QUERIES = {f.__name__: f for f in (taxonomy_payload, catalog_payloads, pending_reloaded, uploaded_sheets)}

_CODED = f"""{ps.code_ctes('tx', 'stock_id', 'stock_id', 'codes')},
  vh AS (SELECT stock_id, nullif(brand, '') AS brand, nullif(model, '') AS model, nullif(trim, '') AS trim, year, fuel_type, engine_size, transmission,
      nullif(exterior_color, '') AS ext_raw, nullif(interior_color, '') AS int_raw FROM codes),
  vb AS (SELECT *, CASE WHEN ext_raw IS NOT NULL THEN (SELECT {_BODY} FROM (SELECT ext_raw AS raw)) END AS ext_value FROM vh),
  qa AS (SELECT 'Color' AS parent, ext_value AS value FROM vb WHERE ext_value IS NOT NULL UNION SELECT 'Interior Color', int_raw FROM vb WHERE int_raw IS NOT NULL),
  {resolve_sql.spec_value_ctes('qa', 'spec_catalog', 'sv')}"""

ORACLES = {
    "taxonomy_payload": f"""WITH s AS (SELECT *, s_suppkey // {_SUPPLIERS} AS part FROM supplier),
      m AS (SELECT DISTINCT n_regionkey, n_nationkey, n_name, coalesce(part, 0) AS part FROM nation LEFT JOIN s ON s_nationkey = n_nationkey),
      mp AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey, part ORDER BY n_nationkey) - 1 AS i FROM m),
      tp AS (SELECT mp.*, s_suppkey, s_name, row_number() OVER (PARTITION BY n_nationkey, mp.part ORDER BY s_suppkey) - 1 AS j FROM mp JOIN s ON s_nationkey = n_nationkey AND s.part = mp.part)
      SELECT 'brand' AS level, concat('R', r_regionkey) AS id, r_name AS name, NULL AS parent_id,
        printf('%012d.%02d:%09d', (SELECT coalesce(min(part), 0) FROM mp WHERE n_regionkey = r_regionkey), r_regionkey, 0) AS ord FROM region
      UNION ALL SELECT 'model', CAST(n_nationkey AS STRING), n_name, concat('R', n_regionkey), min(printf('%012d.%02d:%09d.%09d', part, n_regionkey, 0, i)) FROM mp GROUP BY n_nationkey, n_name, n_regionkey
      UNION ALL SELECT 'trim', CAST(s_suppkey AS STRING), s_name, CAST(n_nationkey AS STRING), printf('%012d.%02d:%09d.%09d.%09d', part, n_regionkey, 0, i, j) FROM tp""",
    "catalog_payloads": f"""WITH {with_clause('payload_rows', 'payload_groups')},
      r AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY p_partkey) - 1 AS ord FROM payload_rows),
      g AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY name) - 1 AS ord FROM payload_groups),
      j AS (SELECT r.*, coalesce(g.id, '') AS parent_id FROM r LEFT JOIN g ON g.payload_id = r.payload_id AND g.name = r.parent)
      SELECT k.kind, payload_id, id, name, parent, parent_id, ord, NULL AS mandatory FROM j, (VALUES ('feature'), ('specification')) AS k(kind)
        WHERE k.kind = 'feature' OR lower(coalesce(status, 'published')) = 'published'
      UNION ALL SELECT k.kind, payload_id, id, name, NULL, NULL, ord, mandatory FROM g, (VALUES ('feature group'), ('parent specification')) AS k(kind)""",
    "pending_reloaded": f"""WITH {with_clause('pending_all')} SELECT *, 'stock1.xlsx' AS excel_filename, 1700000001 AS uploaded_at, 'report1' AS report_id FROM pending_all WHERE row_id % 3 = 1""",
    "uploaded_sheets": f"""WITH {with_clause('uploads', 'pending_all', 'spec_catalog')}, {rs.reply_ctes()}, {rs.judge_ctes()},
      sg AS (SELECT model_number, arg_min(struct_pack(d := product_description, p := price_aed), row_id) AS s FROM pending_all WHERE bucket = 'new' GROUP BY model_number),
      en AS (SELECT upload, u.model_number, coalesce(nullif(u.product_description, ''), s.d) AS d, coalesce(u.price_aed, s.p) AS price_aed FROM uploads u LEFT JOIN sg ON sg.model_number = u.model_number),
      up AS (SELECT *, coalesce(nullif(trim(d), ''), model_number) AS stock_id FROM en), tx AS (SELECT DISTINCT stock_id FROM up), {_CODED},
      sh_ AS (SELECT event_id // 3 AS upload, count(*) AS n_attempts, min(attempt) AS first, min(attempt) FILTER (WHERE error IS NULL) AS attempt,
          arg_min(truncated, attempt) FILTER (WHERE error IS NULL) AS truncated,
          arg_max(CASE error WHEN 'empty' THEN concat('empty content (finish_reason=', finish_reason, ')') WHEN 'invalid' THEN 'invalid JSON'
            WHEN 'truncated' THEN 'output TRUNCATED at the token cap and could not be repaired.' ELSE 'wrong shape' END, attempt) AS error FROM jd GROUP BY 1)
      SELECT up.upload, model_number, up.stock_id, price_aed, brand, model, trim, year, fuel_type, engine_size, transmission, 'regex' AS parsed_by, ext_raw, int_raw,
        s1.status AS ext_status, s1.id AS ext_id, s2.status AS int_status, s2.id AS int_id,
        concat_ws(';', CASE WHEN s1.status <> 'matched' THEN 'exterior colour' END, CASE WHEN s2.status <> 'matched' THEN 'interior colour' END) AS unresolved,
        coalesce(n_attempts, 0) AS n_attempts, attempt, CASE WHEN attempt IS NOT NULL THEN CAST(truncated AS INT) + CAST(attempt > first AS INT) END AS n_notes,
        CASE WHEN n_attempts IS NULL THEN 'no reply for the uploaded sheet' WHEN attempt IS NULL THEN error END AS extraction_error
      FROM up LEFT JOIN vb ON vb.stock_id = up.stock_id LEFT JOIN sh_ ON sh_.upload = up.upload
      LEFT JOIN sv s1 ON s1.parent = 'Color' AND s1.value = ext_value LEFT JOIN sv s2 ON s2.parent = 'Interior Color' AND s2.value = int_raw""",
}
