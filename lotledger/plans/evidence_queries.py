"""Registered queries over evidence: identity, answers, colours, caches, trust."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotledger.functions import modelcode
from lotledger.functions import text as tx
from lotledger.functions import trust as tr
from lotledger.operators import answers, colours, identity, library
from lotledger.plans import parse_sql as ps
from lotledger.plans import resolve_sql as rs
from lotledger.plans.catalog_queries import _items, _spec_catalog, _vocabulary
from lotledger.plans.derive import table, with_clause
from lotledger.session import settle, shared_dir
from lotledger.sources import answer_cache


def identity_merge(spark, sf):
    return identity.merge_identity(table(spark, sf, "identity_code"), table(spark, sf, "identity_sheet")).drop("pos")


def identity_conflicts(spark, sf):
    merged = identity.merge_identity(table(spark, sf, "identity_code"), table(spark, sf, "identity_sheet"))
    return identity.conflict_summary(merged)


def trust(spark, sf):
    """Trust of every event read as a claim, by source and basis."""
    kinds, bases = F.array(*map(F.lit, tr.SOURCE_KINDS)), F.array(*map(F.lit, tr.IDENTITY_BASES))
    source = F.get(kinds, (F.col("event_id") % 8).cast("int"))
    basis = F.get(bases, (F.col("user_id") % 5).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", source.alias("source"), basis.alias("basis"), tr.is_unit_level(basis).alias("unit_level"),
        tr.trust(source, basis).alias("trust"),
    )


def _answers(spark, sf):
    return table(spark, sf, "provider_answers")


def provider_consensus(spark, sf):
    a = _answers(spark, sf)
    return answers.consensus(a, a.select("car", "provider"))


def provider_summary(spark, sf):
    attempts = _answers(spark, sf).groupBy("car", "provider").agg((F.max("ord") % 3 > 0).alias("ok"))
    return answers.provider_summary(attempts)


def feature_consensus(spark, sf):
    """Rules, then cleaned answers of all providers, in the order in which a car lists them."""
    a = _answers(spark, sf)
    return answers.list_places(answers.match_features(
        _items(spark, sf).select("car", "item"), _vocabulary(spark, sf), a, a.select("car", "provider")
    ))


def combined_match(spark, sf):
    first = _answers(spark, sf).filter("provider = 'A'").select("car", "kind", "ord", "label")
    return answers.match_all(_items(spark, sf).select("car", "ord", "item"), _vocabulary(spark, sf), first)


def _fields(spark):
    return spark.createDataFrame(
        [("color", "select", ["White", "Black"]), ("fuel", "select", ["Petrol", "Diesel"]), ("doors", "select", ["2", "4"]), ("horsepower", "text", [])],
        "field string, type string, options array<string>",
    )


def field_answers_clean(spark, sf):
    cleaned = answers.clean_field_answers(table(spark, sf, "field_answers").drop("ord"), _fields(spark))
    return cleaned.groupBy("car", "provider", "field", "value").agg(F.count("*").alias("n_rows"))


def field_precedence(spark, sf):
    one = table(spark, sf, "field_answers").groupBy("car", "provider", "field").agg(F.max_by("value", "ord").alias("value"))
    cleaned = answers.clean_field_answers(one, _fields(spark)).withColumn("rank", F.ascii("provider"))
    return answers.field_precedence(cleaned)


def _cache(spark, sf):
    rows = table(spark, sf, "answer_cache")
    empty = rows.filter("1 = 0")
    return colours.upsert_cache(empty, rows.drop("raw_key"))


def cache_upsert(spark, sf):
    rows = table(spark, sf, "answer_cache")
    return colours.upsert_cache(rows.filter("resolved_at % 2 = 0"), rows.filter("resolved_at % 2 = 1").drop("raw_key"))


def cache_reloaded(spark, sf):
    """The cache after its answers were appended in three batches, two of them compacted, and loaded again."""
    rows = table(spark, sf, "answer_cache").drop("raw_key")
    path = f"{shared_dir(spark)}/answers/{uuid.uuid4().hex}"
    stamped = rows.withColumn("resolved_at", F.timestamp_seconds("resolved_at"))
    for turn in range(3):
        answer_cache.append_answers(stamped.filter(F.unix_seconds("resolved_at") % 3 == turn), path)
        if turn < 2:
            answer_cache.compact(spark, path)
    return answer_cache.load_cache(spark, path).withColumn("resolved_at", F.unix_seconds("resolved_at"))


def cache_lookup(spark, sf):
    cars = table(spark, sf, "colour_cars").select("car_no", "pk", "sk", "parent", F.col("colour").alias("value"))
    out = colours.lookup_cache(cars, _cache(spark, sf), _spec_catalog(spark, sf))
    return out.groupBy("parent", "value", F.col("hit.status").alias("status"), F.col("hit.name").alias("name"), F.col("hit.method").alias("method")).agg(
        F.count("*").alias("n_rows")
    )


def colour_resolve(spark, sf):
    cars = table(spark, sf, "colour_cars").select("parent", F.col("colour").alias("raw"))
    found = colours.resolve_colours(cars, _spec_catalog(spark, sf), _cache(spark, sf), table(spark, sf, "colour_answers"))
    return cars.join(settle(found), ["parent", "raw"]).groupBy(
        "parent", "raw", F.col("res.status").alias("status"), F.col("res.id").alias("id"), F.col("res.method").alias("method")
    ).agg(F.count("*").alias("n_rows"))


def vehicle_fields(spark, sf):
    """Description fields with colours given, parsed or read off the folder."""
    # A file of cars is few tasks by its bytes; the rows are dealt out before their texts are parsed.
    n_tasks = 4 * spark.sparkContext.defaultParallelism
    strings = table(spark, sf, "car_strings").withColumn(
        "folder_path", F.concat(F.lit("lib/f"), (F.col("car_id") % 700).cast("string"), F.lit("/GREY INSIDE BLACK 26"))
    )
    cars = modelcode.parse_descriptions(strings.repartition(n_tasks), "car_string").select(
        F.col("car_id").alias("car"), "fields.brand", "fields.year",
        F.when(F.col("car_id") % 5 == 0, F.lit("White")).alias("given_exterior"), F.lit(None).cast("string").alias("given_interior"),
        F.col("fields.exterior_color").alias("exterior_color"), F.col("fields.interior_color").alias("interior_color"), "folder_path",
    )
    leaves = table(spark, sf, "leaf_names").select(
        F.concat(F.lit("lib/f"), (F.col("car_id") % 1100).cast("string"), F.lit("/"), F.col("leaf")).alias("path")
    )
    options = library.colour_options(strings.select(F.col("folder_path").alias("path")), leaves.repartition(n_tasks))
    out = colours.vehicle_colours(cars, options, _spec_catalog(spark, sf), _cache(spark, sf))
    return out.select(
        "car", "brand", "year", "ext_raw", "int_raw", F.col("ext_res.status").alias("ext_status"), F.col("ext_res.method").alias("ext_method"),
        F.col("ext_res.id").alias("ext_id"), F.col("int_res.status").alias("int_status"), F.col("int_res.method").alias("int_method"),
        F.array_join("unresolved_colors", ";").alias("unresolved"), "n_choices",
    )


QUERIES = {
    f.__name__: f
    for f in (
        identity_merge, identity_conflicts, trust, provider_consensus, provider_summary, feature_consensus, combined_match,
        field_answers_clean, field_precedence, cache_upsert, cache_reloaded, cache_lookup, colour_resolve, vehicle_fields,
    )
}

_IDENT = f"""{with_clause('identity_code', 'identity_sheet')},
  l AS (UNPIVOT (SELECT car, nullif(trim(brand), '') AS brand, nullif(trim(model), '') AS model, nullif(trim(trim), '') AS trim, CAST(year AS STRING) AS year FROM identity_code) ON brand, model, trim, year INTO NAME field VALUE v),
  r AS (UNPIVOT (SELECT car, nullif(trim(brand), '') AS brand, nullif(trim(model), '') AS model, nullif(trim(trim), '') AS trim, CAST(year AS STRING) AS year FROM identity_sheet) ON brand, model, trim, year INTO NAME field VALUE v),
  mg AS (SELECT coalesce(l.car, r.car) AS car, coalesce(l.field, r.field) AS field, coalesce(r.v, l.v) AS value,
    CASE WHEN r.v IS NULL THEN 'model_code' WHEN l.v IS NULL THEN 'spec_sheet' WHEN {ps.fp('l.v')} = {ps.fp('r.v')} THEN 'agreed' ELSE 'conflict' END AS source,
    coalesce(l.v IS NOT NULL AND r.v IS NOT NULL AND {ps.fp('l.v')} <> {ps.fp('r.v')}, false) AS conflict, l.v AS model_code, r.v AS spec_sheet
    FROM l FULL JOIN r ON l.car = r.car AND l.field = r.field)"""
_PANEL = "(SELECT car, count(DISTINCT provider) AS panel FROM provider_answers GROUP BY car)"
_VOC = f"""{with_clause('feature_labels', 'feature_catalog', 'provider_answers')},
  it AS (SELECT car, ord, label AS item FROM feature_labels WHERE trim(label) <> ''), vo AS (SELECT parent AS grp, name AS label, ord FROM feature_catalog),
  {rs.vocab_ctes('it', 'vo', True, 'vf')},
  ps_ AS (SELECT l.car, l.ord, l.label AS item, vf.label AS rule FROM feature_labels l LEFT JOIN vf ON vf.item = l.label)"""
_CLEAN = f"""{with_clause('field_answers')},
  opt AS (SELECT * FROM (VALUES ('color', 'White'), ('color', 'Black'), ('fuel', 'Petrol'), ('fuel', 'Diesel'), ('doors', '2'), ('doors', '4')) AS t(field, o))"""
_CANON = "CASE WHEN a.field = 'horsepower' THEN a.value ELSE (SELECT max(o) FROM opt WHERE opt.field = a.field AND lower(trim(o)) = lower(trim(a.value))) END"
_CACHE = f"""{with_clause('answer_cache', 'colour_cars', 'colour_answers', 'spec_catalog')},
  ca AS (SELECT parent, raw_key, arg_max(raw_value, resolved_at) AS raw_value, arg_max(status, resolved_at) AS status,
    arg_max(struct_pack(n := name), resolved_at).n AS name, arg_max(struct_pack(n := id), resolved_at).n AS id, max(resolved_at) AS resolved_at, arg_max(method, resolved_at) AS method FROM answer_cache GROUP BY parent, raw_key),
  cv AS (SELECT * FROM ca WHERE status <> 'matched' OR (parent, name) IN (SELECT parent, name FROM spec_catalog))"""
_BODY = """CASE WHEN contains(raw, ' & ') THEN trim(regexp_replace(string_split(raw, ' & ')[1], '(?i)\\b(body|roof|colour|color)\\b', ' ', 'g'))
      WHEN contains(raw, ' / ') THEN string_split(raw, ' / ')[1] ELSE trim(raw) END"""

ORACLES = {
    "identity_merge": f"WITH {_IDENT} SELECT * FROM mg",
    "identity_conflicts": f"""WITH {_IDENT} SELECT car, concat('The spec sheet and the Model Code disagree on ', string_agg(concat(field, ' (sheet says "', spec_sheet, '", code says "', model_code, '")'), '; '
        ORDER BY list_position(['brand', 'model', 'trim', 'year'], field)), '. The spec sheet''s reading was used — confirm it before publishing.') AS summary FROM mg WHERE conflict GROUP BY car""",
    "trust": f"""WITH e AS (SELECT event_id, [{ps.quoted(tr.SOURCE_KINDS)}][event_id % 8 + 1] AS source, [{ps.quoted(tr.IDENTITY_BASES)}][user_id % 5 + 1] AS basis FROM events)
      SELECT *, basis IN ({ps.quoted(tr.UNIT_LEVEL)}) AS unit_level, CASE WHEN source = 'language_model' THEN 'proposed' WHEN source = 'human' OR basis IN ({ps.quoted(tr.UNIT_LEVEL)}) THEN 'certain' ELSE 'assumed' END AS trust FROM e""",
    "provider_consensus": f"""WITH {with_clause('provider_answers')}, a AS (SELECT car, label, bool_or(kind = 'matched') AS matched, count(DISTINCT CASE WHEN kind <> 'matched' THEN provider END) AS n,
        bool_or(kind = 'important') AS imp FROM provider_answers GROUP BY car, label)
      SELECT a.car, label, matched, n = panel AS suggested, n = panel AND imp AS important FROM a JOIN {_PANEL} p ON p.car = a.car WHERE matched OR n = panel""",
    "provider_summary": f"""WITH {with_clause('provider_answers')}, p AS (SELECT car, provider, max(ord) % 3 > 0 AS ok FROM provider_answers GROUP BY car, provider)
      SELECT car, count(*) AS n_providers, count(*) FILTER (WHERE ok) AS n_answered, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE ok) < count(*) THEN 'degraded' ELSE 'complete' END AS state FROM p GROUP BY car""",
    "feature_consensus": f"""WITH {_VOC}, lf AS (SELECT DISTINCT car, item AS label FROM ps_ WHERE rule IS NULL),
      cl AS (SELECT a.car, provider, kind, CASE WHEN kind = 'matched' THEN (SELECT max(v.label) FROM vo v WHERE lower(trim(v.label)) = lower(trim(a.label))) ELSE l.label END AS label
        FROM provider_answers a LEFT JOIN lf l ON l.car = a.car AND l.label = a.label WHERE a.car IN (SELECT car FROM lf)),
      ag AS (SELECT cl.car, label, bool_or(kind = 'matched') AS matched, count(DISTINCT CASE WHEN kind <> 'matched' THEN provider END) AS n, bool_or(kind = 'important') AS imp, any_value(panel) AS panel
        FROM cl JOIN {_PANEL} p ON p.car = cl.car WHERE label IS NOT NULL GROUP BY cl.car, label),
      un AS (SELECT car, label, matched, n = panel AS suggested, n = panel AND imp AS important FROM ag WHERE matched OR n = panel
        UNION ALL SELECT DISTINCT car, rule, true, false, false FROM ps_ WHERE rule IS NOT NULL),
      ls AS (SELECT car, label, bool_or(matched) AS matched, bool_or(suggested) AS suggested, bool_or(important) AS important FROM un GROUP BY car, label)
      SELECT *, CASE WHEN matched THEN row_number() OVER (PARTITION BY car, matched ORDER BY encode(label)) END AS matched_place,
        CASE WHEN suggested THEN row_number() OVER (PARTITION BY car, suggested ORDER BY NOT important, encode(label)) END AS suggested_place FROM ls""",
    "combined_match": f"""WITH {_VOC}, a AS (SELECT * FROM provider_answers WHERE provider = 'A'),
      m AS (SELECT car, 0 AS source, ord, rule AS label FROM ps_ WHERE rule IS NOT NULL UNION ALL SELECT car, 1, ord, label FROM a WHERE kind = 'matched' AND label IN (SELECT label FROM vo))
      SELECT car, 'matched' AS kind, source, ord, label FROM (SELECT *, row_number() OVER (PARTITION BY car, label ORDER BY source, ord) AS rn FROM m) WHERE rn = 1
      UNION ALL SELECT car, kind, CASE kind WHEN 'important' THEN 0 ELSE 1 END, ord, label FROM a WHERE kind <> 'matched'""",
    "field_answers_clean": f"""WITH {_CLEAN}, c AS (SELECT car, provider, field, {_CANON} AS value FROM field_answers a WHERE trim(value) <> '' AND field <> 'bogus')
      SELECT car, provider, field, value, count(*) AS n_rows FROM c WHERE value IS NOT NULL GROUP BY ALL""",
    "field_precedence": f"""WITH {_CLEAN}, one AS (SELECT car, provider, field, arg_max(value, ord) AS value FROM field_answers WHERE value IS NOT NULL GROUP BY ALL),
      lastv AS (SELECT car, provider, field, max(ord) AS o FROM field_answers GROUP BY ALL), pick AS (SELECT f.* FROM field_answers f JOIN lastv l ON l.car = f.car AND l.provider = f.provider AND l.field = f.field AND l.o = f.ord),
      c AS (SELECT DISTINCT car, provider, field, {_CANON} AS value FROM pick a WHERE trim(value) <> '' AND field <> 'bogus')
      SELECT car, field, arg_min(value, provider) AS value, min(provider) AS provider FROM c WHERE value IS NOT NULL GROUP BY car, field""",
    "cache_upsert": f"WITH {_CACHE} SELECT * FROM ca",
    "cache_reloaded": f"WITH {_CACHE} SELECT * FROM ca",
    "cache_lookup": f"""WITH {_CACHE} SELECT c.parent, c.colour AS value, v.status, v.name, v.method, count(*) AS n_rows FROM colour_cars c
      LEFT JOIN cv v ON v.parent = c.parent AND v.raw_key = upper(trim(c.colour)) GROUP BY ALL""",
    "colour_resolve": f"""WITH {_CACHE}, q AS (SELECT parent, raw, CASE WHEN parent = 'Color' THEN {_BODY} ELSE raw END AS value, n FROM (SELECT parent, colour AS raw, count(*) AS n FROM colour_cars GROUP BY ALL)),
      qa AS (SELECT parent, value FROM q WHERE value <> ''), {rs.spec_value_ctes('qa', 'spec_catalog', 'sv')}
      SELECT q.parent, q.raw, CASE WHEN trim(q.raw) = '' THEN 'missing' WHEN s.status = 'matched' THEN 'matched' WHEN v.status IS NOT NULL THEN v.status
          WHEN a.choice IN (SELECT name FROM spec_catalog x WHERE x.parent = q.parent) THEN 'matched' ELSE 'missing' END AS status,
        CASE WHEN trim(q.raw) = '' THEN NULL WHEN s.status = 'matched' THEN s.id WHEN v.status = 'matched' THEN v.id WHEN v.status IS NOT NULL THEN NULL
          ELSE (SELECT CAST(min(id_n) AS STRING) FROM spec_catalog x WHERE x.parent = q.parent AND x.name = a.choice) END AS id,
        CASE WHEN trim(q.raw) = '' THEN 'empty' WHEN s.status = 'matched' THEN s.method WHEN v.status = 'matched' THEN 'ai_cached' WHEN v.status IS NOT NULL THEN 'ai_cached_no_match'
          WHEN a.choice IS NULL THEN 'llm_error' WHEN a.choice = 'NO_MATCH' THEN 'llm_no_match' WHEN a.choice IN (SELECT name FROM spec_catalog x WHERE x.parent = q.parent) THEN 'llm' ELSE 'llm_invalid_choice' END AS method, q.n AS n_rows
      FROM q LEFT JOIN sv s ON s.parent = q.parent AND s.value = q.value LEFT JOIN cv v ON v.parent = q.parent AND v.raw_key = upper(trim(q.value))
      LEFT JOIN colour_answers a ON a.parent = q.parent AND a.raw_key = upper(trim(q.value))""",
    "vehicle_fields": f"""WITH {with_clause('car_strings', 'leaf_names', 'spec_catalog')}, {ps.code_ctes('car_strings', 'car_id', 'car_string', 'codes')},
      {ps.leaf_ctes('leaf_names', 'car_id', 'leaf', 'lv')}, op AS (SELECT car_id % 1100 AS f, count(*) AS n FROM lv WHERE loose_exterior IS NOT NULL GROUP BY 1),
      c AS (SELECT k.car_id AS car, nullif(brand, '') AS brand, year, coalesce(CASE WHEN k.car_id % 5 = 0 THEN 'White' END, nullif(exterior_color, '')) AS e0, nullif(interior_color, '') AS i0, coalesce(op.n, 0) AS n
        FROM codes k LEFT JOIN op ON op.f = k.car_id % 700),
      d AS (SELECT *, e0 IS NULL OR i0 IS NULL AS cons, (e0 IS NULL OR i0 IS NULL) AND n > 1 AS sev FROM c),
      x AS (SELECT *, coalesce(e0, CASE WHEN cons AND NOT sev THEN 'GREY' END) AS ext_raw, coalesce(i0, CASE WHEN cons AND NOT sev THEN 'BLACK' END) AS int_raw FROM d),
      y AS (SELECT *, (SELECT v FROM (SELECT x.ext_raw AS raw) r, LATERAL (SELECT CASE WHEN r.raw IS NULL THEN NULL ELSE {_BODY.replace('raw', 'r.raw')} END AS v)) AS ev FROM x),
      qa AS (SELECT 'Color' AS parent, ev AS value FROM y WHERE ev IS NOT NULL UNION SELECT 'Interior Color', int_raw FROM y WHERE int_raw IS NOT NULL), {rs.spec_value_ctes('qa', 'spec_catalog', 'sv')},
      z AS (SELECT y.*, CASE WHEN e0 IS NULL AND sev THEN 'ambiguous' ELSE s1.status END AS ext_status, CASE WHEN e0 IS NULL AND sev THEN 'folder_ambiguous' WHEN e0 IS NULL THEN 'folder_' || s1.method ELSE s1.method END AS ext_method,
        CASE WHEN e0 IS NULL AND sev THEN NULL ELSE s1.id END AS ext_id, CASE WHEN i0 IS NULL AND sev THEN 'ambiguous' ELSE s2.status END AS int_status,
        CASE WHEN i0 IS NULL AND sev THEN 'folder_ambiguous' WHEN i0 IS NULL THEN 'folder_' || s2.method ELSE s2.method END AS int_method
        FROM y LEFT JOIN sv s1 ON s1.parent = 'Color' AND s1.value = ev LEFT JOIN sv s2 ON s2.parent = 'Interior Color' AND s2.value = int_raw)
      SELECT car, brand, year, ext_raw, int_raw, ext_status, ext_method, ext_id, int_status, int_method,
        concat_ws(';', CASE WHEN ext_status <> 'matched' THEN 'exterior colour' END, CASE WHEN int_status <> 'matched' THEN 'interior colour' END) AS unresolved, CASE WHEN sev THEN n ELSE 0 END AS n_choices FROM z""",
}
