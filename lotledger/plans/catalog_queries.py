"""Registered queries over catalog, feature and specification resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotledger.operators import features, resolve, specs
from lotledger.plans import resolve_sql as rs
from lotledger.plans.derive import table, with_clause


def _options(df):
    return df.withColumn("aliases", F.array("alias"))


def _flat(res):
    """Result struct as flat columns; scores as thousandths, candidates as text."""
    milli = lambda c: F.bround(c * 1000, 0).cast("int")
    line = lambda c: F.concat(c["id"], F.lit(":"), milli(c["score"]).cast("string"))
    return (
        res.status.alias("status"), res.method.alias("method"), milli(res.confidence).alias("conf_milli"),
        res.id.alias("id"), res["name"].alias("name"),
        F.array_join(F.transform(res.candidates, line), ";").alias("candidates"),
    )


def taxonomy_resolve(spark, sf):
    values = table(spark, sf, "catalog_values")
    out = resolve.resolve_column(values, "value", _options(table(spark, sf, "catalog_options")))
    return out.select("row_id", *_flat(F.col("res")))


def taxonomy_resolve_hot_tokens(spark, sf):
    """Same question with every common token treated as hot; the answer may not change."""
    values = table(spark, sf, "catalog_values")
    out = resolve.resolve_column(values, "value", _options(table(spark, sf, "catalog_options")))
    return out.select("row_id", *_flat(F.col("res")))


def taxonomy_hierarchy(spark, sf):
    nodes = _options(table(spark, sf, "taxonomy_nodes"))
    out = resolve.resolve_vehicles(table(spark, sf, "taxonomy_cars"), nodes)
    cols = [
        c
        for lv in ("brand", "model", "trim")
        for c in (F.col(f"{lv}_res.status").alias(f"{lv}_status"), F.col(f"{lv}_res.id").alias(f"{lv}_id"),
                  F.col(f"{lv}_res.method").alias(f"{lv}_method"), F.size(f"{lv}_res.candidates").alias(f"{lv}_n_candidates"))
    ]
    return out.select("car", *cols, "ready_to_prefill", "blocked_on")


def _feature_catalog(spark, sf):
    return table(spark, sf, "feature_catalog").withColumn("id", F.col("id_n").cast("string")).drop("id_n")


def feature_catalog_resolve(spark, sf):
    out = features.resolve_features(table(spark, sf, "feature_labels"), _feature_catalog(spark, sf))
    return out.select("kind", "car", "id", "label", "ord", "status", "method", "parent_id",
                      F.when(F.col("kind") == "unresolved", F.size("candidates")).alias("n_candidates"))


def feature_groups_unfilled(spark, sf):
    labels = table(spark, sf, "feature_labels")
    found = features.resolve_features(labels, _feature_catalog(spark, sf)).filter("kind = 'matched'")
    mandatory = spark.createDataFrame([("Exterior", 2), ("Comfort", 4)], "name string, ord int")
    gaps = specs.mandatory_gaps(labels.select("car").distinct(), found.select("car", F.col("parent").alias("name")), mandatory)
    return gaps.select("car", F.array_join("unfilled", ";").alias("unfilled"), "ready_to_prefill")


def _spec_catalog(spark, sf):
    return table(spark, sf, "spec_catalog").withColumn("id", F.col("id_n").cast("string")).drop("id_n")


def _specs(spark, sf):
    return specs.resolve_specifications(
        table(spark, sf, "spec_rows"), _spec_catalog(spark, sf), table(spark, sf, "spec_parents"),
        table(spark, sf, "spec_fallbacks"),
    )


def spec_resolve(spark, sf):
    return _specs(spark, sf).select(
        "kind", "car", "parent", "id", "name", "matched_from", "method", "status", "label", "value",
        F.when(F.col("kind") != "resolved", F.col("ord")).alias("ord"),
        F.when(F.col("kind") == "unresolved", F.size("candidates")).alias("n_candidates"),
    )


def spec_mandatory_unfilled(spark, sf):
    done = _specs(spark, sf).filter("kind = 'resolved'").select("car", F.col("parent").alias("name"))
    cars = table(spark, sf, "orders").select(F.col("o_orderkey").alias("car"))
    parents = table(spark, sf, "spec_parents").filter("mandatory = 1")
    gaps = specs.mandatory_gaps(cars, done, parents)
    return gaps.select("car", F.array_join("unfilled", ";").alias("unfilled"), "ready_to_prefill")


def _vocabulary(spark, sf):
    return table(spark, sf, "feature_catalog").select(F.col("parent").alias("group"), F.col("name").alias("label"), "ord")


def _items(spark, sf):
    return table(spark, sf, "feature_labels").withColumnRenamed("label", "item")


def feature_match(spark, sf):
    """Flat and grouped vocabulary matching of every label."""
    items, vocab = _items(spark, sf), _vocabulary(spark, sf)
    usable = items.filter("trim(item) != ''")
    flat = features.match_vocabulary(usable, vocab, flat=True).select("item", F.col("label").alias("flat_label"))
    grouped = features.match_vocabulary(usable, vocab, flat=False).select("item", F.col("group").alias("grouped_group"), F.col("label").alias("grouped_label"))
    return items.join(flat, "item", "left").join(grouped, "item", "left").groupBy(
        "item", "flat_label", "grouped_group", "grouped_label"
    ).agg(F.count("*").alias("n_rows"))


def feature_enrich(spark, sf):
    got, notes = features.enrich_features(_items(spark, sf), _vocabulary(spark, sf))
    return got.select("car", "group", F.array_join("labels", "; ").alias("labels")).unionByName(
        notes.select("car", F.lit("(none)").alias("group"), F.col("note").alias("labels"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        taxonomy_resolve, taxonomy_resolve_hot_tokens, taxonomy_hierarchy, feature_catalog_resolve,
        feature_groups_unfilled, spec_resolve, spec_mandatory_unfilled, feature_match, feature_enrich,
    )
}

_TAX = f"""WITH {with_clause('catalog_values', 'catalog_options')},
  vv AS (SELECT 0 AS scope, value FROM catalog_values), oo AS (SELECT 0 AS scope, id, name, alias, ord FROM catalog_options),
  {rs.resolve_ctes('vv', 'oo', 'm')}
  SELECT row_id, status, method, conf_milli, id, name, candidates FROM catalog_values c JOIN m ON m.value = trim(c.value)"""


def _level(level: str, scope: str, parent: str | None) -> str:
    src = "taxonomy_cars" if parent is None else f"(SELECT t.*, p.{scope} FROM taxonomy_cars t JOIN {parent} p ON p.car = t.car)"
    value_scope = "'all'" if parent is None else scope
    node_scope = "'all'" if parent is None else "parent_id"
    return f"""{level}_v AS (SELECT car, {value_scope} AS scope, {level} AS value FROM {src} WHERE {value_scope} IS NOT NULL),
{level}_o AS (SELECT {node_scope} AS scope, id, name, alias, ord FROM taxonomy_nodes WHERE level = '{level}'),
{rs.resolve_ctes(f'{level}_v', f'{level}_o', f'{level}_m')},
{level}_x AS (SELECT v.car, m.*, CASE WHEN status = 'matched' THEN id END AS {level}_found FROM {level}_v v JOIN {level}_m m ON m.scope = v.scope AND m.value = trim(v.value))"""


_N = "CASE WHEN {c} = '' OR {c} IS NULL THEN 0 ELSE len(string_split({c}, ';')) END"
_FEAT = f"""{with_clause('feature_labels', 'feature_catalog')},
  fv AS (SELECT 0 AS scope, label AS value FROM feature_labels), fo AS (SELECT 0 AS scope, CAST(id_n AS STRING) AS id, name, slug AS alias, ord FROM feature_catalog),
  {rs.resolve_ctes('fv', 'fo', 'fm')},
  fx AS (SELECT l.car, l.ord, trim(l.label) AS label, m.* EXCLUDE (value, scope) FROM feature_labels l JOIN fm m ON m.value = trim(l.label) WHERE trim(l.label) <> ''),
  feats AS (SELECT 'matched' AS kind, car, id, arg_min(label, ord) AS label, min(ord) AS ord, 'matched' AS status, arg_min(method, ord) AS method
            FROM fx WHERE status = 'matched' GROUP BY car, id)"""
_SPEC = f"""{with_clause('spec_rows', 'spec_parents', 'spec_catalog', 'spec_fallbacks')},
  sr AS (SELECT car, ord, trim(label) AS label, trim(value) AS value FROM spec_rows WHERE trim(label) <> '' AND trim(value) <> ''),
  sl AS (SELECT label, {rs.parent_case('label')} AS hint FROM (SELECT DISTINCT label FROM sr)),
  sf AS (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY s DESC, ord) AS rn, s FROM
         (SELECT l.label, p.name, p.ord, {rs.score('p.t', 'l.t')} AS s FROM (SELECT *, {rs.tokens('label')} AS t FROM sl WHERE hint IS NULL) l
          CROSS JOIN (SELECT *, {rs.tokens('name')} AS t FROM spec_parents) p)),
  lp AS (SELECT sl.label, coalesce(hint, f.name) AS parent FROM sl LEFT JOIN (SELECT * FROM sf WHERE rn = 1 AND s >= CAST(0.6 AS DOUBLE)) f ON f.label = sl.label),
  body AS (SELECT car, stage, ord, parent, value, CASE WHEN stage = 1 AND parent = 'Color' AND contains(value, ' & ') THEN
             trim(regexp_replace(string_split(value, ' & ')[1], '(?i)\\b(body|roof|colour|color)\\b', ' ', 'g')) ELSE value END AS v FROM spec_fallbacks),
  asked AS (SELECT car, 0 AS stage, ord, parent, sr.label, value FROM sr JOIN lp ON lp.label = sr.label WHERE parent IS NOT NULL
            UNION ALL SELECT car, stage, ord, parent, CASE stage WHEN 1 THEN 'model code' ELSE 'folder path' END, v FROM body WHERE v <> ''),
  {rs.spec_value_ctes('asked', 'spec_catalog', 'sv')},
  fd AS (SELECT a.*, v.status, v.method, v.id, v.name, v.candidates FROM asked a JOIN sv v ON v.parent = a.parent AND v.value = a.value),
  wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY car, parent ORDER BY stage, ord) AS rn FROM fd WHERE status = 'matched') WHERE rn = 1),
  specs AS (
    SELECT 'resolved' AS kind, car, parent, id, name,
      CASE stage WHEN 0 THEN concat(label, ': ', value) WHEN 1 THEN concat('model code: ', value) ELSE concat('folder path: ', value) END AS matched_from,
      concat(CASE stage WHEN 0 THEN '' WHEN 1 THEN 'model_code_' ELSE 'folder_path_' END, method) AS method, 'matched' AS status,
      NULL AS label, NULL AS value, NULL AS ord, NULL AS n_candidates FROM wn
    UNION ALL SELECT 'unresolved', f.car, f.parent, NULL, NULL, NULL, NULL, f.status, f.label, f.value, f.ord, {_N.format(c='f.candidates')}
      FROM fd f LEFT JOIN wn w ON w.car = f.car AND w.parent = f.parent
      WHERE f.status <> 'matched' AND (f.stage = 0 OR (f.stage = 1 AND f.candidates <> '')) AND (w.car IS NULL OR (f.stage, f.ord) < (w.stage, w.ord))
    UNION ALL SELECT 'unmapped', car, NULL, NULL, NULL, NULL, NULL, NULL, sr.label, value, ord, NULL FROM sr JOIN lp ON lp.label = sr.label WHERE lp.parent IS NULL)"""
_VOC = f"""{with_clause('feature_labels', 'feature_catalog')},
  it AS (SELECT car, ord, label AS item FROM feature_labels WHERE trim(label) <> ''),
  vo AS (SELECT parent AS grp, name AS label, ord FROM feature_catalog),
  {rs.vocab_ctes('it', 'vo', True, 'vf')}, {rs.vocab_ctes('it', 'vo', False, 'vg')}"""

ORACLES = {
    "taxonomy_resolve": _TAX,
    "taxonomy_resolve_hot_tokens": _TAX,
    "taxonomy_hierarchy": f"""WITH {with_clause('taxonomy_nodes', 'taxonomy_cars')},
      {_level('brand', '', None)}, {_level('model', 'brand_found', 'brand_x')}, {_level('trim', 'model_found', 'model_x')}
      SELECT t.car, b.status AS brand_status, b.id AS brand_id, b.method AS brand_method, {_N.format(c='b.candidates')} AS brand_n_candidates,
        coalesce(m.status, 'missing') AS model_status, m.id AS model_id, coalesce(m.method, 'blocked_on_brand') AS model_method,
        {_N.format(c='m.candidates')} AS model_n_candidates,
        coalesce(r.status, 'missing') AS trim_status, r.id AS trim_id,
        coalesce(r.method, CASE WHEN b.status <> 'matched' THEN 'blocked_on_brand' ELSE 'blocked_on_model' END) AS trim_method,
        {_N.format(c='r.candidates')} AS trim_n_candidates, coalesce(r.status = 'matched', false) AS ready_to_prefill,
        CASE WHEN b.status <> 'matched' THEN 'brand' WHEN m.status <> 'matched' THEN 'model' WHEN r.status <> 'matched' THEN 'trim' END AS blocked_on
      FROM taxonomy_cars t JOIN brand_x b ON b.car = t.car LEFT JOIN model_x m ON m.car = t.car LEFT JOIN trim_x r ON r.car = t.car""",
    "feature_catalog_resolve": f"""WITH {_FEAT}
      SELECT f.*, c.parent_id, NULL AS n_candidates FROM feats f JOIN feature_catalog c ON CAST(c.id_n AS STRING) = f.id
      UNION ALL SELECT 'unresolved', car, NULL, label, ord, status, NULL, NULL, {_N.format(c='candidates')} FROM fx WHERE status <> 'matched'""",
    "feature_groups_unfilled": f"""WITH {_FEAT},
      got AS (SELECT f.car, bool_or(c.parent = 'Exterior') AS e, bool_or(c.parent = 'Comfort') AS k FROM feats f
              JOIN feature_catalog c ON CAST(c.id_n AS STRING) = f.id GROUP BY f.car),
      allc AS (SELECT a.car, coalesce(e, false) AS e, coalesce(k, false) AS k FROM (SELECT DISTINCT car FROM feature_labels) a LEFT JOIN got ON got.car = a.car)
      SELECT car, CASE WHEN e AND k THEN '' WHEN e THEN 'Comfort' WHEN k THEN 'Exterior' ELSE 'Exterior;Comfort' END AS unfilled, e AND k AS ready_to_prefill FROM allc""",
    "spec_resolve": f"WITH {_SPEC} SELECT * FROM specs",
    "spec_mandatory_unfilled": f"""WITH {_SPEC},
      got AS (SELECT car, bool_or(parent = 'Body Type') AS b, bool_or(parent = 'Fuel Type') AS f FROM wn GROUP BY car),
      allc AS (SELECT o_orderkey AS car, coalesce(b, false) AS b, coalesce(f, false) AS f FROM orders LEFT JOIN got ON car = o_orderkey)
      SELECT car, CASE WHEN b AND f THEN '' WHEN b THEN 'Fuel Type' WHEN f THEN 'Body Type' ELSE 'Body Type;Fuel Type' END AS unfilled, b AND f AS ready_to_prefill FROM allc""",
    "feature_match": f"""WITH {_VOC}
      SELECT l.label AS item, vf.label AS flat_label, vg.grp AS grouped_group, vg.label AS grouped_label, count(*) AS n_rows
      FROM feature_labels l LEFT JOIN vf ON vf.item = l.label LEFT JOIN vg ON vg.item = l.label GROUP BY ALL""",
    "feature_enrich": f"""WITH {_VOC},
      fo AS (SELECT car, grp, vg.label, min(ord) AS ord FROM it JOIN vg ON vg.item = it.item WHERE grp IS NOT NULL GROUP BY ALL)
      SELECT car, grp AS "group", string_agg(label, '; ' ORDER BY ord, label) AS labels FROM fo GROUP BY car, grp
      UNION ALL SELECT car, '(none)', concat('no_matching_checkbox_for: ', string_agg(it.item, ', ' ORDER BY ord, it.item)) FROM it JOIN vg ON vg.item = it.item
      WHERE grp IS NULL GROUP BY car""",
}
