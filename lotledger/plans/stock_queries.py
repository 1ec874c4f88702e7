"""Registered queries over the stock feed, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotledger.functions import text as tx
from lotledger.operators import changes, diff, pending
from lotledger.plans.derive import table, with_clause
from lotledger.sources import listings as listing_source
from lotledger.sources.stock import stock_rows


def _stock(spark, sf, source="stock_file"):
    return stock_rows(table(spark, sf, source), "ord")


def stock_headers(spark, sf):
    """An export with its own headers: blanks and capitals, aliases, one alias whose target is taken."""
    e = table(spark, sf, "events")
    export = e.select(
        F.col("event_id").alias("Ord"), F.concat(F.lit(" E"), F.col("event_id").cast("string"), F.lit(" ")).alias("  Model Code "),
        F.col("value").cast("int").cast("string").alias("List Price"), F.col("event_type").alias("Description"),
        F.lit("taken").alias("Color"), F.col("props").alias("Exterior Color"), F.col("user_id").cast("string").alias("Int Color"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("Vehicle Card:_Vehicle Card Name"),
    )
    return stock_rows(export, "ord").select(
        "ord", "model_code", "price", "product_description", "exterior_color", "color", "interior_color", "stock_id", "available"
    )


def listings_read(spark, sf):
    """Stored listings, one JSON text a part, with keys the schema doesn't know and broken records."""
    good, bad = listing_source.parse_listings(table(spark, sf, "stored_listings"))
    extra = lambda k: F.element_at("extra", k)
    rows = good.select(
        F.lit("listing").alias("kind"), "model_number", "status", "price_aed", extra("body").alias("body"), extra("size").alias("size")
    )
    return rows.unionByName(bad.select(F.lit("broken").alias("kind"), F.col("record").alias("model_number")), allowMissingColumns=True)


def stock_collapse(spark, sf):
    rows = _stock(spark, sf, "stock_all")
    aliases = diff.stock_aliases(rows).groupBy("model_code").agg(
        F.count("*").alias("n_aliases"), F.min("alias").alias("first_alias"), F.max("alias").alias("last_alias")
    )
    return (
        diff.collapse_stock(rows)
        .join(aliases, "model_code", "left")
        .select(
            "model_code", "n_rows", "price", "product_description", "stock_id", "available",
            "n_aliases", "first_alias", "last_alias",
        )
    )


def stock_diff(spark, sf):
    return diff.stock_diff(_stock(spark, sf), table(spark, sf, "live_listings"))


def stock_diff_counts(spark, sf):
    return stock_diff(spark, sf).groupBy("bucket").agg(F.count("*").alias("n_rows"))


def pending_reconcile(spark, sf):
    return pending.reconcile(table(spark, sf, "pending_rows"), table(spark, sf, "live_listings"))


def pending_remove(spark, sf):
    report = table(spark, sf, "pending_rows")
    listings = table(spark, sf, "live_listings")
    left = pending.remove_applied(report, "price_updated", listings.filter("status = 'active'"))
    return pending.remove_published(
        left, listings.filter("status = 'hidden'").select(F.col("model_number").alias("identifier"))
    )


def pending_lookup(spark, sf):
    found = pending.pending_entries(
        table(spark, sf, "pending_rows"), table(spark, sf, "live_listings").select("model_number").distinct()
    )
    return found.select(
        "model_number",
        F.col("entry.row_id").alias("row_id"),
        F.nullif("entry.product_description", F.lit("")).alias("product_description"),
    )


def listing_entry(spark, sf):
    """Caller values over staged values, one row per model number."""
    staged = (
        table(spark, sf, "pending_all")
        .filter("bucket = 'new'")
        .groupBy("model_number")
        .agg(F.min_by(F.struct("product_description", "price_aed"), "row_id").alias("e"))
        .select(
            "model_number", "e.*",
            F.lit("WHITE").alias("exterior_color"), F.lit(None).cast("string").alias("interior_color"),
        )
    )
    caller = (
        diff.collapse_stock(_stock(spark, sf, "stock_all"))
        .withColumnRenamed("model_code", "model_number")
        .select("model_number", "product_description", F.col("price").alias("price_aed"), "exterior_color", "interior_color")
    )
    return pending.listing_entries(staged, caller)


def _counted(df):
    return df.withColumn("updated_at", F.col("updated_at").cast("int")).select(
        "model_number", "status", "price_aed", "updated_at", "applied"
    )


def apply_hidden(spark, sf):
    wanted = table(spark, sf, "price_items").select("model_number")
    return _counted(changes.apply_hidden(table(spark, sf, "part_listings"), wanted, F.lit(1)))


def apply_price_updates(spark, sf):
    return _counted(
        changes.apply_price_updates(table(spark, sf, "part_listings"), table(spark, sf, "price_items"), F.lit(1))
    )


def update_listings(spark, sf):
    changed = changes.update_listings(
        table(spark, sf, "part_listings"),
        table(spark, sf, "listing_changes").withColumnRenamed("ord", "change_ord"),
        F.lit(1), "ord", "change_ord",
    )
    return _counted(changed)


def publish_new(spark, sf):
    listings = table(spark, sf, "part_listings")
    reviewed = table(spark, sf, "reviewed_cars").select("model_number", "status", "price_aed", "ord")
    added, conflicts = changes.publish_new(listings, reviewed, F.lit(1))
    pick = lambda df, tag: df.select(
        F.lit(tag).alias("result"), "model_number", "status", "price_aed", F.col("ord").alias("review_ord")
    )
    return pick(added, "added").unionByName(pick(conflicts, "conflict"))


QUERIES = {
    f.__name__: f
    for f in (
        stock_headers, listings_read, stock_collapse, stock_diff, stock_diff_counts, pending_reconcile, pending_remove, pending_lookup,
        listing_entry, apply_hidden, apply_price_updates, update_listings, publish_new,
    )
}


def _key(c: str) -> str:
    up = f"upper(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
    return f"CASE WHEN {up} = 'NAN' THEN '' ELSE {up} END"


def _rows(stock: str, staged: str) -> str:
    return f"""{with_clause(stock, 'live_listings', staged)},
rows_ AS (
  SELECT *, TRY_CAST(replace(trim(aed_price), ',', '') AS DOUBLE) AS price,
         {_key('product_description')} AS dk, {_key('stock_id')} AS sk, {_key('model_code')} AS ck
  FROM {stock} WHERE trim(model_code) <> '' AND lower(trim(model_code)) <> 'nan'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_code ORDER BY (price IS NULL), ord) AS rn,
         count(*) OVER (PARTITION BY model_code) AS n_rows,
         min(ord) OVER (PARTITION BY model_code) AS first_ord FROM rows_),
picked AS (SELECT * FROM ranked WHERE rn = 1),
alias_ AS (SELECT model_code, dk AS alias, first_ord FROM ranked WHERE dk <> ''
           UNION SELECT model_code, sk, first_ord FROM ranked WHERE sk <> ''),
keys_ AS (
  SELECT key, model_code FROM (
    SELECT key, model_code, row_number() OVER (PARTITION BY key ORDER BY own DESC, first_ord DESC) AS rn FROM (
      SELECT alias AS key, model_code, 0 AS own, first_ord FROM alias_
      UNION ALL SELECT ck, model_code, 1, first_ord FROM picked)) WHERE rn = 1),
listed AS (SELECT *, {_key('model_number')} AS lk FROM live_listings),
matched AS (
  SELECT * FROM (
    SELECT k.model_code, l.model_number, l.status, l.price_aed AS old_price,
           row_number() OVER (PARTITION BY k.model_code ORDER BY l.ord) AS rn
    FROM listed l JOIN keys_ k ON l.lk = k.key) WHERE rn = 1),
guess AS (
  SELECT p.*, array_to_string(list_transform(regexp_extract_all(trim(split_part(coalesce(p.product_description, ''), '-', 1)), '[A-Za-z]+|[^A-Za-z]+'),
                lambda w: upper(w[1:1]) || lower(w[2:])), '') AS g1,
         array_to_string(list_transform(regexp_extract_all(trim(split_part(p.model_code, '-', 1)), '[A-Za-z]+|[^A-Za-z]+'),
                lambda w: upper(w[1:1]) || lower(w[2:])), '') AS g2 FROM picked p),
diff_ AS (
  SELECT CASE WHEN m.model_code IS NULL THEN 'new' WHEN g.price IS NULL THEN 'unchanged'
              WHEN m.status = 'hidden' THEN 'restocked'
              WHEN m.old_price IS DISTINCT FROM g.price THEN 'price_updated' ELSE 'unchanged' END AS bucket,
         g.*, m.model_number AS listed_number, m.old_price
  FROM guess g LEFT JOIN matched m ON g.model_code = m.model_code),
report AS (
  SELECT bucket, CASE WHEN bucket = 'new' THEN model_code ELSE listed_number END AS model_number,
         CASE WHEN bucket <> 'unchanged' THEN coalesce(product_description, '') END AS product_description,
         CASE WHEN bucket = 'new' THEN coalesce(nullif(g1, ''), g2) END AS brand,
         CASE WHEN bucket = 'new' THEN '' END AS model, CASE WHEN bucket = 'new' THEN '' END AS trim,
         CASE WHEN bucket = 'new' THEN 2000 + TRY_CAST(nullif(regexp_extract(trim(model_code), '-(\\d{{2}})$', 1), '') AS INT) END AS year,
         CASE WHEN bucket = 'new' THEN price WHEN bucket = 'unchanged' THEN old_price END AS price_aed,
         CASE WHEN bucket = 'new' THEN nullif(available, '') END AS available,
         CASE WHEN bucket = 'new' THEN nullif(exterior_color, '') END AS exterior_color,
         CASE WHEN bucket = 'new' THEN nullif(interior_color, '') END AS interior_color,
         CASE WHEN bucket IN ('restocked', 'price_updated') THEN old_price END AS old_price_aed,
         CASE WHEN bucket IN ('restocked', 'price_updated') THEN price END AS new_price_aed
  FROM diff_
  UNION ALL
  SELECT 'hidden', model_number, '', NULL, NULL, NULL, NULL, price_aed, NULL, NULL, NULL, NULL, NULL
  FROM listed WHERE status = 'active' AND lk NOT IN (SELECT key FROM keys_))"""


_ROWS, _ALL_ROWS = _rows("stock_file", "pending_rows"), _rows("stock_all", "pending_all")

_PENDING = f"""{with_clause('pending_rows', 'live_listings')},
p AS (SELECT *, {_key('model_number')} AS mk, {_key('product_description')} AS dk FROM pending_rows),
l AS (SELECT *, {_key('model_number')} AS lk FROM live_listings),
new_keys AS (SELECT row_id, mk AS k FROM p WHERE bucket = 'new' AND mk <> ''
             UNION SELECT row_id, dk FROM p WHERE bucket = 'new' AND dk <> '')"""
_COLS = "row_id, bucket, model_number, product_description, price_aed"

ORACLES = {
    "stock_headers": """SELECT event_id AS ord, concat('E', CAST(event_id AS STRING)) AS model_code, CAST(CAST(trunc(value) AS INT) AS DOUBLE) AS price,
      event_type AS product_description, props AS exterior_color, 'taken' AS color, CAST(user_id AS STRING) AS interior_color,
      concat('S', CAST(user_id AS STRING)) AS stock_id, CAST(NULL AS STRING) AS available FROM events""",
    "listings_read": f"""WITH {with_clause('stored_listings')}
      SELECT CASE WHEN json_valid(record) THEN 'listing' ELSE 'broken' END AS kind,
        CASE WHEN json_valid(record) THEN record ->> '$.model_number' ELSE record END AS model_number,
        CASE WHEN json_valid(record) THEN record ->> '$.status' END AS status,
        CASE WHEN json_valid(record) THEN CAST(record ->> '$.price_aed' AS DOUBLE) END AS price_aed,
        CASE WHEN json_valid(record) THEN record ->> '$.body' END AS body,
        CASE WHEN json_valid(record) THEN record ->> '$.size' END AS size
      FROM stored_listings""",
    "stock_collapse": f"""WITH {_ALL_ROWS},
      a AS (SELECT model_code, count(*) AS n_aliases, min(alias) AS first_alias, max(alias) AS last_alias
            FROM alias_ GROUP BY model_code)
      SELECT p.model_code, n_rows, price, product_description, stock_id, available, n_aliases, first_alias, last_alias
      FROM picked p LEFT JOIN a ON a.model_code = p.model_code""",
    "stock_diff": f"WITH {_ROWS} SELECT * FROM report",
    "stock_diff_counts": f"WITH {_ROWS} SELECT bucket, count(*) AS n_rows FROM report GROUP BY bucket",
    "pending_reconcile": f"""WITH {_PENDING}
      SELECT {_COLS} FROM p WHERE
        (bucket = 'new' AND row_id NOT IN (SELECT row_id FROM new_keys WHERE k IN (SELECT lk FROM l WHERE lk <> '')))
        OR (bucket = 'hidden' AND mk NOT IN (SELECT k FROM new_keys)) OR bucket NOT IN ('new', 'hidden')""",
    "pending_remove": f"""WITH {_PENDING}
      SELECT {_COLS} FROM p WHERE
        NOT (bucket = 'price_updated' AND model_number IN (SELECT model_number FROM l WHERE status = 'active'))
        AND NOT (bucket = 'new' AND row_id IN (SELECT row_id FROM new_keys WHERE k IN (SELECT lk FROM l WHERE status = 'hidden')))""",
    "pending_lookup": f"""WITH {_PENDING},
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_number ORDER BY row_id) AS rn
                           FROM p WHERE bucket = 'new') WHERE rn = 1)
      SELECT w.model_number, f.row_id, nullif(f.product_description, '') AS product_description
      FROM (SELECT DISTINCT model_number FROM l) w LEFT JOIN f ON f.model_number = w.model_number""",
    "listing_entry": f"""WITH {_ALL_ROWS},
      s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_number ORDER BY row_id) AS rn
                           FROM pending_all WHERE bucket = 'new') WHERE rn = 1)
      SELECT coalesce(s.model_number, c.model_code) AS model_number,
             coalesce(nullif(c.product_description, ''), s.product_description) AS product_description,
             coalesce(c.price, s.price_aed) AS price_aed,
             coalesce(nullif(c.exterior_color, ''), CASE WHEN s.model_number IS NOT NULL THEN 'WHITE' END) AS exterior_color,
             nullif(c.interior_color, '') AS interior_color
      FROM s FULL JOIN picked c ON c.model_code = s.model_number""",
    "apply_hidden": f"""WITH {with_clause('part_listings', 'price_items')},
      m AS (SELECT *, status <> 'hidden' AND model_number IN (SELECT model_number FROM price_items) AS applied FROM part_listings)
      SELECT model_number, CASE WHEN applied THEN 'hidden' ELSE status END AS status, price_aed,
             CASE WHEN applied THEN 1 ELSE 0 END AS updated_at, applied FROM m""",
    "apply_price_updates": f"""WITH {with_clause('part_listings', 'price_items')},
      i AS (SELECT model_number, arg_max(new_price_aed, ord) AS p FROM price_items GROUP BY model_number)
      SELECT l.model_number, CASE WHEN i.p IS NULL THEN status ELSE 'active' END AS status,
             coalesce(i.p, l.price_aed) AS price_aed, CASE WHEN i.p IS NULL THEN 0 ELSE 1 END AS updated_at,
             i.p IS NOT NULL AS applied
      FROM part_listings l LEFT JOIN i ON i.model_number = l.model_number""",
    "update_listings": f"""WITH {with_clause('part_listings', 'listing_changes')},
      c AS (SELECT model_number, arg_max(price_aed, ord) FILTER (WHERE price_aed IS NOT NULL) AS p,
                   arg_max(status, ord) FILTER (WHERE status IS NOT NULL) AS s FROM listing_changes GROUP BY model_number)
      SELECT l.model_number, coalesce(c.s, l.status) AS status, coalesce(c.p, l.price_aed) AS price_aed,
             CASE WHEN c.model_number IS NULL THEN 0 ELSE 1 END AS updated_at, c.model_number IS NOT NULL AS applied
      FROM part_listings l LEFT JOIN c ON c.model_number = l.model_number""",
    "publish_new": f"""WITH {with_clause('part_listings', 'reviewed_cars')},
      r AS (SELECT *, ord = min(ord) OVER (PARTITION BY model_number)
                   AND model_number NOT IN (SELECT model_number FROM part_listings) AS fresh
            FROM reviewed_cars)
      SELECT CASE WHEN fresh THEN 'added' ELSE 'conflict' END AS result, model_number,
             CASE WHEN fresh THEN coalesce(status, 'active') ELSE status END AS status, price_aed, ord AS review_ord FROM r""",
}
