"""Operator inputs derived from the driver's tables.

Each derivation is one SQL text that Spark and DuckDB both accept, so a query
and its oracle start from the same rows. Arithmetic is integer-only. A
derivation names the tables and derivations it reads in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lotledger.session import dealt, merged

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED: dict[str, str] = {}

# --- stock feed: the later half of the event stream is the uploaded file, the
# --- earlier half is what was listed before.
DERIVED["stock_file"] = """
SELECT event_id AS ord,
       concat(CASE WHEN event_id % 17 = 0 THEN 'MDL-' ELSE 'mdl-' END, CAST(user_id AS STRING), 'A',
              CAST(event_id % 13 AS STRING), '-', CAST(20 + user_id % 7 AS STRING)) AS model_code,
       CASE event_type
         WHEN 'view' THEN 'n/a'
         WHEN 'click' THEN NULL
         WHEN 'signup' THEN concat(CAST(1 + user_id % 3 AS STRING), ',', '000')
         ELSE concat(' ', CAST(1000 * (1 + CAST(floor(value) AS BIGINT) % 3) AS STRING), '.0') END AS aed_price,
       CASE WHEN event_id % 5 = 0 THEN NULL
            ELSE concat('brand', CAST(user_id % 5 AS STRING), 'x -line ', CAST(user_id % 40 AS STRING), '-26') END
         AS product_description,
       concat('S', CAST(event_id % 700 AS STRING)) AS stock_id,
       CASE WHEN user_id % 3 = 0 THEN 'WHITE' WHEN user_id % 3 = 1 THEN '' END AS exterior_color,
       CASE WHEN user_id % 4 = 0 THEN 'BLACK' END AS interior_color,
       event_type AS available
FROM {events} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
"""
DERIVED["live_listings"] = """
SELECT event_id AS ord,
       CASE event_type
         WHEN 'purchase' THEN concat('brand', CAST(user_id % 5 AS STRING), 'X  -line ', CAST(user_id % 40 AS STRING), '-26')
         WHEN 'signup' THEN concat('s', CAST(event_id % 900 AS STRING))
         ELSE concat('MDL-', CAST(user_id AS STRING), 'A', CAST(event_id % 13 AS STRING), '-',
                     CAST(20 + user_id % 7 AS STRING)) END AS model_number,
       CASE WHEN user_id % 6 = 0 THEN 'hidden' WHEN user_id % 17 = 0 THEN NULL ELSE 'active' END AS status,
       CASE WHEN event_id % 11 = 0 THEN NULL
            ELSE CAST(1000 * (1 + CAST(floor(value) AS BIGINT) % 3) AS DOUBLE) END AS price_aed
FROM {events} WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
"""
DERIVED["pending_rows"] = """
SELECT event_id AS row_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'new' WHEN event_type = 'error' THEN 'hidden'
            WHEN event_type = 'signup' THEN 'restocked' ELSE 'price_updated' END AS bucket,
       concat(CASE WHEN event_id % 3 = 0 THEN 'mdl-' ELSE 'MDL-' END, CAST(user_id AS STRING), 'A',
              CAST(event_id % 13 AS STRING), '-', CAST(20 + user_id % 7 AS STRING)) AS model_number,
       CASE WHEN event_type = 'view'
            THEN concat('brand', CAST(user_id % 5 AS STRING), 'x -line ', CAST(event_id % 40 AS STRING), '-26') END
         AS product_description,
       CAST(floor(value) AS DOUBLE) AS price_aed
FROM {events} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
"""
# The same rows over the whole event stream, for queries that need no earlier snapshot.
_LATER_HALF = "WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'"
DERIVED["stock_all"] = DERIVED["stock_file"].replace(_LATER_HALF, "")
DERIVED["pending_all"] = DERIVED["pending_rows"].replace(_LATER_HALF, "")
DERIVED["part_listings"] = """
SELECT concat('P', CAST(p_partkey AS STRING)) AS model_number, p_partkey AS ord,
       CASE WHEN p_size % 3 = 0 THEN 'hidden' ELSE 'active' END AS status,
       p_retailprice AS price_aed, p_name AS product_description, 0 AS updated_at
FROM {part}
"""
DERIVED["stored_listings"] = """
SELECT CASE WHEN p_partkey % 10 = 0 THEN substring(body, 1, CAST(20 + p_partkey % 20 AS INT)) ELSE body END AS record
FROM (SELECT p_partkey, replace(replace(concat('<"model_number": "P', CAST(p_partkey AS STRING), '", ',
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('"body": "', p_type, '", ') END, '"status": "', CASE WHEN p_size % 3 = 0 THEN 'hidden' ELSE 'active' END,
    '", "size": ', CAST(p_size AS STRING), ', "price_aed": ', CAST(p_size AS STRING), '.5>'), '<', chr(123)), '>', chr(125)) AS body FROM {part}) x
"""
DERIVED["price_items"] = """
SELECT concat('P', CAST(l_partkey AS STRING)) AS model_number, l_quantity AS new_price_aed,
       ((l_orderkey * 1000000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS ord
FROM {lineitem}
"""
DERIVED["listing_changes"] = """
SELECT concat('P', CAST(l_partkey AS STRING)) AS model_number,
       CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS price_aed,
       CASE WHEN l_linestatus = 'F' THEN 'hidden' WHEN l_tax > 0.06 THEN 'active' END AS status,
       ((l_orderkey * 1000000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS ord
FROM {lineitem}
"""
# Reviewed cars: every fifth part has a number that isn't listed yet.
DERIVED["reviewed_cars"] = DERIVED["listing_changes"].replace("concat('P', ", "concat(CASE WHEN l_partkey % 5 = 0 THEN 'Q' ELSE 'P' END, ")

_NAME = re.compile(r"\{(\w+)\}")
#: Tables that a derivation joins with a larger one, and that grow as it does.
_MERGED = {"library_entries": ("part",)}


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    """A driver table or a derivation. ``deal``: the rows that a derivation reads are dealt out to
    tasks by their number, for rows that are costly to parse."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    inputs = {n: table(spark, sf_dir, n) for n in set(_NAME.findall(text))}
    if deal:
        inputs = {n: dealt(df) for n, df in inputs.items()}
    return spark.sql(text, **{n: merged(df) if n in _MERGED.get(name, ()) else df for n, df in inputs.items()})


def with_clause(*names: str) -> str:
    """``WITH`` list for the oracle side, in dependency order."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in done:
            return
        for inner in _NAME.findall(DERIVED[name]):
            visit(inner)
        done[name] = _NAME.sub(r"\1", DERIVED[name])

    for name in names:
        visit(name)
    return ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())

# --- car strings: one per part, in the hyphenated house style, with every fault
# --- the grammar knows injected by key.
DERIVED["car_strings"] = """
SELECT car_id,
  CASE fault
    WHEN 1 THEN concat(name, '-', fuel, '-AT-', ext, '-', inter, '-', yy)
    WHEN 2 THEN concat(name, '-HEV-HEV-', engine, '-AT-', ext, '-', inter, '-', yy)
    WHEN 3 THEN concat(name, '-', fuel, '-', engine, '-AT-', ext, '-', inter, '-RED-20', yy)
    WHEN 4 THEN concat(name, '-', fuel, '-', engine, '-AT-', ext, '-', inter, '-jtm', CAST(100000000000 + car_id AS STRING), '-', yy)
    WHEN 5 THEN concat(yy, '-', name, '-', fuel, '-', engine, '-AT-', ext, '-', inter)
    WHEN 6 THEN concat(name, '-', fuel, '-', engine, '-', ext)
    WHEN 7 THEN concat(brand, '-', model, '-', fuel, '-', engine, '-MT-', ext, '-', inter, '-', yy)
    WHEN 8 THEN concat(name, '-', fuel, '-', engine, '-AT-AUTOMATIC-', ext, '-', inter, '-', yy)
    WHEN 9 THEN concat(name, '-', fuel, '-', engine, '-CVT-', ext, '-', inter, '-', yy, ' GT')
    WHEN 10 THEN concat(name, '-EV-83KWH 9STR-AT-', ext, '-', inter, '-', yy)
    WHEN 11 THEN '   '
    WHEN 12 THEN concat(name, '-', fuel, '-', engine, '-AT-', ext, '-', inter, '-20', yy, '-NEW')
    WHEN 13 THEN concat(name, '-DIESEL-2,4L-MANNULAL-', ext, '-', inter, '-', yy)
    WHEN 14 THEN concat(name, '-Plug_in_hybrid_Electric-1_5-AT-', ext, '-', inter, '-', yy)
    WHEN 15 THEN concat('  ', name, ' - ', fuel, ' -. ', engine, ' .- AT -  ', ext, '-', inter, '- ', yy, ' ')
    WHEN 16 THEN concat(name, '-', fuel, '-', engine, '-AT-', ext, '-', yy)
    WHEN 17 THEN concat('TOYOTA-', model, '-', fuel, '-', engine, '-AT-', ext, '-', inter, '-', yy)
    WHEN 18 THEN concat(name, '-EV-0-AT-', ext, '-', inter, '-', yy)
    WHEN 19 THEN concat(name, '-', fuel, '-', engine, '-X-AT-', ext, '-', inter)
    WHEN 20 THEN concat(name, '-', fuel, '-', engine, '-AT-', ext, '-', inter)
    ELSE concat(name, '-', fuel, '-', engine, '-AT-', ext, '-', inter, '-', yy) END AS car_string,
  shelf
FROM (SELECT p_partkey AS car_id, p_partkey % 29 AS fault, p_type AS shelf,
    upper(replace(p_brand, '#', '')) AS brand,
    concat(upper(split_part(p_name, ' ', 1)), CASE WHEN p_size % 4 = 0 THEN ' CROSS' ELSE '' END) AS model,
    concat(upper(replace(p_brand, '#', '')), '-', upper(split_part(p_name, ' ', 1)),
           CASE WHEN p_size % 4 = 0 THEN ' CROSS' ELSE '' END, '-',
           CASE WHEN p_size % 2 = 0 THEN 'LUXURY' ELSE 'Std 4x2' END) AS name,
    CASE WHEN p_size % 7 < 5 THEN 'PV' ELSE 'HEV' END AS fuel,
    CASE WHEN p_size % 3 = 0 THEN '2.5' ELSE '2.0' END AS engine,
    CASE p_partkey % 5 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'BLACK' WHEN 2 THEN 'PEARL WHITE'
      WHEN 3 THEN 'RED BODY & BLACK ROOF' ELSE 'GREY' END AS ext,
    CASE p_size % 3 WHEN 0 THEN 'BLACK' WHEN 1 THEN 'BEIGE' ELSE 'Charcoal' END AS inter,
    CASE WHEN p_size % 5 = 0 THEN '25' ELSE '26' END AS yy
  FROM {part}) x
"""
DERIVED["leaf_names"] = """
SELECT car_id, CASE car_id % 9
    WHEN 0 THEN concat(a, ' INSIDE ', b, ' 26')
    WHEN 1 THEN concat(a, ' Insid ', b, '-2026 - LVTD', CAST(100000000000 + car_id AS STRING))
    WHEN 2 THEN concat(a, '  INSIDE  ', b, ' LV', CAST(100000000000 + car_id AS STRING))
    WHEN 3 THEN concat(a, ' INSIDER ', b)
    WHEN 4 THEN concat(' -', a, '. INSIDE -', b, ' 1899')
    WHEN 5 THEN concat(a, ' INSIDE ')
    WHEN 6 THEN 'PHOTOS 2025'
    WHEN 7 THEN concat(a, ' INSIDE ', b, ' INSIDE X-25')
    ELSE concat(a, '-INSIDE-', b) END AS leaf
FROM (SELECT p_partkey AS car_id, upper(split_part(p_name, ' ', 1)) AS a, lower(p_type) AS b FROM {part}) x
"""

# --- catalogs and the texts to resolve onto them
DERIVED["catalog_options"] = """
SELECT concat('o', CAST(min(p_partkey) AS STRING)) AS id, name, min(p_partkey) AS ord, upper(concat('alias ', name)) AS alias
FROM (SELECT p_partkey,
        CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ', lower(p_type))
          WHEN 2 THEN concat('Type ', p_type, ' ', split_part(p_name, ' ', 2))
          ELSE concat(p_name, ' 2.', CAST(p_size % 3 AS STRING)) END AS name
      FROM {part}) x GROUP BY name
"""
DERIVED["catalog_values"] = """
SELECT p_partkey AS row_id,
  CASE p_partkey % 11
    WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(p_name, ' ', lower(p_type))
    WHEN 3 THEN split_part(p_name, ' ', 1) WHEN 4 THEN concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1), '.')
    WHEN 5 THEN concat('the ', p_name, ' deluxe 2.', CAST(p_size % 3 AS STRING)) WHEN 6 THEN '  '
    WHEN 7 THEN 'unknown thing' WHEN 8 THEN concat('ALIAS ', upper(p_name))
    WHEN 9 THEN concat('type ', lower(p_type)) ELSE concat(' ', p_name, '-', p_type, ' ') END AS value
FROM {part}
"""
DERIVED["taxonomy_nodes"] = """
SELECT 'brand' AS level, concat('R', CAST(r_regionkey AS STRING)) AS id, r_name AS name, concat(r_name, ' CARS') AS alias,
       CAST(NULL AS STRING) AS parent_id, CAST(r_regionkey AS BIGINT) AS ord FROM {region}
UNION ALL
SELECT 'model', concat('N', CAST(n_nationkey AS STRING)), n_name, concat('N-', CAST(n_nationkey AS STRING)),
       concat('R', CAST(n_regionkey AS STRING)), CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL
SELECT 'trim', concat('S', CAST(s_suppkey AS STRING)), s_name, concat('sup ', CAST(s_suppkey AS STRING)),
       concat('N', CAST(s_nationkey AS STRING)), s_suppkey FROM {supplier}
"""
DERIVED["taxonomy_cars"] = """
SELECT c_custkey AS car,
  CASE c_custkey % 7 WHEN 0 THEN lower(r_name) WHEN 1 THEN concat(r_name, ' cars') WHEN 2 THEN concat(r_name, ' motor co')
    WHEN 3 THEN '' WHEN 4 THEN 'nowhere' ELSE r_name END AS brand,
  CASE c_custkey % 5 WHEN 0 THEN replace(n_name, '_', ' ') WHEN 1 THEN concat(n_name, ' GT') WHEN 2 THEN 'NATION_x' ELSE n_name END AS model,
  CASE c_custkey % 3 WHEN 0 THEN concat('Supplier#', lpad(CAST(c_custkey % 100 AS STRING), 9, '0'))
    WHEN 1 THEN concat('SUP', CAST(c_custkey % 100 AS STRING)) ELSE concat('supplier ', lpad(CAST(c_custkey % 100 AS STRING), 9, '0')) END AS trim
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey
"""
DERIVED["feature_catalog"] = """
SELECT * FROM (VALUES
  (111, '360 degree camera', '360-degree-camera', 'Comfort', '4', 1), (61, '4WD', '4wd', 'Security', '3', 2),
  (77, 'ABS', 'abs', 'Security', '3', 3), (86, 'Adaptive cruise control', 'adaptive-cruise-control', 'Security', '3', 4),
  (25, 'Air conditioning', 'air-conditioning', 'Interior', '1', 5), (96, 'All wheel drive', 'all-wheel-drive', 'Security', '3', 6),
  (50, 'Auto Adjustable Headlights', 'auto-adjustable-headlights', 'Exterior', '2', 7), (156, 'Bluetooth system', 'bluetooth-system', 'Infotainment', '5', 8),
  (5, 'Fabric Seats', 'fabric-seats', 'Interior', '1', 9), (160, 'Front Speakers', 'front-speakers', 'Infotainment', '5', 10),
  (151, 'Heated Seats', 'heated-seats', 'Comfort', '4', 11), (147, 'Power Steering', 'power-steering', 'Comfort', '4', 12),
  (159, 'Rear Speakers', 'rear-speakers', 'Infotainment', '5', 13), (164, 'Touch Screen', 'touch-screen', 'Infotainment', '5', 14),
  (153, 'USB & Auxiliary Cable', 'usb-&-auxiliary-cable', 'Infotainment', '5', 15), (51, 'Parking sensor rear', 'parking-sensor-rear', 'Comfort', '4', 16),
  (52, 'Vehicle Stability Control', 'vsc', 'Security', '3', 17), (53, 'Tyre pressure warning system', 'tpws', 'Comfort', '4', 18)
) AS t(id_n, name, slug, parent, parent_id, ord)
"""
DERIVED["feature_labels"] = """
SELECT l_orderkey AS car, ((l_partkey * 1000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS ord,
  CASE (l_partkey + l_suppkey) % 23
    WHEN 0 THEN '360 Degree Camera' WHEN 1 THEN 'heated-seats' WHEN 2 THEN 'ABS' WHEN 3 THEN 'Bluetooth phone' WHEN 4 THEN 'speakers'
    WHEN 5 THEN 'Rear speakers (premium)' WHEN 6 THEN 'fabric seats, heated seats' WHEN 7 THEN '' WHEN 8 THEN 'Ambient lighting'
    WHEN 9 THEN 'air conditioning' WHEN 10 THEN 'AC' WHEN 11 THEN 'Adjustable headlights' WHEN 12 THEN 'TPMS fitted'
    WHEN 13 THEN 'One-Key Start system' WHEN 14 THEN 'rear parking radar' WHEN 15 THEN 'AWD' WHEN 16 THEN 'USB'
    WHEN 17 THEN 'Heating of the seats' WHEN 18 THEN 'Cruise controls' WHEN 19 THEN 'esp' WHEN 20 THEN 'Touch screens'
    ELSE concat(lower(l_returnflag), ' gadget ', CAST(l_suppkey % 50 AS STRING)) END AS label
FROM {lineitem}
"""
DERIVED["spec_parents"] = """
SELECT * FROM (VALUES ('Body Type', 1, 1), ('Color', 0, 2), ('Cylinders', 0, 3), ('Doors', 0, 4), ('Drive Type', 0, 5), ('Fuel Type', 1, 6),
  ('Interior Color', 0, 7), ('Regional Specification', 0, 8), ('Seats', 0, 9), ('Steering Side', 0, 10), ('Transmission', 0, 11), ('Wheel Size', 0, 12),
  ('Boot Lid', 0, 13)) AS t(name, mandatory, ord)
"""
DERIVED["spec_catalog"] = """
SELECT * FROM (VALUES
  ('Body Type', 51, 'SUV', 'suv', 1), ('Body Type', 55, 'Pickup Truck', 'pickup-truck', 2), ('Body Type', 56, 'Van', 'van', 3),
  ('Color', 14, 'Black', 'black', 4), ('Color', 20, 'Grey', 'grey', 5), ('Color', 17, 'Red', 'red', 6), ('Color', 13, 'White', 'white', 7),
  ('Interior Color', 28, 'Beige', 'beige', 8), ('Interior Color', 29, 'Black', 'black', 9), ('Interior Color', 37, 'Green', 'charcoal', 10),
  ('Cylinders', 83, '4 Cylinders', '4-cylinders', 11), ('Cylinders', 89, 'None - Electric', '16-cylinders', 12),
  ('Doors', 71, '4 Doors', '4-doors', 13), ('Doors', 73, '6+ Doors', '6+-doors', 14),
  ('Drive Type', 92, 'All-Wheel Drive (AWD)', 'all-wheel-drive-(awd)', 15), ('Drive Type', 93, 'Four-Wheel Drive (4WD)', 'four-wheel-drive-(4wd)', 16),
  ('Fuel Type', 75, 'Diesel', 'diesel', 17), ('Fuel Type', 74, 'Petrol', 'petrol', 18), ('Fuel Type', 77, 'Hybrid', 'hybrid', 19),
  ('Fuel Type', 78, 'Plug-in Hybrid', 'cng', 20), ('Regional Specification', 1, 'GCC', 'gcc', 21), ('Regional Specification', 2, 'EU', 'eu', 22),
  ('Seats', 60, '4-Seater', '4-seater', 23), ('Seats', 61, '5-Seater', '5-seater', 24), ('Seats', 68, '13-Seater', '15-seater', 25),
  ('Steering Side', 11, 'Left-hand drive', 'left-hand-drive', 26), ('Steering Side', 12, 'Right-hand drive', 'right-hand-drive', 27),
  ('Transmission', 95, 'Automatic', 'automatic', 28), ('Transmission', 97, 'CVT', 'cvt-(continuously-variable-transmission)', 29),
  ('Transmission', 94, 'Manual', 'manual', 30), ('Transmission', 96, 'Semi-Automatic', 'semi-automatic', 31),
  ('Wheel Size', 43, '18 inches', '18-inches', 32), ('Wheel Size', 45, '20 inches', '20-inches', 33)
) AS t(parent, id_n, name, slug, ord)
"""
DERIVED["spec_rows"] = """
SELECT l_orderkey AS car, ((l_partkey * 1000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS ord,
  CASE (l_suppkey + l_partkey % 3) % 19 WHEN 0 THEN 'Transmission' WHEN 1 THEN 'Gear-box  type' WHEN 2 THEN 'Fuel Type' WHEN 3 THEN 'No. of Seats'
    WHEN 4 THEN 'Exterior Colour' WHEN 5 THEN 'interior colour finish' WHEN 6 THEN 'Body Style' WHEN 7 THEN 'Wheel size (front)'
    WHEN 8 THEN 'STEERING POSITION' WHEN 9 THEN 'Regional Specs' WHEN 10 THEN 'Doors' WHEN 11 THEN 'Top speed' WHEN 12 THEN 'Type of Drive'
    WHEN 13 THEN 'Number of cylinders' WHEN 14 THEN 'Lid, boot' WHEN 15 THEN ' ' WHEN 16 THEN 'Interior Color' WHEN 17 THEN 'boot size' ELSE 'Kerb weight' END AS label,
  CASE l_partkey % 17 WHEN 0 THEN 'Automatic' WHEN 1 THEN ' automatic ' WHEN 2 THEN '5' WHEN 3 THEN 'White' WHEN 4 THEN 'CVT gearbox' WHEN 5 THEN 'Petrol'
    WHEN 6 THEN 'Charcoal' WHEN 7 THEN 'AWD' WHEN 8 THEN '18 inches alloy' WHEN 9 THEN 'Sport SUV' WHEN 10 THEN 'left hand' WHEN 11 THEN 'US' WHEN 12 THEN 'Grey'
    WHEN 13 THEN '4 Cylinders 16V' WHEN 14 THEN '' WHEN 15 THEN 'drive wheel' ELSE 'Plug-in petrol hybrid' END AS value
FROM {lineitem}
"""
DERIVED["spec_fallbacks"] = """
SELECT o_orderkey AS car, 1 AS stage, CAST(0 AS BIGINT) AS ord, 'Color' AS parent,
  CASE o_custkey % 5 WHEN 0 THEN 'WHITE BODY & BLACK ROOF' WHEN 1 THEN 'grey' WHEN 2 THEN '' WHEN 3 THEN 'pearl white' ELSE 'Sonic quartz' END AS value FROM {orders}
UNION ALL SELECT o_orderkey, 1, CAST(1 AS BIGINT), 'Interior Color', CASE o_custkey % 3 WHEN 0 THEN 'CHARCOAL' WHEN 1 THEN 'tan' ELSE 'dark beige' END FROM {orders}
UNION ALL SELECT o_orderkey, 2, CAST(0 AS BIGINT), 'Body Type', CASE o_custkey % 4 WHEN 0 THEN 'stock' WHEN 1 THEN 'SUV' WHEN 2 THEN 'Pickup' ELSE 'lot' END FROM {orders}
UNION ALL SELECT o_orderkey, 2, CAST(1 AS BIGINT), 'Body Type', CASE o_custkey % 6 WHEN 0 THEN 'van' WHEN 1 THEN 'old' ELSE 'suv' END FROM {orders}
"""

# --- photo library: one file per order line, filed under the part's car folder
DERIVED["library_entries"] = """
SELECT path, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '/([^/]*)$', 1) ELSE path END AS name,
       CAST(0 = 1 AS BOOLEAN) AS is_dir, size, mtime_ns
FROM (SELECT CASE f
    WHEN 0 THEN concat(folder, '/', variant, '/Thumbs.db') WHEN 1 THEN concat(folder, '/', variant, '/', sheet, '.pdf')
    WHEN 2 THEN concat(folder, '/', variant, '/', sheet, ' No Logo.PDF') WHEN 3 THEN concat(folder, '/', variant, '/notes', CAST(l_suppkey % 5 AS STRING), '.txt')
    WHEN 4 THEN concat(folder, '/readme', CAST(l_suppkey % 3 AS STRING), '.md') WHEN 5 THEN concat(folder, '/', variant, '/RAW/IMG_', CAST(l_orderkey AS STRING), '.JPG')
    WHEN 6 THEN concat(lower(shelf), ' docs/', CAST(l_suppkey % 20 AS STRING), '/list', CAST(l_linenumber AS STRING), '.xlsx')
    WHEN 7 THEN concat(folder, '/', variant, '/.hidden') WHEN 8 THEN concat(shelf, '/todo.txt')
    ELSE concat(folder, '/', variant, '/IMG_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), CASE WHEN l_linenumber % 3 = 0 THEN '.HEIC' ELSE '.jpg' END) END AS path,
    max(l_partkey) + 1000 AS size, max(l_suppkey) * 1000000007 AS mtime_ns
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (l_orderkey + l_suppkey) % 23 AS f, p_type AS shelf,
      concat(p_type, CASE WHEN p_size % 5 = 0 THEN '/SUV' WHEN p_size % 11 = 0 THEN concat('/', upper(replace(p_brand, '#', '')), '-ALL-CARS-PV-2.0-AT') ELSE '' END, '/',
             upper(replace(p_brand, '#', '')), '-', upper(split_part(p_name, ' ', 1)), CASE WHEN p_size % 4 = 0 THEN ' CROSS' ELSE '' END, '-',
             CASE WHEN p_size % 2 = 0 THEN 'LUXURY' ELSE 'STD 4X2' END, '-', CASE WHEN p_size % 7 < 5 THEN 'PV' ELSE 'HEV' END, '-',
             CASE WHEN p_size % 3 = 0 THEN '2.50' ELSE '2.0' END, CASE WHEN p_size % 13 = 0 THEN '-MT' ELSE '-AT' END,
             CASE p_partkey % 4 WHEN 0 THEN '-25' WHEN 1 THEN '-2026' WHEN 2 THEN '' ELSE '-WHITE-BLACK-26' END) AS folder,
      CASE WHEN p_size % 9 = 0 THEN 'PHOTOS' ELSE concat(
             CASE (p_partkey + l_suppkey) % 5 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'BLACK' WHEN 2 THEN 'PEARL WHITE' WHEN 3 THEN 'RED BODY & BLACK ROOF' ELSE 'GREY' END,
             ' INSIDE ', CASE (p_size + l_suppkey) % 3 WHEN 0 THEN 'BLACK' WHEN 1 THEN 'BEIGE' ELSE 'CHARCOAL' END,
             CASE WHEN l_suppkey % 4 = 0 THEN ' 26' WHEN l_suppkey % 10 = 1 THEN '-LVTDB12345678901' ELSE '' END) END AS variant,
      concat(upper(replace(p_brand, '#', '')), ' ', upper(split_part(p_name, ' ', 1)), CASE WHEN p_size % 4 = 0 THEN ' CROSS' ELSE '' END, ' ',
             CASE WHEN p_partkey % 3 = 0 THEN 'LUXURY' ELSE 'STD 4X2' END) AS sheet
    FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) x
  GROUP BY 1) y
"""

# --- evidence from several sources
DERIVED["identity_code"] = """
SELECT o_orderkey AS car, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS brand,
  CASE o_custkey % 3 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN concat(' ', c_mktsegment, ' ') ELSE '' END AS model,
  o_orderstatus AS trim, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 2000 + CAST(o_custkey % 30 AS INT) END AS year
FROM {orders} JOIN {customer} ON c_custkey = o_custkey
"""
DERIVED["identity_sheet"] = """
SELECT o_orderkey AS car, CASE o_custkey % 4 WHEN 0 THEN lower(replace(o_orderpriority, '-', ' ')) WHEN 1 THEN 'other' ELSE NULL END AS brand,
  CASE WHEN o_custkey % 11 = 0 THEN 'none' ELSE lower(c_mktsegment) END AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS trim,
  2000 + CAST(o_orderkey % 30 AS INT) AS year
FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW'
"""
DERIVED["provider_answers"] = """
SELECT l_orderkey AS car, l_returnflag AS provider, CASE l_linenumber % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'important' ELSE 'other' END AS kind,
  CASE (l_partkey + l_suppkey) % 23 WHEN 0 THEN '360 degree camera' WHEN 1 THEN ' HEATED seats ' WHEN 2 THEN 'ABS' WHEN 3 THEN 'Ambient lighting' WHEN 4 THEN 'touch screen'
    WHEN 5 THEN 'made up' ELSE concat(lower(l_returnflag), ' gadget ', CAST(l_suppkey % 50 AS STRING)) END AS label,
  ((l_partkey * 1000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS ord
FROM {lineitem}
"""
DERIVED["field_answers"] = """
SELECT l_orderkey AS car, l_returnflag AS provider,
  CASE l_linenumber % 5 WHEN 0 THEN 'color' WHEN 1 THEN 'fuel' WHEN 2 THEN 'doors' WHEN 3 THEN 'horsepower' ELSE 'bogus' END AS field,
  CASE l_partkey % 9 WHEN 0 THEN 'White' WHEN 1 THEN ' white ' WHEN 2 THEN 'PETROL' WHEN 3 THEN '' WHEN 4 THEN '4' WHEN 5 THEN 'Diesel' WHEN 6 THEN NULL WHEN 7 THEN ' 4' ELSE concat(CAST(l_suppkey AS STRING), ' hp') END AS value,
  ((l_partkey * 1000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS ord
FROM {lineitem}
"""
DERIVED["answer_cache"] = """
SELECT CASE WHEN event_type IN ('view', 'click') THEN 'Color' ELSE 'Interior Color' END AS parent,
  upper(CASE user_id % 6 WHEN 0 THEN concat('shade ', CAST(user_id AS STRING)) WHEN 1 THEN 'Sonic quartz' WHEN 2 THEN 'pearl' WHEN 3 THEN concat('tone ', CAST(event_id % 50 AS STRING)) ELSE concat('shade ', CAST(event_id % 100 AS STRING)) END) AS raw_key,
  CASE user_id % 6 WHEN 0 THEN concat('shade ', CAST(user_id AS STRING)) WHEN 1 THEN 'Sonic quartz' WHEN 2 THEN 'pearl' WHEN 3 THEN concat('tone ', CAST(event_id % 50 AS STRING)) ELSE concat('shade ', CAST(event_id % 100 AS STRING)) END AS raw_value,
  CASE WHEN event_id % 3 = 0 THEN 'missing' ELSE 'matched' END AS status,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Black' ELSE 'Gone' END AS name, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '14' ELSE '99' END AS id,
  event_id AS resolved_at, concat('m', CAST(event_id % 7 AS STRING)) AS method
FROM {events}
"""
DERIVED["colour_cars"] = """
SELECT l_orderkey * 10 + l_linenumber AS car_no, l_partkey AS pk, l_suppkey AS sk,
  CASE l_suppkey % 8 WHEN 0 THEN 'WHITE BODY & BLACK ROOF' WHEN 1 THEN concat('shade ', CAST(l_partkey % 100 AS STRING)) WHEN 2 THEN 'Sonic quartz' WHEN 3 THEN ' '
    WHEN 4 THEN 'grey' WHEN 5 THEN concat('tone ', CAST(l_partkey % 60 AS STRING)) WHEN 6 THEN 'Black / tone 3' ELSE 'Charcoal' END AS colour,
  CASE WHEN l_linestatus = 'F' THEN 'Color' ELSE 'Interior Color' END AS parent
FROM {lineitem}
"""
DERIVED["colour_answers"] = """
SELECT parent, upper(value) AS raw_key, CASE n % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'NO_MATCH' WHEN 2 THEN 'Mauve' ELSE 'Black' END AS choice
FROM (SELECT 'Color' AS parent, concat('shade ', CAST(p_partkey % 100 AS STRING)) AS value, p_partkey % 100 AS n FROM {part}
      UNION ALL SELECT 'Interior Color', concat('shade ', CAST(p_partkey % 100 AS STRING)), p_partkey % 100 + 1 FROM {part}
      UNION ALL SELECT 'Color', concat('tone ', CAST(p_partkey % 55 AS STRING)), p_partkey % 55 FROM {part}) x
GROUP BY parent, value, n
"""

# --- model replies and attempts
DERIVED["sheet_replies"] = """
SELECT event_id, concat('car', CAST(user_id AS STRING)) AS car, concat('sheet', CAST(event_id % 6 AS STRING), '.pdf') AS pdf, event_id % 6 AS pdf_ord,
  event_id AS attempt, concat('SHEET', CAST(user_id % 6 AS STRING)) AS search_key,
  CASE WHEN event_type = 'signup' THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN event_id % 9 = 0 THEN '  ' WHEN event_type = 'error' THEN concat('sorry, no data for ', CAST(user_id AS STRING))
    ELSE concat(CASE WHEN event_id % 4 = 0 THEN concat('```json', chr(10)) ELSE '' END,
      CASE WHEN event_type = 'signup' THEN substring(body, 1, CAST(40 + event_id % 190 AS INT)) ELSE body END,
      CASE WHEN event_id % 4 = 0 THEN concat(chr(10), '```') ELSE '' END) END AS content
FROM (SELECT event_id, user_id, event_type,
    replace(replace(concat('<"brand": "b', CAST(user_id % 9 AS STRING), '", "model": "say, [x]", ', CASE WHEN event_id % 5 = 0 THEN '' ELSE '"trim": null, ' END, '"year": 2025, "raw_specifications": ',
      CASE WHEN event_id % 7 = 0 THEN '[]' WHEN event_id % 11 = 0 THEN '"none"' ELSE concat('[<"label": "k", "value": "', CAST(event_id AS STRING), '">, <"label": "Seats", "value": "5">]') END,
      ', "description": "long, <text>", "raw_features": ', CASE WHEN event_id % 13 = 0 THEN '<"a": 1>' ELSE '["ABS", "TPMS"]' END, '>'), '<', chr(123)), '>', chr(125)) AS body
  FROM {events}) x
"""
# Every third event is an upload of a sheet; its replies are that event's and the next two.
DERIVED["uploads"] = """
SELECT CAST(floor(event_id / 3) AS BIGINT) AS upload,
  concat('mdl-', CAST(user_id AS STRING), 'A', CAST(event_id % 13 AS STRING), '-', CAST(20 + user_id % 7 AS STRING)) AS model_number,
  CASE WHEN event_id % 2 = 0 THEN car_string WHEN event_id % 5 = 0 THEN '' END AS product_description,
  CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS DOUBLE) END AS price_aed
FROM {events} LEFT JOIN {car_strings} ON car_id = CAST(floor(event_id / 3) AS BIGINT) WHERE event_id % 3 = 0
"""
# Catalog rows in payloads of at most 200.
DERIVED["payload_rows"] = """
SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS payload_id, p_partkey, concat('v', CAST(p_partkey AS STRING)) AS id, p_name AS name,
  p_brand AS parent, CASE p_size % 4 WHEN 0 THEN 'Draft' WHEN 1 THEN NULL WHEN 2 THEN 'PUBLISHED' ELSE 'published' END AS status
FROM {part}
"""
DERIVED["payload_groups"] = """
SELECT payload_id, concat('g', CAST(min(p_partkey) AS STRING)) AS id, parent AS name, min(p_partkey) % 2 = 0 AS mandatory
FROM {payload_rows} GROUP BY payload_id, parent HAVING min(p_partkey) % 7 <> 0
"""
