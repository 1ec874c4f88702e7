"""Registered queries over the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotledger.functions import carkey, leaf, modelcode
from lotledger.functions import text as tx
from lotledger.plans import parse_sql as ps
from lotledger.plans.derive import table, with_clause

_FLAT = (
    "raw", "designation", "desig_fp", "name_state", "brand", "model_head", "trim", "fuel_state", "fuel",
    "engine_state", "engine_l", "transmission_state", "transmission", "model_year", "exterior_state",
    "exterior", "interior_state", "interior", "vin_tag", "variant_suffix", "n_notes", "ok", "brand_key",
)


def flatten_car(df, key):
    car = F.col("car")
    return df.select(
        key,
        car.raw.alias("raw"),
        car.designation.raw.alias("designation"),
        car.designation.fingerprint.alias("desig_fp"),
        car.brand.state.alias("name_state"),
        *[car[f].value.alias(f) for f in ("brand", "model_head", "trim")],
        *[c for f in ("fuel", "transmission", "exterior", "interior")
          for c in (car[f].state.alias(f + "_state"), car[f].value.alias(f))],
        car.engine_l.state.alias("engine_state"),
        car.engine_l.value.cast("double").alias("engine_l"),
        car.model_year.value.alias("model_year"),
        car.vin_tag.value.alias("vin_tag"),
        car.variant_suffix.value.alias("variant_suffix"),
        F.size(car.unresolved).alias("n_notes"),
        car.ok.alias("ok"),
        carkey.brand_key(car).alias("brand_key"),
    ).select(key, *_FLAT)


def parse_car_string(spark, sf):
    cars = table(spark, sf, "car_strings")
    return flatten_car(carkey.parse_car_strings(cars, "car_string"), "car_id")


def parse_folder_name(spark, sf):
    cars = carkey.parse_model_folders(table(spark, sf, "car_strings"), "car_string")
    car = F.col("car")
    return cars.select(
        "car_id",
        car.designation.fingerprint.alias("desig_fp"),
        car.exterior.state.alias("exterior_state"),
        car.interior.state.alias("interior_state"),
        F.size(car.unresolved).alias("n_notes"),
        carkey.parses_as_car(car).alias("is_car"),
    )


def parse_model_code(spark, sf):
    parsed = modelcode.parse_model_codes(table(spark, sf, "car_strings"), "car_string")
    fields = ("brand", "model", "trim", "fuel_type", "engine_size", "transmission", "exterior_color", "interior_color", "year")
    return parsed.select(
        "car_id", F.col("code_parse").isNotNull().alias("parsed"), *[F.col(f"code_parse.{f}").alias(f) for f in fields]
    )


def parse_description(spark, sf):
    """Grammar reading, replaced by a model's answer where one came back."""
    cars = table(spark, sf, "car_strings")
    reply = F.struct(
        F.lit("Answered").alias("brand"), F.lit("  ").alias("model"),
        *[F.lit(None).cast("int" if f == "year" else "string").alias(f) for f in modelcode.DESCRIPTION_FIELDS[2:]],
    )
    cars = cars.withColumn("reply", F.when(F.col("shelf") == "PROMO", reply))
    parsed = modelcode.parse_descriptions(cars, "car_string", "reply")
    return parsed.select("car_id", "fields.brand", "fields.model", "fields.trim", "fields.year", "fields.fuel_type",
                         F.col("fields._source").alias("source"))


def leaf_colours(spark, sf):
    df = leaf.parse_folder_colours(leaf.parse_leaves(table(spark, sf, "leaf_names"), "leaf", "l"), "leaf", "f")
    return df.select(
        "car_id", "l.vin_tag", "l.exterior", "l.interior",
        F.col("f.exterior").alias("loose_exterior"), F.col("f.interior").alias("loose_interior"),
    )


def document_keys(spark, sf):
    """Cleaning, keys, tokens and small readings over whole document texts."""
    t = F.col("text")
    docs = table(spark, sf, "documents").withColumn("folded", t)
    docs = tx.fold_nfkc(docs, "folded")
    folded = F.col("folded")
    return docs.select(
        "doc_id",
        F.length(tx.clean(folded)).alias("n_clean"),
        F.md5(tx.fingerprint(t)).alias("fingerprint_md5"),
        F.size(tx.word_tokens(t)).alias("n_word_tokens"),
        F.size(tx.token_set(t)).alias("n_token_set"),
        tx.first_int(t).alias("first_int"),
        F.md5(tx.match_key(t)).alias("match_key_md5"),
    )


def unit_conversions(spark, sf):
    """Engine sizes and powers converted, option lists cleaned."""
    p = table(spark, sf, "part")
    listed = F.array(F.col("p_brand"), F.concat(F.lit(" "), F.col("p_type")), F.lit("  "), F.col("p_brand"), F.col("p_name"))
    return p.select(
        "p_partkey", tx.litres_from_cc(F.col("p_size") * 37).alias("litres"), tx.horsepower_from_kw(F.col("p_size")).alias("horsepower"),
        F.array_join(tx.distinct_options(listed), "|").alias("options"),
    )


QUERIES = {
    f.__name__: f
    for f in (parse_car_string, parse_folder_name, parse_model_code, parse_description, leaf_colours, document_keys, unit_conversions)
}

_CARS = f"WITH {with_clause('car_strings')}"

ORACLES = {
    "unit_conversions": """SELECT p_partkey, round(p_size * 37 / 1000.0::DOUBLE, 1) AS litres, CAST(round(p_size * 1.341::DOUBLE, 0) AS INT) AS horsepower,
      CASE WHEN trim(p_type) IN (p_brand, p_name) OR p_brand = p_name THEN NULL ELSE concat(p_brand, '|', trim(p_type), '|', p_name) END AS options FROM part""",
    "parse_car_string": f"""{_CARS}, {ps.car_ctes('car_strings', 'car_id', 'car_string', 'cars')}
      SELECT * EXCLUDE (year_raw, engine_raw) REPLACE (CAST(engine_l AS DOUBLE) AS engine_l) FROM cars""",
    "parse_folder_name": f"""{_CARS}, {ps.car_ctes('car_strings', 'car_id', 'car_string', 'cars')}
      SELECT car_id, desig_fp, 'silent' AS exterior_state, 'silent' AS interior_state,
             n_notes + CAST(exterior_state <> 'silent' OR interior_state <> 'silent' AS INT) AS n_notes, ok AS is_car FROM cars""",
    "parse_model_code": f"""{_CARS}, {ps.code_ctes('car_strings', 'car_id', 'car_string', 'codes')} SELECT * FROM codes""",
    "parse_description": f"""{_CARS}, {ps.code_ctes('car_strings', 'car_id', 'car_string', 'codes')}
      SELECT c.car_id, CASE WHEN blank THEN NULL WHEN ai THEN 'Answered' ELSE nullif(k.brand, '') END AS brand,
             CASE WHEN NOT blank AND NOT ai THEN nullif(k.model, '') END AS model,
             CASE WHEN NOT blank AND NOT ai THEN nullif(k.trim, '') END AS trim,
             CASE WHEN NOT blank AND NOT ai THEN k.year END AS year,
             CASE WHEN NOT blank AND NOT ai THEN k.fuel_type END AS fuel_type,
             CASE WHEN blank THEN 'empty' WHEN ai THEN 'ai' ELSE 'regex' END AS source
      FROM (SELECT *, trim(car_string) = '' AS blank, shelf = 'PROMO' AS ai FROM car_strings) c JOIN codes k ON k.car_id = c.car_id""",
    "leaf_colours": f"""WITH {with_clause('leaf_names')}, {ps.leaf_ctes('leaf_names', 'car_id', 'leaf', 'leaves')}
      SELECT * FROM leaves""",
    "document_keys": f"""SELECT doc_id, length({ps.clean('text')}) AS n_clean, md5({ps.fp('text')}) AS fingerprint_md5,
        len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS n_word_tokens,
        len(list_distinct(list_filter(regexp_split_to_array(
          regexp_replace(regexp_replace(regexp_replace(lower(text), '([0-9])\\.', '\\1ȹȹ', 'g'), '\\.([0-9])', 'ȹȹ\\1', 'g'),
            '[^\\pL\\pN\\pM_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''))) AS n_token_set,
        regexp_replace(nullif(regexp_extract(text, '([0-9]+)', 1), ''), '^0+([0-9])', '\\1') AS first_int,
        md5(upper(replace({ps.clean('text')}, 'ß', 'SS'))) AS match_key_md5
      FROM documents""",
}
