"""The older, stricter model-code grammar and the description fields built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx

# Token to word maps and brands that may stand alone in a two-part name.
FUEL_WORDS = {
    "PV": "Petrol", "PHEV": "Hybrid", "HEV": "Hybrid", "MHEV": "Hybrid",
    "EV": "Electric", "DV": "Diesel", "PETROL": "Petrol", "DIESEL": "Diesel",
    "ELECTRIC": "Electric", "HYBRID": "Hybrid", "HYBRID_ELECTRIC": "Hybrid",
    "PLUG_IN_HYBRID_ELECTRIC": "Hybrid",
}
TRANSMISSION_WORDS = {
    "AT": "Automatic", "MT": "Manual", "CVT": "CVT", "IVT": "IVT",
    "AUTOMATIC": "Automatic", "MANUAL": "Manual", "MANNULAL": "Manual",
}
STANDALONE_BRANDS = (
    "TOYOTA", "LEXUS", "KIA", "MG", "NISSAN", "HONDA", "ROX", "GAC", "BYD",
    "GREATWALL", "GWM", "SUZUKI", "CHANGAN", "BAW", "DONGFENG", "BMW",
    "HYUNDAI", "MITSUBISHI", "FORD", "CHEVROLET", "JEEP", "MERCEDES",
    "AUDI", "VOLKSWAGEN", "PORSCHE", "JAGUAR", "LANDROVER", "LAND ROVER",
    "PEUGEOT", "RENAULT", "GEELY", "HAVAL", "JAC", "CHERY", "MAXUS",
    "FOTON", "ISUZU", "MAZDA", "SUBARU", "VOLVO", "JETOUR", "TANK",
)

DESCRIPTION_FIELDS = (
    "brand", "model", "trim", "year", "exterior_color", "interior_color",
    "fuel_type", "engine_size", "transmission",
)


def _word(key: Column, words: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    by_word: dict[str, list[str]] = {}
    for token, word in words.items():
        by_word.setdefault(word, []).append(token)
    for word, tokens in by_word.items():
        out = F.when(key.isin(*tokens), F.lit(word)).otherwise(out)
    return out


def _code_year(token: Column) -> Column:
    raw = tx.strip(token)
    return F.when(raw.rlike(r"^\d{2}$"), raw.try_cast("int") + 2000).when(
        raw.rlike(r"^20\d{2}$"), raw.try_cast("int")
    )


def parse_model_codes(df: DataFrame, source: str, into: str = "code_parse") -> DataFrame:
    """Add ``into``: a struct, null where the code does not fit the grammar."""
    p = "__code_"
    c = lambda name: F.col(p + name)
    keep = df.columns
    df = df.withColumn(p + "stem", tx.strip(F.col(source)))
    df = df.withColumn(p + "seg", F.split(c("stem"), "-"))
    df = df.withColumn(p + "up", F.transform(c("seg"), lambda s: F.upper(tx.strip(s))))
    df = df.withColumn(
        p + "cls",
        F.array_join(
            F.transform(
                c("up"),
                lambda s: F.when(s.isin(*FUEL_WORDS), F.lit("F"))
                .when(s.isin(*TRANSMISSION_WORDS), F.lit("T"))
                .otherwise("x"),
            ),
            "",
        ),
    )
    # Exactly one segment between the first fuel token and the transmission run.
    shape = "^([^F]*)F[^T](T+)"
    df = df.withColumns(
        {
            p + "lead": F.length(F.regexp_extract(c("cls"), shape, 1)),
            p + "run": F.length(F.regexp_extract(c("cls"), shape, 2)),
            p + "fits": c("cls").rlike(shape) & (F.size(c("seg")) >= 5),
        }
    )
    after = c("lead") + c("run") + 3
    df = df.withColumns(
        {
            p + "before": F.slice(c("seg"), F.lit(1), c("lead")),
            p + "after": F.slice(c("seg"), after, F.greatest(F.size(c("seg")) - after + 1, F.lit(0))),
            p + "engine": F.replace(tx.strip(F.get(c("seg"), c("lead") + 1)), F.lit("_"), F.lit(".")),
        }
    )
    df = df.withColumns(
        {
            p + "y_head": _code_year(F.get(c("before"), F.lit(0))),
            p + "y_tail": _code_year(F.get(c("after"), F.size(c("after")) - 1)),
        }
    )
    cut_head, cut_tail = c("y_head").isNotNull(), c("y_head").isNull() & c("y_tail").isNotNull()
    df = df.withColumns(
        {
            p + "before": F.when(
                cut_head, F.slice(c("before"), F.lit(2), F.greatest(F.size(c("before")) - 1, F.lit(0)))
            ).otherwise(c("before")),
            p + "after": F.when(
                cut_tail, F.slice(c("after"), F.lit(1), F.greatest(F.size(c("after")) - 1, F.lit(0)))
            ).otherwise(c("after")),
        }
    )
    n = F.size(c("before"))
    b0, b1 = F.get(c("before"), F.lit(0)), F.get(c("before"), F.lit(1))
    lone_brand = F.upper(tx.strip(b0)).isin(*STANDALONE_BRANDS)
    rest = F.array_join(F.slice(c("before"), F.lit(3), F.greatest(n - 2, F.lit(0))), " ")
    brand = F.when(n >= 3, b0).when((n == 2) & lone_brand, b0).otherwise("")
    model = F.when(n >= 3, b1).when((n == 2) & lone_brand, b1).otherwise(b0)
    trim = F.when(n >= 3, rest).when((n == 2) & ~lone_brand, b1).otherwise("")
    fits = c("fits") & (n > 0) & ((c("engine") == "") | c("engine").rlike(r"^\d+(\.\d+)?$"))
    parsed = F.struct(
        c("stem").alias("stock_id"),
        tx.title(tx.strip(brand)).alias("brand"),
        tx.title(tx.strip(model)).alias("model"),
        tx.title(tx.strip(trim)).alias("trim"),
        _word(F.get(c("up"), c("lead")), FUEL_WORDS).alias("fuel_type"),
        F.nullif(c("engine"), F.lit("")).alias("engine_size"),
        _word(F.get(c("up"), c("lead") + 2), TRANSMISSION_WORDS).alias("transmission"),
        F.when(F.size(c("after")) >= 1, tx.strip(F.get(c("after"), F.lit(0)))).alias("exterior_color"),
        F.when(F.size(c("after")) >= 2, tx.strip(F.get(c("after"), F.lit(1)))).alias("interior_color"),
        F.coalesce(c("y_head"), c("y_tail")).alias("year"),
    )
    return df.select(*keep, tx.sealed(F.when(fits, parsed)).alias(into))


def parse_descriptions(
    df: DataFrame, source: str, reply: str | None = None, into: str = "fields"
) -> DataFrame:
    """Vehicle fields of a description.

    ``reply`` may name a struct column with a model's answer for the row; a
    non-null answer replaces the grammar's reading, blank strings as null.
    """
    df = parse_model_codes(df, source, "__desc")
    d = F.col("__desc")
    empty = tx.strip(F.col(source)) == ""
    answered = F.lit(False) if reply is None else F.col(reply).isNotNull()

    def value(name: str) -> Column:
        parsed = d[name]
        if name in ("brand", "model", "trim"):
            parsed = F.nullif(parsed, F.lit(""))
        if reply is None:
            return parsed
        given = F.col(reply)[name]
        if name != "year":
            given = F.when(tx.strip(given) != "", given)
        return F.when(answered, given).otherwise(parsed)

    fields = F.struct(
        *[F.when(~empty, value(n)).alias(n) for n in DESCRIPTION_FIELDS],
        F.when(empty, F.lit("empty")).when(answered, F.lit("ai")).otherwise("regex").alias("_source"),
    )
    return df.withColumn(into, fields).drop("__desc")
