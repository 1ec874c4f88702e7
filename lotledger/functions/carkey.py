"""Parsing of hyphenated car strings into typed, tri-state fields.

A field is ``struct<state, value, raw>`` with state ``stated``, ``silent`` or
``unparseable``; silence and unreadable text are different facts and SQL NULL
alone cannot carry both.

The anchor search works on a *class string*: one letter per segment, F for a
fuel token, T for a transmission token, ``x`` otherwise. One regular
expression over it yields every boundary, so the parse is a short chain of
projections without Python or loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx

GRAMMAR_VERSION = "car-string/1"
FOLDER_GRAMMAR_VERSION = "folder-name/1"

# Anchor vocabularies, as fingerprints.
FUEL_FINGERPRINTS = (
    "pv", "dv", "ev", "hev", "phev", "mhev",
    "petrol", "diesel", "electric", "hybrid", "hybridelectric", "pluginhybridelectric",
)
TRANSMISSION_FINGERPRINTS = ("at", "mt", "cvt", "ivt", "automatic", "manual", "mannulal")

ENGINE_MIN_L, ENGINE_MAX_L = "0.5", "10.0"

TEXT_FIELDS = (
    "brand", "model_head", "trim", "fuel", "transmission",
    "exterior", "interior", "vin_tag", "variant_suffix",
)
CAR_FIELDS = (
    "brand", "model_head", "trim", "fuel", "engine_l", "transmission",
    "model_year", "exterior", "interior", "vin_tag", "variant_suffix",
)

_TYPES = {"engine_l": tx.ENGINE_TYPE, "model_year": "int"}


def _field(name: str, state: Column, value: Column, raw: Column) -> Column:
    kind = _TYPES.get(name, "string")
    stated = state == "stated"
    return F.struct(
        state.alias("state"),
        F.when(stated, value).cast(kind).alias("value"),
        F.when(state != "silent", raw).alias("raw"),
    ).alias(name)


def silent_field(name: str) -> Column:
    nothing = F.lit(None).cast("string")
    return _field(name, F.lit("silent"), nothing, nothing)


def text_field(name: str, value: Column) -> Column:
    """Stated when the text is non-empty, silent otherwise."""
    state = F.when(F.coalesce(value, F.lit("")) != "", F.lit("stated")).otherwise("silent")
    return _field(name, state, value, value)


def _join_notes(*notes: Column) -> Column:
    return F.filter(F.concat(*notes), lambda n: n.isNotNull())


def _note(condition: Column, sentence: Column) -> Column:
    return F.array(F.when(condition, sentence))


def parse_car_strings(
    df: DataFrame, source: str, into: str = "car", fold: bool = True
) -> DataFrame:
    """Add ``into``: the parsed car of text column ``source``.

    ``fold=False`` skips compatibility folding for a column known to be ASCII.
    """
    p = "__car_"
    c = lambda name: F.col(p + name)
    keep = df.columns
    df = df.withColumn(p + "text", F.col(source))
    if fold:
        df = tx.fold_nfkc(df, p + "text")

    df = df.withColumn(p + "raw", tx.clean(c("text")))
    df = df.withColumn(p + "seg", F.split(c("raw"), "-"))
    df = df.withColumn(
        p + "cls",
        F.array_join(
            F.transform(
                F.transform(c("seg"), tx.fingerprint),
                lambda fp: F.when(fp.isin(*FUEL_FINGERPRINTS), F.lit("F"))
                .when(fp.isin(*TRANSMISSION_FINGERPRINTS), F.lit("T"))
                .otherwise("x"),
            ),
            "",
        ),
    )
    # Non-fuel lead, fuel run, window, transmission run.
    shape = "^([^F]*)(F+)([^T]*)(T+)"
    part = lambda i: F.length(F.regexp_extract(c("cls"), shape, i))
    df = df.withColumns(
        {
            p + "found": c("cls").rlike(shape),
            p + "fuel_pos": part(1) + part(2),
            p + "window": part(3),
            p + "t_run": part(4),
        }
    )
    trans_pos = c("fuel_pos") + c("window") + 1
    n_seg = F.size(c("seg"))
    seg_slice = lambda start, count: F.slice(
        c("seg"), F.greatest(start, F.lit(1)), F.greatest(count, F.lit(0))
    )
    blank_free = lambda a: F.filter(a, lambda s: tx.tidy(s) != "")
    tidied = lambda a: F.filter(F.transform(a, tx.tidy), lambda s: s != "")
    tail_start = trans_pos + c("t_run")
    df = df.withColumns(
        {
            p + "head": F.when(c("found"), seg_slice(F.lit(1), c("fuel_pos") - 1)),
            p + "fuel": F.when(c("found"), tx.tidy(F.get(c("seg"), c("fuel_pos") - 1))),
            p + "trans": F.when(c("found"), tx.tidy(F.get(c("seg"), trans_pos - 1))),
            p + "repeats": F.when(
                c("found"), F.transform(seg_slice(trans_pos + 1, c("t_run") - 1), tx.tidy)
            ),
            p + "engine": F.when(c("found"), tidied(seg_slice(c("fuel_pos") + 1, c("window")))),
            p + "tail": F.when(c("found"), blank_free(seg_slice(tail_start, n_seg - tail_start + 1))),
        }
    )
    df = df.withColumns(
        {
            p + "head0": tx.tidy(F.get(c("head"), F.lit(0))),
            p + "vins": F.transform(F.filter(c("tail"), tx.looks_like_vin), lambda s: F.upper(tx.tidy(s))),
            p + "rest": F.filter(c("tail"), lambda s: ~tx.looks_like_vin(s)),
        }
    )
    df = df.withColumn(p + "head_year", tx.year4(c("head0")))
    lead = r"(?s)^\s*(\d{2}|\d{4})\b(.*)$"
    n_rest = F.size(c("rest"))
    last, prev = F.get(c("rest"), n_rest - 1), F.get(c("rest"), n_rest - 2)
    df = df.withColumns(
        {
            p + "parts": tidied(
                F.when(c("head_year").isNotNull(), F.slice(c("head"), F.lit(2), F.greatest(F.size(c("head")) - 1, F.lit(0))))
                .otherwise(c("head"))
            ),
            p + "y1raw": F.regexp_extract(last, lead, 1),
            p + "y1tail": tx.tidy(F.regexp_extract(last, lead, 2)),
            p + "y2raw": F.regexp_extract(prev, lead, 1),
            p + "y2tail": tx.tidy(F.regexp_extract(prev, lead, 2)),
            p + "last": tx.tidy(last),
        }
    )
    df = df.withColumns({p + "y1": tx.year4(c("y1raw")), p + "y2": tx.year4(c("y2raw"))})
    on_last = c("y1").isNotNull()
    on_prev = ~on_last & (n_rest >= 2) & c("y2").isNotNull() & (c("y2tail") == "")
    used = F.when(on_last, F.lit(1)).when(on_prev, F.lit(2)).otherwise(0)
    df = df.withColumns(
        {
            p + "year": F.when(on_last, c("y1")).when(on_prev, c("y2")).otherwise(c("head_year")),
            p + "year_raw": F.when(on_last, c("y1raw")).when(on_prev, c("y2raw")).otherwise(c("head0")),
            p + "suffix": F.when(on_last, c("y1tail")).when(on_prev, c("last")).otherwise(F.lit("")),
            p + "colours": F.transform(
                F.slice(c("rest"), F.lit(1), F.greatest(n_rest - used, F.lit(0))), tx.tidy
            ),
            p + "name": F.coalesce(F.array_join(c("parts"), "-"), F.lit("")),
            p + "window_text": F.array_join(c("engine"), "-"),
            p + "engine_raw": F.get(c("engine"), F.lit(0)),
        }
    )
    df = df.withColumns(
        {
            p + "colours": F.filter(c("colours"), lambda s: s != ""),
            p + "litres": tx.engine_litres(F.replace(c("engine_raw"), F.lit("_"), F.lit("."))),
        }
    )

    found, raw = c("found"), c("raw")
    n_parts, n_engine, n_colours = F.size(c("parts")), F.size(c("engine")), F.size(c("colours"))
    lost = F.when(raw != "", F.lit("unparseable")).otherwise("silent")
    named = F.when(n_parts >= 3, F.lit("stated")).when(n_parts == 0, F.lit("silent")).otherwise("unparseable")
    in_range = c("litres").between(F.lit(ENGINE_MIN_L).cast(tx.ENGINE_TYPE), F.lit(ENGINE_MAX_L).cast(tx.ENGINE_TYPE))

    def named_field(name: str, value: Column) -> Column:
        return _field(
            name,
            F.when(found, named).otherwise(lost),
            value,
            F.when(found & (named == "stated"), value).when(found, c("name")).otherwise(raw),
        )

    def anchor_field(name: str, value: Column) -> Column:
        state = F.when(~found, lost).when(value != "", F.lit("stated")).otherwise("silent")
        return _field(name, state, value, F.when(found, value).otherwise(raw))

    engine_state = (
        F.when(~found, lost)
        .when(n_engine == 0, F.lit("silent"))
        .when((n_engine == 1) & F.coalesce(in_range, F.lit(False)), F.lit("stated"))
        .otherwise("unparseable")
    )
    colour_text = F.array_join(c("colours"), "-")

    def colour_field(name: str, at: int) -> Column:
        value = F.get(c("colours"), F.lit(at))
        state = (
            F.when(~found, F.lit("silent"))
            .when(n_colours >= 3, F.lit("unparseable"))
            .when(value.isNotNull(), F.lit("stated"))
            .otherwise("silent")
        )
        return _field(name, state, value, F.when(n_colours >= 3, colour_text).otherwise(value))

    year_state = F.when(found & c("year").isNotNull(), F.lit("stated")).otherwise("silent")
    q = tx.quoted
    unanchored = F.array(
        F.when(raw == "", F.lit("empty string states nothing")).otherwise(
            F.concat(q(raw), F.lit(" states no fuel token followed by a transmission token, so no field can be placed"))
        )
    )
    notes = _join_notes(
        _note(
            (n_parts > 0) & (n_parts < 3),
            F.concat(F.lit("name "), q(c("name")), F.lit(" does not split into brand, model and trim; a brand alias would settle it")),
        ),
        F.transform(
            c("repeats"),
            lambda r: F.concat(F.lit("repeated transmission token "), q(r), F.lit(" ignored; it is not the exterior colour")),
        ),
        _note(
            n_engine > 1,
            F.concat(
                F.lit("engine window holds "), n_engine.cast("string"), F.lit(" segments "),
                q(c("window_text")), F.lit("; something between the anchors shifted"),
            ),
        ),
        _note(
            (n_engine == 1) & c("litres").isNull() & ~c("engine_raw").rlike(r"\d"),
            F.concat(F.lit("engine "), q(c("engine_raw")), F.lit(" states no number")),
        ),
        _note(
            (n_engine == 1) & c("engine_raw").rlike(r"\d") & ~F.coalesce(in_range, F.lit(False)),
            F.concat(
                F.lit("engine "), q(c("engine_raw")),
                F.lit(f" is outside {ENGINE_MIN_L}-{ENGINE_MAX_L} litres and is not a displacement"),
            ),
        ),
        F.transform(
            F.slice(c("vins"), F.lit(2), F.greatest(F.size(c("vins")) - 1, F.lit(0))),
            lambda v: F.concat(F.lit("second vin-shaped segment "), q(v), F.lit(" ignored")),
        ),
        _note(
            n_colours >= 3,
            F.concat(
                F.lit("colours "), q(colour_text),
                F.lit(" do not split into exactly one exterior and one interior; the boundary is not stated"),
            ),
        ),
    )
    name = F.when(found, c("name")).otherwise("")
    designation = F.struct(
        tx.word_tokens(name).alias("tokens"),
        tx.fingerprint(name).alias("fingerprint"),
        name.alias("raw"),
    )
    car = F.struct(
        designation.alias("designation"),
        named_field("brand", F.get(c("parts"), F.lit(0))),
        named_field("model_head", F.get(c("parts"), F.lit(1))),
        named_field(
            "trim",
            tx.tidy(F.array_join(F.slice(c("parts"), F.lit(3), F.greatest(n_parts - 2, F.lit(0))), " ")),
        ),
        anchor_field("fuel", c("fuel")),
        _field(
            "engine_l",
            engine_state,
            c("litres"),
            F.when(~found, raw).when(n_engine > 1, c("window_text")).otherwise(c("engine_raw")),
        ),
        anchor_field("transmission", c("trans")),
        _field("model_year", year_state, c("year"), c("year_raw")),
        colour_field("exterior", 0),
        colour_field("interior", 1),
        text_field("vin_tag", F.get(c("vins"), F.lit(0))),
        text_field("variant_suffix", F.when(found, c("suffix"))),
        raw.alias("raw"),
        F.when(found, notes).otherwise(unanchored).alias("unresolved"),
        F.lit(GRAMMAR_VERSION).alias("grammar_version"),
        (found & (tx.fingerprint(name) != "")).alias("ok"),
    )
    # A generator's own expression is interpreted; the car is put together below it, in compiled code.
    df = df.select(*keep, car.alias(p + "car"))
    return df.select(*keep, tx.sealed(c("car")).alias(into))


def parse_model_folders(
    df: DataFrame, source: str, into: str = "car", fold: bool = True
) -> DataFrame:
    """Car parse of a library folder name: colours are silenced, stated ones noted."""
    df = parse_car_strings(df, source, "__folder_car", fold)
    car = F.col("__folder_car")
    colours = F.filter(
        F.array(car.exterior.raw, car.interior.raw), lambda r: F.coalesce(r, F.lit("")) != ""
    )
    ignored = F.concat(
        F.lit("model folder name states colour "),
        tx.quoted(F.array_join(F.array_distinct(colours), " / ")),
        F.lit("; ignored, because the variant folders below it hold the colour that was actually photographed"),
    )
    folded = (
        car.withField("exterior", silent_field("exterior"))
        .withField("interior", silent_field("interior"))
        .withField(
            "unresolved",
            F.when(F.size(colours) > 0, F.concat(car.unresolved, F.array(ignored))).otherwise(car.unresolved),
        )
        .withField("grammar_version", F.lit(FOLDER_GRAMMAR_VERSION))
    )
    return df.withColumn(into, folded).drop("__folder_car")


def parses_as_car(car: Column) -> Column:
    return car.ok & (car.designation.fingerprint != "")


def brand_key(car: Column) -> Column:
    """Stated brand's fingerprint, else the first word of the designation."""
    stated = F.when(car.brand.state == "stated", tx.fingerprint(car.brand.value))
    return F.coalesce(F.nullif(stated, F.lit("")), F.get(car.designation.tokens, F.lit(0)), F.lit(""))
