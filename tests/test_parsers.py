"""Golden rows for the two car grammars and the two colour readings."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotledger.functions import carkey, leaf, modelcode
from lotledger.functions import text as tx

# Sample strings of public stock data with hand-derived readings, then strings of our own.
CARS = {
    "TOYOTA-CROWN-HEV-HEV-2.5-AT-PRECIOUS WHITE PEARL-BLACK-26": dict(
        brand="TOYOTA", model_head="CROWN", trim="HEV", fuel="HEV", engine_l=Decimal("2.5"), model_year=2026,
        exterior="PRECIOUS WHITE PEARL", interior="BLACK"),
    "HIPHI-X-FLAGSHIP-EV-0-AT-DARK GREY-WHITE-2022": dict(engine_l="unparseable", model_year=2022),
    "MG-RX5-LUXURY-PETROL-2-AT-BLACK-BLACK-RED-2023": dict(exterior="unparseable", interior="unparseable"),
    "BAW -212-ADVENTURER-PV-2.0-AT-BLACK-BLACK-2026": dict(brand="BAW"),
    "TOYOTA-CAMRY-CLEN-PV-AT-BLACK-BLACK-26": dict(engine_l="silent", model_year=2026),
    "TOYOTA-FORTUNER-EXR-1-PV-2.7-AT-ATTITUDE BLACK MC-SAND BEIGE-26": dict(trim="EXR 1"),
    "26-LEXUS-LEXUS LX700-LX7HU-HEV-3.5-AT-BLACK-CHAMOIS": dict(brand="LEXUS", model_head="LEXUS LX700", trim="LX7HU", model_year=2026),
    "TOYOTA-HILUX-H24AF-DV-2.4L-AT-PLATINUM WHITE-MAROON-26": dict(engine_l=Decimal("2.4")),
    "ROX 01-6 SEATER-PHEV-1.5-AT-BLACK-ORANGE-26": dict(brand="unparseable", model_head="unparseable", trim="unparseable"),
    "A-B-C-PV-2,4-AT-AT-RED-ABCDEFGH123456789-26 GT": dict(
        engine_l=Decimal("2.4"), vin_tag="ABCDEFGH123456789", variant_suffix="GT", exterior="RED", interior="silent"),
    "22-A-B-C-PV-2-AT-RED-BLACK-24": dict(model_year=2024),
    "A-B-C-PV-2-AT-RED-2026-NEW": dict(model_year=2026, variant_suffix="NEW", exterior="RED"),
    "Ａ-Ｂ-Ｃ-ＰＶ-2-AT-RED": dict(brand="A", trim="C"),
    "nothing here": dict(brand="unparseable", model_year="silent", exterior="silent"),
    "": dict(brand="silent", fuel="silent"),
}

# The same samples under the other grammar.
CODES = {
    "TOYOTA-CROWN-HEV-HEV-2.5-AT-PRECIOUS WHITE PEARL-BLACK-26": None,
    "HIPHI-X-FLAGSHIP-EV-0-AT-DARK GREY-WHITE-2022": dict(brand="Hiphi", model="X", trim="Flagship", engine_size="0", fuel_type="Electric"),
    "MG-RX5-LUXURY-PETROL-2-AT-BLACK-BLACK-RED-2023": dict(exterior_color="BLACK", interior_color="BLACK", engine_size="2"),
    "BAW -212-ADVENTURER-PV-2.0-AT-BLACK-BLACK-2026": dict(brand="Baw"),
    "TOYOTA-CAMRY-CLEN-PV-AT-BLACK-BLACK-26": None,
    "TOYOTA-FORTUNER-EXR-1-PV-2.7-AT-ATTITUDE BLACK MC-SAND BEIGE-26": dict(trim="Exr 1"),
    "26-LEXUS-LEXUS LX700-LX7HU-HEV-3.5-AT-BLACK-CHAMOIS": dict(trim="Lx7Hu", year=2026),
    "TOYOTA-HILUX-H24AF-DV-2.4L-AT-PLATINUM WHITE-MAROON-26": None,
    "ROX 01-6 SEATER-PHEV-1.5-AT-BLACK-ORANGE-26": dict(brand="", model="Rox 01", trim="6 Seater"),
    "TOYOTA-YARIS-PV--AT-WHITE-BEIGE": dict(brand="Toyota", model="Yaris", trim="", engine_size=None),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(s,) for s in {**CARS, **CODES}], "s string")
    out = modelcode.parse_model_codes(carkey.parse_car_strings(rows, "s"), "s")
    return {r.s: r for r in out.collect()}


@pytest.mark.parametrize("text", CARS)
def test_car_string(parsed, text):
    car = parsed[text].car
    for name, want in CARS[text].items():
        field = car[name]
        assert (field.value if field.state == "stated" else field.state) == want, (name, field)


@pytest.mark.parametrize("text", CODES)
def test_model_code(parsed, text):
    got = parsed[text].code_parse
    if CODES[text] is None:
        assert got is None
    else:
        assert {k: got[k] for k in CODES[text]} == CODES[text]


def test_parse_is_stable_under_cleaning(spark):
    rows = spark.createDataFrame([(s,) for s in CARS], "s string").withColumn("t", tx.clean(F.col("s")))
    out = carkey.parse_car_strings(carkey.parse_car_strings(rows, "s", "a"), "t", "b", fold=False)
    ascii_only = out.filter(~F.col("s").rlike(r"[^\x00-\x7F]"))
    assert ascii_only.filter("NOT (a <=> b)").count() == 0


def test_unresolved_notes(parsed):
    assert parsed["HIPHI-X-FLAGSHIP-EV-0-AT-DARK GREY-WHITE-2022"].car.unresolved == [
        "engine '0' is outside 0.5-10.0 litres and is not a displacement"
    ]
    assert "repeated transmission token 'AT' ignored" in parsed["A-B-C-PV-2,4-AT-AT-RED-ABCDEFGH123456789-26 GT"].car.unresolved[0]


def test_folder_names_silence_colours(spark):
    rows = spark.createDataFrame([("MG-ZS-STD-PV-1.5-AT-WHITE-BLACK-22",)], "s string")
    car = carkey.parse_model_folders(rows, "s").first().car
    assert car.exterior.state == car.interior.state == "silent"
    assert "states colour 'WHITE / BLACK'" in car.unresolved[-1]


def test_leaves(spark):
    names = ["WHITE INSIDE BLACK 26", "RED INSID TAN-ABCDEFGH123456789", "PHOTOS", "X INSIDE ", "WHITE INSIDE BLACK 1899", "A INSIDE B-ABC12345678"]
    rows = spark.createDataFrame([(n,) for n in names], "s string")
    got = {r.s: (r.l, r.f) for r in leaf.parse_folder_colours(leaf.parse_leaves(rows, "s", "l"), "s", "f").collect()}
    assert tuple(got[names[0]][0]) == ("WHITE", "BLACK", None)
    assert tuple(got[names[1]][0]) == ("RED", "TAN", "ABCDEFGH123456789")
    assert tuple(got[names[2]][0]) == tuple(got[names[3]][0]) == (None, None, None)
    # 1899 is no model year for the strict reading and no 19/20 year for the loose one.
    assert got[names[4]][0].interior == "BLACK 1899"
    # An eleven-character tag counts only for the loose reading.
    assert got[names[5]][0].interior == "B-ABC12345678" and got[names[5]][1].interior == "B"


def test_descriptions(spark):
    reply = "reply struct<brand:string,model:string,trim:string,year:int,exterior_color:string,interior_color:string,fuel_type:string,engine_size:string,transmission:string>"
    rows = spark.createDataFrame(
        [("MG-ZS-STD-PV-1.5-AT-WHITE-BLACK-22", None), ("  ", None), ("X", ("MG", " ", None, 2022, None, None, None, None, None))], f"s string, {reply}"
    )
    got = {r.s.strip(): r.fields for r in modelcode.parse_descriptions(rows, "s", "reply").collect()}
    assert got["MG-ZS-STD-PV-1.5-AT-WHITE-BLACK-22"].brand == "Mg" and got["MG-ZS-STD-PV-1.5-AT-WHITE-BLACK-22"]._source == "regex"
    assert got[""]._source == "empty" and got["X"].brand == "MG" and got["X"].model is None


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(tx.title(lit("CROWN-HEV h24af o'neil"))) == "Crown-Hev H24Af O'Neil"
    assert one(tx.price(lit(" 1,234.50 "))) == 1234.5
    assert one(tx.price(lit("1_000"))) == 1000.0
    for bad in ("1d", "nan", "inf", "n/a", "", "1__0"):
        assert one(tx.price(lit(bad))) is None, bad
    assert one(tx.match_key(lit(" nan "))) == "" and one(tx.match_key(lit(" a  b"))) == "A B"
    assert one(tx.token_set(lit("2.4L v.6, Été a.b"))) == ["2.4l", "v.6", "été", "a", "b"]
    assert one(tx.primary_colour(lit("WHITE BODY & BLACK ROOF"))) == "WHITE"
    assert one(tx.primary_colour(lit("BLACK ROOF and RED BODY"))) == "RED"
    assert one(tx.primary_colour(lit("GREY"))) == "GREY"
    assert one(tx.stemmed_tokens(lit("Heated seats, TPMS"))) == ["heat", "seat", "tpm", "tire", "pressure", "monitor", "system"]
    assert one(tx.file_suffix(lit(".hidden"))) == "" and one(tx.file_suffix(lit("a.B.PDF"))) == ".pdf"
    assert one(tx.quoted(lit("it's"))) == '"it\'s"'
    assert one(tx.root_key(lit("C:\\Lib\\"))) == "c:/lib"
    assert one(tx.distinct_options(F.array(lit(" a"), lit("a"), lit(""), lit("b")))) == ["a", "b"]
    assert one(tx.litres_from_cc(lit(1498))) == 1.5 and one(tx.horsepower_from_kw(lit(100))) == 134


def test_first_int_of_any_length(spark):
    long = "9" * 45
    texts = [f"no {long} x", "0" * 50 + "12", "000", "a0b7", "7.50", "none", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.first_int(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in got] == [long, "12", "0", "0", "7", None, None, None]
