"""Column expressions for cleaning, keys, tokens and small text readings.

Everything here is a built-in Spark expression except ``fold_nfkc``, which has
no JVM equivalent and sends only non-ASCII cells to Arrow.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGINE_TYPE = "decimal(12,6)"

_SPACES = r"(?U)[\s\x1c-\x1f]+"
# The characters of _SPACES, for trimming without a search at every place of a text.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NON_ALNUM = "[^a-z0-9]+"
_NON_ASCII = r"[^\x00-\x7F]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold_nfkc(df: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by its NFKC form. ASCII cells travel to Python as
    nulls, so the Arrow payload is the non-ASCII text only."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    masked = F.when(F.col(column).rlike(_NON_ASCII), F.col(column))
    return df.withColumn("__nfkc", nfkc(masked)).withColumn(
        column, F.coalesce(F.col("__nfkc"), F.col(column))
    ).drop("__nfkc")


def sealed(value: Column) -> Column:
    """One row in, one row out, through a generator.

    Predicates and projections above are not rewritten in terms of the value's
    inputs. A parser's result is a deep expression tree whose levels use each
    other many times; unsealed, one filter on it would be inlined level by level.
    """
    return F.explode(F.array(value))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(c: Column) -> Column:
    """Whitespace runs collapsed, ends trimmed, null as empty."""
    return F.trim(F.regexp_replace(_text(c), _SPACES, " "))


def strip(c: Column) -> Column:
    """Outer whitespace removed, inner text untouched."""
    return F.btrim(_text(c), F.lit(_BLANKS))


def tidy(c: Column) -> Column:
    """``clean`` plus spaces, hyphens, tabs and dots stripped from both ends."""
    return F.btrim(clean(c), F.lit(" -\t."))


def fingerprint(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(_text(c)), _NON_ALNUM, "")


# Same reading, used by catalog and identity comparison, which never fold NFKC.
normal_form = fingerprint


def word_tokens(c: Column) -> Column:
    """Ordered alphanumeric words."""
    spaced = F.trim(F.regexp_replace(F.lower(_text(c)), _NON_ALNUM, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def match_key(c: Column) -> Column:
    """Identifier normalised for matching; the text NAN counts as empty."""
    key = F.upper(clean(c))
    return F.when(key == "NAN", F.lit("")).otherwise(key)


def engine_litres(c: Column) -> Column:
    """First number in the text, comma decimals allowed."""
    found = F.regexp_extract(F.replace(F.lower(clean(c)), F.lit(","), F.lit(".")), r"\d+(?:\.\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast(ENGINE_TYPE)


def year4(c: Column) -> Column:
    """Exactly two or four digits, read as a year within 1990-2100."""
    raw = clean(c)
    value = F.when(raw.rlike(r"^\d{2}$"), raw.try_cast("int") + 2000).when(
        raw.rlike(r"^\d{4}$"), raw.try_cast("int")
    )
    return F.when(value.between(1990, 2100), value)


def looks_like_vin(c: Column) -> Column:
    """15-17 letters and digits with at least one of each."""
    raw = F.upper(clean(c))
    return raw.rlike("^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]{15,17}$")


def title(c: Column) -> Column:
    """Every letter run capitalised (``H24AF`` becomes ``H24Af``)."""
    runs = F.regexp_extract_all(_text(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def quoted(c: Column) -> Column:
    """Value in quotes, as reason sentences print it."""
    body = F.replace(_text(c), F.lit("\\"), F.lit("\\\\"))
    double = body.contains("'") & ~body.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def quoted_list(values: Column) -> Column:
    """Distinct values quoted in first-seen order, or the word nothing."""
    joined = F.array_join(F.transform(F.array_distinct(values), quoted), ", ")
    return F.when(joined == "", F.lit("nothing")).otherwise(joined)


def price(c: Column) -> Column:
    """Text price to double: commas dropped, anything not a finite number null."""
    text = F.replace(strip(c.cast("string")), F.lit(","), F.lit(""))
    number = text.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$")
    value = F.when(number, F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def brand_guess(c: Column) -> Column:
    """First hyphen segment, title-cased; empty for no text."""
    return title(strip(F.get(F.split(_text(c), "-"), F.lit(0))))


def year_guess(c: Column) -> Column:
    """2000 plus a trailing ``-NN``."""
    digits = F.regexp_extract(strip(c), r"-(\d{2})$", 1)
    return F.nullif(digits, F.lit("")).try_cast("int") + 2000


def token_set(c: Column) -> Column:
    """Distinct lower-case tokens; punctuation splits, but a dot next to a digit stays."""
    spaced = F.regexp_replace(F.lower(_text(c)), r"(?U)(?<!\d)\.(?!\d)|[^\w.\s]", " ")
    spaced = clean(spaced)
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(spaced, " "))
    )


def overlap_score(n_common: Column, n_left: Column, n_right: Column) -> Column:
    """Larger of Jaccard and 0.85 times containment in the smaller set."""
    common = n_common.cast("double")
    jaccard = common / (n_left + n_right - n_common)
    contained = common / F.least(n_left, n_right)
    score = F.greatest(jaccard, contained * F.lit(0.85))
    return F.when((n_common > 0) & (n_left > 0) & (n_right > 0), score).otherwise(F.lit(0.0))


def set_score(left: Column, right: Column) -> Column:
    """``overlap_score`` over two distinct-token arrays."""
    return overlap_score(F.size(F.array_intersect(left, right)), F.size(left), F.size(right))


def first_int(c: Column) -> Column:
    """First run of digits without leading zeros: equal as text where equal as numbers, of any length."""
    found = F.nullif(F.regexp_extract(_text(c), r"(\d+)", 1), F.lit(""))
    return F.regexp_replace(found, "^0+(?=.)", "")


def primary_colour(c: Column) -> Column:
    """Two-tone exterior reduced to its body part."""
    raw = strip(c)
    parts = F.filter(
        F.transform(F.split(raw, r"(?i)(?U)\s*[&/+]\s*|\s+and\s+"), strip), lambda p: p != ""
    )
    body = F.coalesce(
        F.get(F.filter(parts, lambda p: p.rlike(r"(?i)\bbody\b")), F.lit(0)),
        F.get(parts, F.lit(0)),
    )
    bare = F.regexp_replace(body, r"(?i)\b(body|roof|colour|color)\b", " ")
    bare = strip(F.regexp_replace(bare, r"(?U)\s{2,}", " "))
    reduced = F.when(bare == "", body).otherwise(bare)
    return F.when(F.size(parts) < 2, raw).otherwise(reduced)


# Abbreviation expansions used when matching feature labels.
ABBREVIATIONS = {
    "ac": "air conditioning",
    "tpms": "tire pressure monitoring system",
    "abs": "anti lock braking system",
    "4wd": "four wheel drive",
    "awd": "all wheel drive",
    "esc": "electronic stability control",
    "usb": "universal serial bus",
    "tire": "tyre",
}


def stem(c: Column) -> Column:
    """One of ing/ed/es/s removed when three or more characters remain."""

    def cut(suffix: str) -> Column:
        return F.substring(c, F.lit(1), F.length(c) - len(suffix))

    out = c
    for suffix in ("s", "es", "ed", "ing"):
        out = F.when(c.rlike(f"^.{{3,}}{suffix}$"), cut(suffix)).otherwise(out)
    return out


def plain_words(c: Column) -> Column:
    """Lower-case words with punctuation as blanks, in order."""
    spaced = clean(F.regexp_replace(F.lower(_text(c)), r"(?U)[^\w\s]", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def stemmed_tokens(c: Column) -> Column:
    """Distinct stems of the words plus the stems of known abbreviations' expansions."""
    words = plain_words(c)
    expansions = F.create_map(
        *[F.lit(v) for short, full in ABBREVIATIONS.items() for v in (short, full)]
    )
    stems = F.transform(words, stem)
    expanded = F.flatten(
        F.transform(
            F.filter(words, lambda w: F.try_element_at(expansions, w).isNotNull()),
            lambda w: F.transform(F.split(F.try_element_at(expansions, w), " "), stem),
        )
    )
    return F.array_distinct(F.concat(stems, expanded))


def distinct_options(values: Column) -> Column:
    """Trimmed, non-empty, de-duplicated strings in order."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))


def fold_case(c: Column) -> Column:
    """Caseless form for option matching; sharp s expands as full case folding does."""
    return F.replace(F.lower(_text(c)), F.lit("ß"), F.lit("ss"))


def file_suffix(name: Column) -> Column:
    """Lower-case extension with its dot; names that only start with a dot have none."""
    last = F.substring_index(name, ".", -1)
    before = F.length(name) - F.length(last)  # 0 without a dot, 1 where only the first character is one
    return F.when(before > 1, F.lower(F.concat(F.lit("."), last))).when(name.isNotNull(), F.lit(""))


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_parent(path: Column) -> Column:
    """Parent path, empty for a top-level entry."""
    above = F.length(path) - F.length(path_name(path)) - 1
    return F.substring(path, F.lit(1), F.greatest(above, F.lit(0)))


def root_key(root: Column) -> Column:
    """Root path with forward slashes, no trailing slash, caseless."""
    return fold_case(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", ""))


def litres_from_cc(cc: Column) -> Column:
    return F.round(cc / 1000, 1)


def horsepower_from_kw(kw: Column) -> Column:
    return F.round(kw * F.lit(1.341), 0).cast("int")
