"""Resolving cars to exactly one library folder and colour variant.

Nothing here pairs targets with folders. Targets collapse to distinct
*questions* and folders to distinct *signatures*; the designation gate is an
equality join between the two, and the colour steps are equality joins on
colour *patterns* whose sides are already counted. What the wide retrieval
buckets add, the size of the pool and the tally of folders rejected on
designation, is arithmetic over bucket counts, so a brand holding a third of
the library costs one row, not a square.

Candidates of ambiguous questions come as rows keyed by question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import carkey
from lotledger.functions import compare as cp
from lotledger.functions import text as tx
from lotledger.functions.trust import remedy_text
from lotledger.operators.library import Library
from lotledger.session import merged, settle


_LOGO_TAIL = r"(?i)[\s.\-]*(?:no|with\s*out)\s+logo\s*$"
_CODES = tuple(f"c_{f}" for f in cp.CORROBORATORS)
_OPEN = "open"


def _codes(car: Column) -> list[Column]:
    return [cp.car_code(car, f).alias(f"c_{f}") for f in cp.CORROBORATORS]


def _ask(code: Column) -> Column:
    """Colour part of a pattern: what the target states, or anything."""
    return F.when(code.startswith("="), code).otherwise(F.lit("*"))


def questions(targets: DataFrame, car: str = "car") -> DataFrame:
    """Targets with the columns that determine their answer and ``question``."""
    c = F.col(car)
    keyed = targets.select(
        "*",
        c.designation.fingerprint.alias("d_fp"),
        carkey.brand_key(c).alias("brand_key"),
        tx.fingerprint(c.raw).alias("raw_fp"),
        *_codes(c),
        _ask(cp.car_code(c, "exterior")).alias("ask_ext"),
        _ask(cp.car_code(c, "interior")).alias("ask_int"),
    )
    determine = ["d_fp", "brand_key", "raw_fp", *_CODES, "ask_ext", "ask_int"]
    return keyed.withColumn("question", F.md5(F.concat_ws("\u001f", *determine)))


def sheet_keys(name: Column) -> Column:
    """Fingerprints of a sheet's stem, with and without a no-logo note."""
    stem = tx.file_stem(name)
    keys = F.array(tx.fingerprint(stem), tx.fingerprint(F.regexp_replace(stem, _LOGO_TAIL, "")))
    return F.filter(F.array_distinct(keys), lambda k: k != "")


def _stems(library: Library) -> DataFrame:
    """``stem, path`` of the sheets of each folder; names fold to one form first."""
    named = tx.fold_nfkc(library.sheets.select("name", F.col("folder_path").alias("path")), "name")
    return named.select(F.explode(sheet_keys(F.col("name"))).alias("stem"), "path")


def bucket_tables(library: Library) -> DataFrame:
    """Inverted index ``bucket, key, path``, each pair once."""
    car = F.col("car")
    folders = library.folders.select(
        "path", car.designation.fingerprint.alias("d"), carkey.brand_key(car).alias("b")
    )
    stems = _stems(library).select(F.col("stem").alias("key"), "path")
    return (
        folders.select(F.lit("designation_fingerprint").alias("bucket"), F.col("d").alias("key"), "path")
        .unionByName(folders.select(F.lit("brand_token").alias("bucket"), F.col("b").alias("key"), "path"))
        .unionByName(stems.select(F.lit("sheet_filename_stem").alias("bucket"), "key", "path"))
        .filter("key != ''")
        .distinct()
    )


def probes(asked: DataFrame) -> DataFrame:
    """``question, bucket, key`` of each question."""
    probe = lambda bucket, key: F.struct(F.lit(bucket).alias("bucket"), F.col(key).alias("key"))
    return (
        asked.select(
            "question",
            F.explode(
                F.array(
                    probe("designation_fingerprint", "d_fp"), probe("brand_token", "brand_key"),
                    probe("sheet_filename_stem", "raw_fp"), probe("sheet_filename_stem", "d_fp"),
                )
            ).alias("p"),
        )
        .select("question", "p.bucket", "p.key")
        .filter("key != ''")
        .distinct()
    )


def retrieval_counts(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """Folders each probe of each question surfaces: ``question, bucket, key,
    n_folders``. The folders themselves stay in ``buckets``, one equality away."""
    sizes = buckets.groupBy("bucket", "key").agg(F.count("*").alias("n_folders"))
    return probes(asked).join(merged(sizes), ["bucket", "key"])


def retrieved(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """``question, path, buckets, keys``: the folders that the probes of each question surface, with
    the buckets and keys that hit, in the order of probes. A row per question and folder: meant for
    the questions somebody wants shown; over all of them ``retrieval_counts`` has the sizes."""
    bucket, key = F.col("bucket"), F.col("key")
    turn = (
        F.when(bucket == "designation_fingerprint", 0).when(bucket == "brand_token", 1).when(key == F.col("raw_fp"), 2).otherwise(3)
    )
    own = asked.select("question", "raw_fp").distinct()
    probed = probes(asked).join(merged(own), "question").select("question", "bucket", "key", turn.alias("turn"))
    hits = probed.join(merged(buckets), ["bucket", "key"]).groupBy("question", "path").agg(
        F.array_sort(F.collect_set(F.struct("turn", "bucket", "key"))).alias("hits")
    )
    return hits.select("question", "path", F.array_distinct("hits.bucket").alias("buckets"), F.array_distinct("hits.key").alias("keys"))


def _stray_counts(keys: DataFrame, stems: DataFrame) -> DataFrame:
    """``d_fp, brand_key, raw_fp, n_stray``: folders that hold a sheet named after the whole text
    or its name, and have neither the name nor the brand.

    Counted per stem from totals (all, less those of the name, less those of the brand, plus
    those of both), then the folders behind both stems are taken off once. Only the latter looks
    at folders, those of the text's own stem.
    """
    s = stems.select("stem", "path", F.col("d_fp").alias("fd"), F.col("brand_key").alias("fb"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = keys.select("*", F.explode(F.array_distinct(F.array("raw_fp", "d_fp"))).alias("at")).filter("at != ''")
    for name, own in (("n_all", []), ("n_name", ["fd"]), ("n_brand", ["fb"]), ("n_two", ["fd", "fb"])):
        held = s.groupBy("stem", *own).agg(F.count("*").alias(name))
        on = F.col("at") == F.col("stem")
        for c in own:
            on = on & (F.col({"fd": "d_fp", "fb": "brand_key"}[c]) == F.col(c))
        out = out.join(merged(held), on, "left").drop("stem", "fd", "fb")
    one = out.groupBy("d_fp", "brand_key", "raw_fp").agg(F.sum(n("n_all") - n("n_name") - n("n_brand") + n("n_two")).alias("n_one"))
    both = (
        keys.filter("raw_fp != d_fp AND raw_fp != '' AND d_fp != ''")
        .join(merged(s), F.col("raw_fp") == F.col("stem"))
        .filter("fd != d_fp AND fb != brand_key")
        .select("d_fp", "brand_key", "raw_fp", "path")
        .join(merged(s.select(F.col("stem").alias("d_fp"), "path")), ["d_fp", "path"], "left_semi")
        .groupBy("d_fp", "brand_key", "raw_fp")
        .agg(F.count("*").alias("n_twice"))
    )
    left = one.join(merged(both), ["d_fp", "brand_key", "raw_fp"], "left")
    return left.select("d_fp", "brand_key", "raw_fp", (F.col("n_one") - n("n_twice")).alias("n_stray")).filter("n_stray > 0")


def _pool_sizes(asked: DataFrame, folders: DataFrame, stems: DataFrame) -> DataFrame:
    """Distinct folders behind all probes, by inclusion and exclusion.

    Designation and brand buckets overlap in a counted way; sheet stems add only
    folders outside both, found by an equality join on the stem.
    """
    keys = asked.select("d_fp", "brand_key", "raw_fp").distinct()
    by_both = folders.groupBy("d_fp", "brand_key").agg(F.count("*").alias("n_both"))
    by_name = by_both.filter("d_fp != ''").groupBy("d_fp").agg(F.sum("n_both").alias("n_d"))
    by_brand = by_both.filter("brand_key != ''").groupBy("brand_key").agg(F.sum("n_both").alias("n_b"))
    overlap = by_both.filter("d_fp != '' AND brand_key != ''")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    stray = _stray_counts(keys, stems)
    return (
        keys.join(merged(by_name), "d_fp", "left")
        .join(merged(by_brand), "brand_key", "left")
        .join(merged(overlap), ["d_fp", "brand_key"], "left")
        .join(merged(stray), ["d_fp", "brand_key", "raw_fp"], "left")
        .select("d_fp", "brand_key", "raw_fp", (n("n_d") + n("n_b") - n("n_both") + n("n_stray")).alias("n_pool"))
    )


def _colour_posts(variants: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Variants by the colour patterns they satisfy: ``folder_path, path, pattern``.

    A variant that states colours answers ``exterior|interior`` and the same with
    either side open; one that states none answers ``open``.
    """
    v = variants.select(
        "folder_path", "path", F.col("exterior_raw").isNull().alias("silent"),
        *[F.concat(F.lit("="), tx.fingerprint(F.col(f"{s}_raw"))).alias(s) for s in ("exterior", "interior")],
    )
    for side in ("exterior", "interior"):
        own = F.array(F.lit("*"), F.when(F.length(side) > 1, F.col(side)))
        if aliases is not None:
            known = aliases.filter(F.col("field") == side).groupBy(F.concat(F.lit("="), "right_fp").alias(side)).agg(
                F.collect_set(F.concat(F.lit("="), "left_fp")).alias("also")
            )
            v = v.join(known, side, "left")
            own = F.concat(own, F.coalesce("also", F.array().cast("array<string>")))
        v = v.withColumn(f"k_{side}", F.array_distinct(F.filter(own, lambda k: k.isNotNull())))
        v = v.drop("also")
    both = F.flatten(
        F.transform("k_exterior", lambda e: F.transform("k_interior", lambda i: F.concat(e, F.lit("|"), i)))
    )
    return v.select(
        "folder_path", "path", "silent",
        F.when(F.col("silent"), F.lit("silent")).otherwise(F.col("exterior")).alias("m_ext"),
        F.when(F.col("silent"), F.lit("silent")).otherwise(F.col("interior")).alias("m_int"),
        F.explode(F.when(F.col("silent"), F.array(F.lit(_OPEN))).otherwise(both)).alias("pattern"),
    )


def _set_mark(rows: DataFrame, value: str, into: str) -> DataFrame:
    """Order-free mark of the distinct values per folder."""
    h = F.xxhash64(value)
    return rows.select("folder_path", value).distinct().groupBy("folder_path").agg(
        F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(20,0)")).cast("string")).alias(into)
    )


@dataclass(frozen=True)
class Located:
    """``targets``: one row per target with its outcome · ``answers``: one row per
    question · ``pairs``: question signature against folder signature with the
    killing field · ``folders``: folders with signature · ``posts``: colour
    patterns per variant · ``folder_posts``: colour patterns per folder."""

    targets: DataFrame
    answers: DataFrame
    pairs: DataFrame
    folders: DataFrame
    posts: DataFrame
    folder_posts: DataFrame


def _pairs(asked: DataFrame, signatures: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Distinct model question × folder signature of the same designation."""
    left = asked.select("d_fp", *_CODES).filter("d_fp != ''").distinct()
    right = signatures.withColumnsRenamed({c: f"f_{c}" for c in _CODES})
    pairs = left.join(merged(right), "d_fp")
    verdicts = {}
    for f in cp.CORROBORATORS:
        alias = None
        if aliases is not None:
            known = aliases.filter(F.col("field") == f).select(
                F.concat(F.lit("="), "left_fp").alias(f"c_{f}"), F.concat(F.lit("="), "right_fp").alias(f"f_c_{f}"),
                F.col("alias_id").alias(f"a_{f}"),
            )
            pairs = pairs.join(known, [f"c_{f}", f"f_c_{f}"], "left")
            alias = F.col(f"a_{f}")
        verdicts[f] = cp.code_verdict(F.col(f"c_{f}"), F.col(f"f_c_{f}"), alias)
    return pairs.withColumn("killer", cp.first_killer(verdicts))


def _differs(low: str, high: str) -> Column:
    return F.col(low) != F.col(high)


def locate(
    targets: DataFrame, library: Library, fresh: Column | None = None, aliases: DataFrame | None = None
) -> Located:
    """Outcome of every target: ``matched``, ``ambiguous``, ``absent`` or ``blocked``.

    ``targets`` carries ``car``. ``fresh`` is a boolean column, false when the
    index cannot be trusted. ``aliases``: ``field, left_fp, right_fp, alias_id``
    of values ratified as the same.
    """
    asked_rows = questions(targets)
    asked = settle(
        asked_rows.select("question", "d_fp", "brand_key", "raw_fp", *_CODES, "ask_ext", "ask_int").distinct()
    )
    car = F.col("car")
    folders = settle(
        library.folders.select(
            "path", "name", car.designation.fingerprint.alias("d_fp"), carkey.brand_key(car).alias("brand_key"), *_codes(car)
        ).withColumn("signature", F.md5(F.concat_ws("\u001f", "d_fp", *_CODES)))
    )
    stems = (
        _stems(library)
        .distinct()
        .join(merged(folders.select("path", "d_fp", "brand_key")), "path")
    )
    posts = settle(_colour_posts(library.variants, aliases))

    signatures = folders.groupBy("signature", "d_fp", *_CODES).agg(
        F.count("*").alias("n"), F.min("path").alias("one_path")
    )
    pairs = settle(_pairs(asked, signatures, aliases))
    tally = {f: F.sum(F.when(F.col("killer") == f, F.col("n")).otherwise(0)).alias(f"k_{f}") for f in cp.CORROBORATORS}
    survives = F.col("killer").isNull()
    model = pairs.groupBy("d_fp", *_CODES).agg(
        F.sum("n").alias("n_same"), F.sum(F.when(survives, F.col("n")).otherwise(0)).alias("n_surv"),
        F.min(F.when(survives, F.col("one_path"))).alias("sole_path"), *tally.values(),
    )

    # Colour patterns per folder; a folder without variants, or with one that
    # states no colours, is open to any target.
    open_paths = (
        folders.select(F.col("path").alias("folder_path"))
        .join(merged(posts.filter(~F.col("silent")).select("folder_path").distinct().withColumn("spoken", F.lit(True))), "folder_path", "left")
        .join(merged(posts.filter("silent").select("folder_path").distinct().withColumn("mute", F.lit(True))), "folder_path", "left")
        .filter("spoken IS NULL OR mute IS NOT NULL")
        .select("folder_path")
    )
    folder_posts = posts.filter(~F.col("silent")).select("folder_path", "pattern").distinct().join(
        merged(open_paths), "folder_path", "left_anti"
    ).unionByName(open_paths.withColumn("pattern", F.lit(_OPEN)))
    marks = folders.select(F.col("path").alias("folder_path"), "signature")
    for col, into in (("m_ext", "set_ext"), ("m_int", "set_int")):
        marks = marks.join(merged(_set_mark(posts, col, into)), "folder_path", "left")
    folder_posts = settle(folder_posts.join(merged(marks.fillna("0", ["set_ext", "set_int"])), "folder_path"))
    by_signature = folder_posts.groupBy("signature", "pattern").agg(
        F.count("*").alias("n_kept"), F.min("folder_path").alias("kept_path"),
        *[fn(c).alias(f"{tag}_{c}") for c in ("set_ext", "set_int") for tag, fn in (("lo", F.min), ("hi", F.max))],
    )
    staged = settle(
        asked.join(merged(model), ["d_fp", *_CODES], "left").join(
            merged(_pool_sizes(asked, folders, stems)), ["d_fp", "brand_key", "raw_fp"], "left"
        ).withColumn("pattern", F.concat("ask_ext", F.lit("|"), "ask_int"))
    )
    both = F.explode(F.array(F.col("pattern"), F.lit(_OPEN))).alias("pattern")
    kept = (
        staged.filter("n_surv > 1").select("question", "d_fp", *_CODES, both)
        .join(merged(pairs.filter(survives).select("d_fp", *_CODES, "signature", *[f"f_{c}" for c in _CODES])), ["d_fp", *_CODES])
        .join(merged(by_signature), ["signature", "pattern"])
        .groupBy("question")
        .agg(
            F.sum("n_kept").alias("n_kept"), F.min("kept_path").alias("kept_path"),
            *[fn(f"f_{c}").alias(f"{tag}_{c}") for c in _CODES for tag, fn in (("lo", F.min), ("hi", F.max))],
            *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in ("set_ext", "set_int")],
            *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in ("set_ext", "set_int")],
        )
    )
    # Consultation order, with the folders' colour sets at the separators' place.
    span = {f: (f"lo_c_{f}", f"hi_c_{f}") for f in cp.CORROBORATORS}
    span.update(exterior=("lo_set_ext", "hi_set_ext"), interior=("lo_set_int", "hi_set_int"))
    apart = F.coalesce(*[F.when(_differs(*span[f]), F.lit(f)) for f in cp.ROLES if f in span])
    kept = kept.select(
        "question", "n_kept", "kept_path", apart.alias("folder_apart")
    )
    staged = staged.join(merged(kept), "question", "left").withColumn(
        "folder_path",
        F.when(F.col("n_surv") == 1, F.col("sole_path")).when(F.col("n_kept") == 1, F.col("kept_path")),
    )

    by_folder = posts.groupBy("folder_path", "pattern").agg(
        F.count("*").alias("n_v"), F.min("path").alias("v_path"), F.count_if("silent").alias("n_mute"),
        *[fn(c).alias(f"{tag}_{c}") for c in ("m_ext", "m_int") for tag, fn in (("lo", F.min), ("hi", F.max))],
    )
    totals = library.variants.groupBy("folder_path").agg(F.count("*").alias("n_variants"))
    matched = staged.filter("folder_path IS NOT NULL")
    chosen = (
        matched.select("question", "folder_path", both)
        .join(merged(by_folder), ["folder_path", "pattern"])
        .groupBy("question")
        .agg(
            F.sum("n_v").alias("n_v"), F.min("v_path").alias("v_path"), F.sum("n_mute").alias("n_mute"),
            *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in ("m_ext", "m_int")],
            *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in ("m_ext", "m_int")],
        )
    )
    same_ext = matched.select("question", "folder_path", F.concat("ask_ext", F.lit("|*")).alias("pattern")).join(
        merged(by_folder.select("folder_path", "pattern", F.col("n_v").alias("n_ext"))), ["folder_path", "pattern"]
    ).select("question", "n_ext")
    answers = (
        staged.join(merged(totals), "folder_path", "left").join(merged(chosen), "question", "left").join(merged(same_ext), "question", "left")
        .fillna(0, ["n_pool", "n_same", "n_surv", "n_kept", "n_variants", "n_v", "n_mute", "n_ext", *[f"k_{f}" for f in cp.CORROBORATORS]])
    )
    answers = settle(_outcomes(answers, library, fresh))
    rows = asked_rows.drop("d_fp", "brand_key", "raw_fp", *_CODES, "ask_ext", "ask_int").join(merged(answers), "question")
    return Located(rows, answers, pairs, folders, posts, folder_posts)


def _outcomes(a: DataFrame, library: Library, fresh: Column | None) -> DataFrame:
    usable = library.folders.agg(F.count("*") > 0).scalar()
    trusted = F.lit(True) if fresh is None else fresh
    n = F.col
    found = n("folder_path").isNotNull()
    spec_failed = F.lit(False)
    for f in cp.CORROBORATORS:
        if f not in cp.NAME_FIELDS:
            spec_failed = spec_failed | (n(f"k_{f}") > 0)
    several = n("n_surv") > 1
    stage = (
        F.when(~n("usable"), F.lit("empty_index"))
        .when(~trusted, F.lit("stale_index"))
        .when(n("n_pool") == 0, F.lit("nothing_offered"))
        .when((n("n_surv") == 0) & (n("d_fp") == ""), F.lit("nameless"))
        .when((n("n_surv") == 0) & ~spec_failed, F.lit("no_such_name"))
        .when(n("n_surv") == 0, F.lit("spec_differs"))
        .when(several & (n("n_kept") == 0), F.lit("no_folder_in_colour"))
        .when(several & (n("n_kept") > 1), F.lit("several_folders"))
        .when(n("n_variants") == 0, F.lit("no_variants"))
        .when(n("n_v") == 0, F.lit("no_variant_in_colour"))
        .when(n("n_v") > 1, F.lit("several_variants"))
        .otherwise("matched")
    )
    outcome = (
        F.when(n("stage") == "matched", F.lit("matched"))
        .when(n("stage").isin("several_folders", "several_variants"), F.lit("ambiguous"))
        .when(n("stage").isin("empty_index", "stale_index"), F.lit("blocked"))
        .otherwise("absent")
    )
    remedy = (
        F.when(n("stage").isin("nothing_offered", "no_such_name"), F.lit("add_folder"))
        .when(n("stage") == "nameless", F.lit("name_the_car"))
        .when(n("stage") == "spec_differs", F.lit("confirm_field"))
        .when(n("stage").isin("several_folders", "several_variants"), F.lit("pick_one_of"))
        .when(n("stage").isin("no_folder_in_colour", "no_variants", "no_variant_in_colour"), F.lit("photograph_variant"))
    )
    variant_apart = F.coalesce(
        F.when(_differs("lo_m_ext", "hi_m_ext"), F.lit("exterior")), F.when(_differs("lo_m_int", "hi_m_int"), F.lit("interior"))
    )
    # All variants fail on the interior only when none differs on the exterior.
    failed_colour = F.when(
        (n("ask_ext") == "*") | (n("n_ext") == n("n_variants")), F.lit("interior")
    ).otherwise("exterior")
    tallies = [("designation", n("n_pool") - n("n_same"))] + [(f, n(f"k_{f}")) for f in cp.CORROBORATORS]
    tally = F.array_join(
        F.filter(
            F.array(*[F.when(count > 0, F.concat(count.cast("string"), F.lit(f" on {f}"))) for f, count in tallies]),
            lambda s: s.isNotNull(),
        ),
        ", ",
    )
    specs = [f for f in cp.CORROBORATORS if f not in cp.NAME_FIELDS]
    failed_specs = F.array_join(
        F.filter(F.array(*[F.when(n(f"k_{f}") > 0, F.lit(f)) for f in specs]), lambda s: s.isNotNull()), ", "
    )
    return (
        a.withColumn("usable", usable)
        .withColumn("stage", stage)
        .withColumn("outcome", outcome)
        .select(
            "question", "outcome", "stage", remedy.alias("remedy_code"),
            F.when(found & (n("outcome") != "blocked"), n("folder_path")).alias("folder_path"),
            F.when(n("stage") == "matched", n("v_path")).alias("variant_path"),
            F.when(n("stage") == "matched", F.when(n("n_variants") == 1, F.lit("sole_variant")).otherwise("colour_unique")).alias("basis"),
            F.when(n("stage") == "several_folders", F.coalesce("folder_apart", F.lit("exterior")))
            .when(n("stage") == "several_variants", F.coalesce(variant_apart, F.lit("exterior"))).alias("discriminator"),
            F.when(n("stage") == "several_folders", n("folder_apart").isNotNull())
            .when(n("stage") == "several_variants", variant_apart.isNotNull()).alias("separable"),
            F.when(n("stage") == "no_variant_in_colour", failed_colour).alias("failed_colour"),
            F.when(n("stage") == "several_folders", n("n_kept")).when(n("stage") == "several_variants", n("n_v"))
            .otherwise(0).alias("n_candidates"),
            "n_pool", "n_same", "n_surv", "n_kept", "n_variants", F.col("n_v").alias("n_variants_left"), "n_mute",
            tally.alias("tally"), failed_specs.alias("failed_specs"),
            "d_fp", *_CODES, "ask_ext", "ask_int",
        )
    )


def candidates(located: Located) -> DataFrame:
    """``question, folder_path, variant_path`` of every ambiguous question: the
    surviving folders, or the surviving variants of the matched folder."""
    both = F.explode(F.array(F.concat("ask_ext", F.lit("|"), "ask_int"), F.lit(_OPEN))).alias("pattern")
    asked = located.answers.filter("outcome = 'ambiguous'").select("question", "stage", "folder_path", "d_fp", *_CODES, both)
    survivors = located.pairs.filter("killer IS NULL").select("d_fp", *_CODES, "signature")
    of_folders = (
        asked.filter("stage = 'several_folders'").drop("folder_path")
        .join(merged(survivors), ["d_fp", *_CODES])
        .join(merged(located.folder_posts), ["signature", "pattern"])
        .select("question", "folder_path", F.lit(None).cast("string").alias("variant_path"))
    )
    of_variants = (
        asked.filter("stage = 'several_variants'")
        .join(merged(located.posts.select("folder_path", "pattern", F.col("path").alias("variant_path"))), ["folder_path", "pattern"])
        .select("question", "folder_path", "variant_path")
    )
    return of_folders.unionByName(of_variants)


def name_rejects(located: Located) -> DataFrame:
    """Folder signatures of the right name rejected on another field, per model
    question, with the number of folders behind each."""
    return located.pairs.filter("killer IS NOT NULL")


def prefix_rejects(asked: DataFrame, folders: DataFrame) -> DataFrame:
    """Same-brand names where one is only a prefix of the other.

    Both sides reduce to distinct names; each name meets the other side's
    prefixes by equality. Returns ``d_fp, folder_fp, n_folders``.
    """
    left = asked.select("d_fp", "brand_key").filter("d_fp != '' AND brand_key != ''").distinct()
    right = (
        folders.filter("d_fp != '' AND brand_key != ''")
        .groupBy("brand_key", F.col("d_fp").alias("folder_fp"))
        .agg(F.count("*").alias("n_folders"))
    )
    prefixes = lambda c: F.explode(
        F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, F.lit(1), i))
    )
    long = lambda df, c: df.filter(F.length(c) > 1).select("*", prefixes(F.col(c)).alias("prefix"))
    shorter_target = long(right, "folder_fp").join(merged(left.withColumnRenamed("d_fp", "prefix")), ["brand_key", "prefix"]).select(
        F.col("prefix").alias("d_fp"), "folder_fp", "n_folders"
    )
    longer_target = long(left, "d_fp").join(merged(right.withColumnRenamed("folder_fp", "prefix")), ["brand_key", "prefix"]).select(
        "d_fp", F.col("prefix").alias("folder_fp"), "n_folders"
    )
    return shorter_target.unionByName(longer_target)


def messages(located: Located, number: str) -> DataFrame:
    """One folder path, or one sentence saying why there is none, per target.

    An ambiguous sentence gives the number of folders; ``candidates`` has their
    names, a row each, for every question alike. ``remedy`` is the code with what
    to do; a message ends in it.
    """
    t = located.targets
    num, car, s = F.col(number), F.col("car"), F.col("stage")
    named = tx.quoted(car.designation.raw)
    text = lambda c: c.cast("string")
    colour = lambda f: (
        F.when(car[f].state == "stated", tx.quoted(car[f].raw))
        .when(car[f].state == "unparseable", F.concat(tx.quoted(car[f].raw), F.lit(" (unreadable)")))
        .otherwise("a colour the feed does not state")
    )
    asked_colour = F.when(F.col("failed_colour") == "interior", colour("interior")).otherwise(colour("exterior"))
    folder = tx.quoted(tx.path_name(F.col("folder_path")))
    reason = (
        F.when(s == "empty_index", F.lit("the index holds no model folders, so there was nothing to look through"))
        .when(s == "stale_index", F.lit("the index cannot be trusted"))
        .when(s == "nothing_offered", F.lit("no model folder was offered for comparison"))
        .when(s == "nameless", F.concat(
            tx.quoted(F.coalesce(F.nullif(car.raw, F.lit("")), F.lit("(empty)"))), F.lit(" states no name to match on, so every one of the "),
            text(F.col("n_pool")), F.lit(" folders considered failed the designation gate")))
        .when(s == "no_such_name", F.concat(
            F.lit("no folder is named for "), named, F.lit("; "), text(F.col("n_pool")), F.lit(" considered, "), F.col("tally")))
        .when(s == "spec_differs", F.concat(
            F.lit("the library holds "), named, F.lit(" but no folder agrees on "), F.col("failed_specs"), F.lit("; "),
            text(F.col("n_pool")), F.lit(" considered, "), F.col("tally")))
        .when(s == "no_folder_in_colour", F.concat(
            text(F.col("n_surv")), F.lit(" folders match this specification but none holds a variant in "), colour("exterior")))
        .when(s == "no_variants", F.concat(folder, F.lit(" holds no variant folders, so there is no colour to resolve")))
        .when(s == "no_variant_in_colour", F.concat(
            folder, F.lit(" is the right model, but none of its "), text(F.col("n_variants")), F.lit(" variants is "), asked_colour))
    )
    message = (
        F.when(F.col("outcome") == "blocked", F.concat(F.lit("Could not look for "), num, F.lit(": "), reason))
        .when(F.col("outcome") == "ambiguous", F.concat(
            num, F.lit(" matches "), text(F.col("n_candidates")), F.lit(" folders and nothing separates them"),
            F.lit(". The field that would settle it is '"),
            F.col("discriminator"), F.lit("'")))
        .when(F.col("outcome") == "absent", F.concat(F.lit("No folder for "), num, F.lit(": "), reason))
    )
    detail = (
        F.when(F.col("outcome") == "blocked", F.lit("bring the index up to date before any car is looked up"))
        .when((F.col("outcome") == "ambiguous") & F.col("separable"), F.concat(
            F.lit("state the "), F.col("discriminator"), F.lit(" of this car, or let a reviewer choose")))
        .when(F.col("outcome") == "ambiguous", F.lit("a reviewer has to open the folders and choose, one car may be filed twice"))
        .when(s == "nothing_offered", F.lit("look over the shortlist, then add a folder if the library lacks this car"))
        .when(s == "nameless", F.lit("give a code or description that names the car"))
        .when(s == "no_such_name", F.concat(
            F.lit("add a folder for "), named, F.lit(", or record the spelling under which the library holds it")))
        .when(s == "spec_differs", F.concat(F.lit("check "), F.col("failed_specs"), F.lit(" on the vehicle")))
        .when(F.col("outcome") == "absent", F.lit("photograph this colour, or check the colour on the vehicle"))
    )
    remedy = remedy_text(F.col("remedy_code"), detail)
    message = F.concat(message, F.lit(". Remedy: "), remedy)
    return t.withColumn("reason", reason).withColumn("remedy", remedy).withColumn("message", message).withColumn(
        "located_path", F.when(F.col("outcome") == "matched", F.col("variant_path"))
    )
