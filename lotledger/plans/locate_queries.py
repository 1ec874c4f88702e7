"""Registered queries over retrieval and location."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotledger.functions import carkey
from lotledger.functions import compare as cp
from lotledger.operators import locate as loc
from lotledger.plans import parse_sql as ps
from lotledger.plans.derive import table, with_clause
from lotledger.plans.library_queries import CRAWL, index
from lotledger.session import merged, settle

# Fixed alias rows: values ratified as the same.
ALIASES = [("fuel", "pluginhybridelectric", "hev", "phev-1"), ("exterior", "pearlwhite", "white", "white-1")]


def _targets(spark, sf):
    return settle(carkey.parse_car_strings(table(spark, sf, "car_strings", deal=True), "car_string"))


def _located(spark, sf, aliases=False):
    known = spark.createDataFrame(ALIASES, "field string, left_fp string, right_fp string, alias_id string") if aliases else None
    return loc.locate(_targets(spark, sf), index(spark, sf), aliases=known)


_OUT = (
    "car_id", "outcome", "stage", "remedy_code", "folder_path", "variant_path", "basis", "discriminator", "separable",
    "failed_colour", "n_candidates", "n_pool", "n_same", "n_surv", "tally", "failed_specs",
)


def locate(spark, sf):
    return _located(spark, sf).targets.select(*_OUT)


def locate_with_aliases(spark, sf):
    return _located(spark, sf, aliases=True).targets.select(*_OUT)


def locate_candidates(spark, sf):
    """Candidates per question, named by the question's own content."""
    found = _located(spark, sf)
    return loc.candidates(found).join(merged(found.answers.select("question", "stage", "d_fp")), "question").select(
        "stage", "d_fp", "folder_path", "variant_path"
    ).distinct()


def locate_rejects(spark, sf):
    rejects = loc.name_rejects(_located(spark, sf))
    readable = [F.when(F.col(c).startswith("?"), F.lit("?")).otherwise(F.col(c)).alias(c) for c in loc._CODES]
    return rejects.select("d_fp", "killer", "signature", "n", *readable).distinct().groupBy("d_fp", F.col("killer").alias("failed_on")).agg(
        F.count("*").alias("n_signature_pairs"), F.sum("n").alias("n_folders")
    )


def prefix_rejects(spark, sf):
    asked = loc.questions(_targets(spark, sf))
    car = F.col("car")
    folders = index(spark, sf).folders.select(
        car.designation.fingerprint.alias("d_fp"), carkey.brand_key(car).alias("brand_key")
    )
    return loc.prefix_rejects(asked, folders)


def retrieval_blocks(spark, sf):
    """Buckets and keys each car probes, with the folders behind them."""
    asked = settle(loc.questions(_targets(spark, sf)))
    counts = loc.retrieval_counts(asked.drop("car").dropDuplicates(["question"]), loc.bucket_tables(index(spark, sf)))
    return asked.select("car_id", "question").join(merged(counts), "question").select("car_id", "bucket", "key", "n_folders")


def compare_fields(spark, sf):
    """All field verdicts of one representative pair per model question and folder signature."""
    found = _located(spark, sf)
    one = found.targets.groupBy("d_fp", *loc._CODES).agg(F.min_by("car", "car_id").alias("left"), F.min("car_id").alias("car_id"))
    pairs = found.pairs.select("d_fp", *loc._CODES, F.col("one_path").alias("path")).join(merged(one), ["d_fp", *loc._CODES])
    lib = index(spark, sf).folders.select("path", F.col("car").alias("right"))
    both = pairs.join(merged(lib), "path")
    verdicts = cp.compare_cars(F.col("left"), F.col("right"))
    lines = cp.comparison_sentences(F.col("left"), F.col("right"))
    return both.select(
        "car_id", "path", *[v.alias(f) for f, v in verdicts.items()], cp.first_killer(verdicts).alias("killer"),
        lines["fuel"].alias("fuel_line"), lines["model_year"].alias("year_line"),
    )


def locate_messages(spark, sf):
    out = loc.messages(_located(spark, sf), "car_string")
    return out.select("car_id", "located_path", "outcome", "message")


QUERIES = {
    f.__name__: f
    for f in (
        locate, locate_with_aliases, locate_candidates, locate_rejects, prefix_rejects, retrieval_blocks, compare_fields,
        locate_messages,
    )
}


_Q = lambda c: f"concat('''', {c}, '''')"


def _code(state: str, value: str, raw: str) -> str:
    return f"CASE {state} WHEN 'silent' THEN '-' WHEN 'unparseable' THEN concat('?', {raw}) ELSE concat('=', {value}) END"


def _code_columns(t: str) -> str:
    return (
        f"CASE WHEN {t}.model_year IS NULL THEN '-' ELSE concat('=', {t}.model_year) END AS c_model_year, "
        + ", ".join(
            f"{_code(f'{t}.{st}', ps.fp(f'{t}.{v}'), ps.fp(f'{t}.raw') if st != 'name_state' else f'{t}.desig_fp')} AS c_{v}"
            for v, st in (("brand", "name_state"), ("model_head", "name_state"), ("trim", "name_state"), ("fuel", "fuel_state"), ("transmission", "transmission_state"))
        )
        + f", {_code(f'{t}.engine_state', f'CAST({t}.engine_l AS STRING)', ps.fp(f'{t}.engine_raw'))} AS c_engine_l"
    )


def _verdict(f: str, alias: bool) -> str:
    l, r = f"t.c_{f}", f"f.c_{f}"
    same = " ".join(
        f"WHEN {l} = '={a}' AND {r} = '={b}' THEN 'equal_via_alias'" for fld, a, b, _ in ALIASES if alias and fld == f
    )
    return (
        f"CASE WHEN starts_with({l}, '?') OR starts_with({r}, '?') THEN 'uncomparable' WHEN {l} = '-' AND {r} = '-' THEN 'both_silent' "
        f"WHEN {l} = '-' OR {r} = '-' THEN 'one_silent' WHEN {l} = {r} AND length({l}) > 1 THEN 'equal' {same} ELSE 'disagree' END"
    )


def _sql(alias: bool) -> str:
    killer = " ".join(f"WHEN {_verdict(f, alias)} = 'disagree' THEN '{f}'" for f in cp.CORROBORATORS)
    ext_alias = " ".join(
        f"AND NOT (t.tx = '{a}' AND v.e = '{b}')" for fld, a, b, _ in ALIASES if alias and fld == "exterior"
    )
    bad_e = f"(t.tx IS NOT NULL AND v.exterior_raw IS NOT NULL AND (t.tx <> v.e OR t.tx = '') {ext_alias})"
    bad_i = "(t.ti IS NOT NULL AND v.interior_raw IS NOT NULL AND (t.ti <> v.i OR t.ti = ''))"
    mark = lambda c: f"coalesce(nullif({c}, ''), 'silent')"
    ks = ", ".join(f"count(*) FILTER (WHERE killer = '{f}') AS k_{f}" for f in cp.CORROBORATORS)
    tally = "concat_ws(', ', CASE WHEN n_pool > n_same THEN concat(n_pool - n_same, ' on designation') END, " + ", ".join(
        f"CASE WHEN k_{f} > 0 THEN concat(k_{f}, ' on {f}') END" for f in cp.CORROBORATORS) + ")"
    specs = [f for f in cp.CORROBORATORS if f not in cp.NAME_FIELDS]
    failed = "concat_ws(', ', " + ", ".join(f"CASE WHEN k_{f} > 0 THEN '{f}' END" for f in specs) + ")"
    apart = "CASE " + " ".join(
        f"WHEN {'es' if f == 'exterior' else 'ins' if f == 'interior' else 'd_' + f} > 1 THEN '{f}'"
        for f in cp.ROLES if f in (*cp.CORROBORATORS, "exterior", "interior")) + " END"
    return f"""{with_clause('car_strings')}, {CRAWL}, {ps.car_ctes('car_strings', 'car_id', 'car_string', 'tc')},
t AS (SELECT car_id, desig_fp, brand_key, {ps.fp('raw')} AS raw_fp, designation, raw, exterior, interior,
    CASE WHEN exterior_state = 'stated' THEN {ps.fp('exterior')} END AS tx, CASE WHEN interior_state = 'stated' THEN {ps.fp('interior')} END AS ti,
    {_code_columns('tc')} FROM tc),
f AS (SELECT path, name, desig_fp, brand_key, {_code_columns('folders')} FROM folders),
v AS (SELECT *, {ps.fp('exterior_raw')} AS e, {ps.fp('interior_raw')} AS i FROM variants),
st AS (SELECT DISTINCT folder_path AS path, unnest([{ps.fp("regexp_replace(name, '^(.+)\\.[^.]*$', '\\1')")},
    {ps.fp("regexp_replace(regexp_replace(name, '^(.+)\\.[^.]*$', '\\1'), '(?i)[\\s.\\-]*(?:no|with\\s*out)\\s+logo\\s*$', '')")}]) AS k FROM sheets),
hits AS (SELECT t.car_id, f.path, 'designation_fingerprint' AS bucket, t.desig_fp AS key FROM t JOIN f ON f.desig_fp = t.desig_fp AND t.desig_fp <> ''
    UNION SELECT t.car_id, f.path, 'brand_token', t.brand_key FROM t JOIN f ON f.brand_key = t.brand_key AND t.brand_key <> ''
    UNION SELECT t.car_id, st.path, 'sheet_filename_stem', k FROM t JOIN st ON k = t.raw_fp AND k <> ''
    UNION SELECT t.car_id, st.path, 'sheet_filename_stem', k FROM t JOIN st ON k = t.desig_fp AND k <> ''),
pool AS (SELECT DISTINCT car_id, path FROM hits),
pv AS (SELECT t.car_id, f.path, f.desig_fp = t.desig_fp AS same, CASE WHEN f.desig_fp <> t.desig_fp THEN 'designation' {killer} END AS killer
    FROM pool JOIN t ON t.car_id = pool.car_id JOIN f ON f.path = pool.path),
m AS (SELECT car_id, count(*) AS n_pool, count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE killer IS NULL) AS n_surv, {ks} FROM pv GROUP BY car_id),
vb AS (SELECT t.car_id, v.folder_path, v.path, v.e, v.i, v.exterior_raw IS NULL AS mute, {bad_e} AS be, {bad_i} AS bi
    FROM pv JOIN t ON t.car_id = pv.car_id JOIN v ON v.folder_path = pv.path WHERE killer IS NULL),
fk AS (SELECT pv.car_id, pv.path, count(vb.path) AS nv, count(vb.path) FILTER (WHERE NOT (be OR bi)) AS ok,
    list_sort(list_distinct(list({mark('vb.e')}))) AS eset, list_sort(list_distinct(list({mark('vb.i')}))) AS iset
    FROM pv LEFT JOIN vb ON vb.car_id = pv.car_id AND vb.folder_path = pv.path WHERE killer IS NULL GROUP BY pv.car_id, pv.path),
kp AS (SELECT fk.*, CASE WHEN nv = 0 THEN ['none'] ELSE eset END AS es1, CASE WHEN nv = 0 THEN ['none'] ELSE iset END AS is1 FROM fk WHERE nv = 0 OR ok > 0),
kn AS (SELECT kp.car_id, count(*) AS n_kept, min(kp.path) AS kept_path, count(DISTINCT es1) AS es, count(DISTINCT is1) AS ins,
    {", ".join(f"count(DISTINCT f.c_{x}) AS d_{x}" for x in cp.CORROBORATORS)} FROM kp JOIN f ON f.path = kp.path GROUP BY kp.car_id),
mm AS (SELECT t.car_id, t.desig_fp, coalesce(m.n_pool, 0) AS n_pool, coalesce(m.n_same, 0) AS n_same, coalesce(m.n_surv, 0) AS n_surv,
    {", ".join(f"coalesce(m.k_{x}, 0) AS k_{x}" for x in cp.CORROBORATORS)}, coalesce(n_kept, 0) AS n_kept, {apart} AS apart,
    CASE WHEN m.n_surv = 1 THEN (SELECT min(path) FROM pv WHERE pv.car_id = t.car_id AND killer IS NULL) WHEN m.n_surv > 1 AND n_kept = 1 THEN kept_path END AS fp
    FROM t LEFT JOIN m ON m.car_id = t.car_id LEFT JOIN kn ON kn.car_id = t.car_id),
vs AS (SELECT mm.car_id, count(vb.path) AS n_variants, count(vb.path) FILTER (WHERE NOT (be OR bi)) AS n_v, min(vb.path) FILTER (WHERE NOT (be OR bi)) AS v_path,
    count(DISTINCT {mark('vb.e')}) FILTER (WHERE NOT (be OR bi)) AS de, count(DISTINCT {mark('vb.i')}) FILTER (WHERE NOT (be OR bi)) AS di,
    bool_and(NOT be) FILTER (WHERE vb.path IS NOT NULL) AS only_int
    FROM mm LEFT JOIN vb ON vb.car_id = mm.car_id AND vb.folder_path = mm.fp WHERE fp IS NOT NULL GROUP BY mm.car_id),
sg AS (SELECT mm.*, coalesce(n_variants, 0) AS n_variants, coalesce(n_v, 0) AS n_v, v_path, de, di, only_int,
    CASE WHEN n_pool = 0 THEN 'nothing_offered' WHEN n_surv = 0 AND desig_fp = '' THEN 'nameless'
      WHEN n_surv = 0 AND {" + ".join(f"k_{x}" for x in specs)} = 0 THEN 'no_such_name' WHEN n_surv = 0 THEN 'spec_differs'
      WHEN n_surv > 1 AND n_kept = 0 THEN 'no_folder_in_colour' WHEN n_surv > 1 AND n_kept > 1 THEN 'several_folders'
      WHEN coalesce(n_variants, 0) = 0 THEN 'no_variants' WHEN n_v = 0 THEN 'no_variant_in_colour' WHEN n_v > 1 THEN 'several_variants' ELSE 'matched' END AS stage
    FROM mm LEFT JOIN vs ON vs.car_id = mm.car_id),
located AS (SELECT car_id, CASE WHEN stage = 'matched' THEN 'matched' WHEN starts_with(stage, 'several') THEN 'ambiguous' ELSE 'absent' END AS outcome, stage,
    CASE WHEN stage IN ('nothing_offered', 'no_such_name') THEN 'add_folder' WHEN stage = 'nameless' THEN 'name_the_car' WHEN stage = 'spec_differs' THEN 'confirm_field'
      WHEN starts_with(stage, 'several') THEN 'pick_one_of' WHEN stage <> 'matched' THEN 'photograph_variant' END AS remedy_code,
    fp AS folder_path, CASE WHEN stage = 'matched' THEN v_path END AS variant_path,
    CASE WHEN stage = 'matched' THEN CASE WHEN n_variants = 1 THEN 'sole_variant' ELSE 'colour_unique' END END AS basis,
    CASE stage WHEN 'several_folders' THEN coalesce(apart, 'exterior') WHEN 'several_variants' THEN CASE WHEN de > 1 THEN 'exterior' WHEN di > 1 THEN 'interior' ELSE 'exterior' END END AS discriminator,
    CASE stage WHEN 'several_folders' THEN apart IS NOT NULL WHEN 'several_variants' THEN de > 1 OR di > 1 END AS separable,
    CASE WHEN stage = 'no_variant_in_colour' THEN CASE WHEN only_int THEN 'interior' ELSE 'exterior' END END AS failed_colour,
    CASE stage WHEN 'several_folders' THEN n_kept WHEN 'several_variants' THEN n_v ELSE 0 END AS n_candidates,
    n_pool, n_same, n_surv, {tally} AS tally, {failed} AS failed_specs, n_kept, n_variants FROM sg)"""


def _compared() -> str:
    """One car of each (designation, codes) against one folder of each, field by field; folders state no colour."""
    extra = lambda t, folder: ", ".join(
        f"'-' AS c_{f}" if folder else _code(f"{t}.{f}_state", ps.fp(f"{t}.{f}"), ps.fp(f"{t}.raw")) + f" AS c_{f}" for f in ("exterior", "interior")
    ) + f", CASE WHEN {t}.vin_tag IS NULL THEN '-' ELSE concat('=', {ps.fp(f'{t}.vin_tag')}) END AS c_vin_tag"
    codes = ", ".join(f"c_{f}" for f in cp.CORROBORATORS)
    verdicts = ", ".join(f"{_verdict(f, False)} AS {f}" for f in cp.COMPARED)
    killer = " ".join(f"WHEN {_verdict(f, False)} = 'disagree' THEN '{f}'" for f in cp.CORROBORATORS)
    line = lambda field, raw: (
        f"CASE {_verdict(field, False)} WHEN 'equal' THEN concat('{field}: ', {_Q('t.' + raw)}) WHEN 'disagree' THEN concat('{field}: ', {_Q('t.' + raw)}, ' vs ', {_Q('f.' + raw)}) "
        f"WHEN 'one_silent' THEN concat('{field}: only one side states it (', {_Q(f'coalesce(t.{raw}, f.{raw})')}, ')') WHEN 'both_silent' THEN '{field}: neither side states it' ELSE '{field}: could not be read' END"
    )
    return f"""ct AS (SELECT car_id, desig_fp, fuel, year_raw, {_code_columns('tc')}, {extra('tc', False)} FROM tc WHERE desig_fp <> ''),
      cf AS (SELECT path, desig_fp, fuel, year_raw, {_code_columns('folders')}, {extra('folders', True)} FROM folders),
      t1 AS (SELECT * FROM ct WHERE car_id IN (SELECT min(car_id) FROM ct GROUP BY desig_fp, {codes})),
      f1 AS (SELECT * FROM cf WHERE path IN (SELECT min(path) FROM cf GROUP BY desig_fp, {codes}))
      SELECT t.car_id, f.path, 'equal' AS designation, {verdicts}, CASE {killer} END AS killer, {line('fuel', 'fuel')} AS fuel_line, {line('model_year', 'year_raw')} AS year_line
      FROM t1 t JOIN f1 f ON f.desig_fp = t.desig_fp"""


_PLAIN = _sql(False)
_NAME = "regexp_extract(l.folder_path, '([^/]*)$', 1)"
_COLOUR = lambda f: f"CASE tc.{f}_state WHEN 'stated' THEN {_Q('tc.' + f)} WHEN 'unparseable' THEN 'x' ELSE 'a colour the feed does not state' END"
_COLS = ", ".join(_OUT)

ORACLES = {
    "locate": f"WITH {_PLAIN} SELECT {_COLS} FROM located",
    "locate_with_aliases": f"WITH {_sql(True)} SELECT {_COLS} FROM located",
    "locate_candidates": f"""WITH {_PLAIN} SELECT DISTINCT l.stage, t.desig_fp AS d_fp, kp.path AS folder_path, NULL AS variant_path FROM located l JOIN t ON t.car_id = l.car_id
        JOIN kp ON kp.car_id = l.car_id WHERE stage = 'several_folders'
      UNION ALL SELECT DISTINCT l.stage, t.desig_fp, l.folder_path, vb.path FROM located l JOIN t ON t.car_id = l.car_id
        JOIN vb ON vb.car_id = l.car_id AND vb.folder_path = l.folder_path WHERE stage = 'several_variants' AND NOT (be OR bi)""",
    "locate_rejects": f"""WITH {_PLAIN}, codes AS (SELECT DISTINCT desig_fp, {', '.join(f"CASE WHEN starts_with(c_{x}, '?') THEN '?' ELSE c_{x} END AS c_{x}" for x in cp.CORROBORATORS)} FROM t WHERE desig_fp <> ''),
      fs AS (SELECT desig_fp, {', '.join(f'c_{x}' for x in cp.CORROBORATORS)}, count(*) AS n FROM f GROUP BY ALL),
      pr AS (SELECT t.desig_fp AS d_fp, n, CASE {" ".join(f"WHEN {_verdict(x, False)} = 'disagree' THEN '{x}'" for x in cp.CORROBORATORS)} END AS killer FROM codes t JOIN fs f ON f.desig_fp = t.desig_fp)
      SELECT d_fp, killer AS failed_on, count(*) AS n_signature_pairs, sum(n) AS n_folders FROM pr WHERE killer IS NOT NULL GROUP BY d_fp, killer""",
    "prefix_rejects": f"""WITH {_PLAIN}, a AS (SELECT DISTINCT desig_fp, brand_key FROM t WHERE desig_fp <> '' AND brand_key <> ''),
      b AS (SELECT desig_fp, brand_key, count(*) AS n FROM f GROUP BY ALL)
      SELECT a.desig_fp AS d_fp, b.desig_fp AS folder_fp, n AS n_folders FROM a JOIN b ON b.brand_key = a.brand_key AND a.desig_fp <> b.desig_fp
        AND (starts_with(a.desig_fp, b.desig_fp) OR starts_with(b.desig_fp, a.desig_fp))""",
    "retrieval_blocks": f"WITH {_PLAIN} SELECT car_id, bucket, key, count(*) AS n_folders FROM hits GROUP BY car_id, bucket, key",
    "compare_fields": f"WITH {_PLAIN}, {_compared()}",
    "locate_messages": f"""WITH {_PLAIN} SELECT l.car_id, variant_path AS located_path, outcome, CASE WHEN outcome <> 'matched' THEN concat(CASE WHEN outcome = 'ambiguous' THEN concat(c.car_string, ' matches ', n_candidates, ' folders and nothing separates them. The field that would settle it is ''', discriminator, '''') WHEN outcome = 'absent' THEN concat('No folder for ', c.car_string, ': ',
        CASE stage WHEN 'nothing_offered' THEN 'no model folder was offered for comparison'
          WHEN 'nameless' THEN concat({_Q("coalesce(nullif(tc.raw, ''), '(empty)')")}, ' states no name to match on, so every one of the ', n_pool, ' folders considered failed the designation gate')
          WHEN 'no_such_name' THEN concat('no folder is named for ', {_Q('tc.designation')}, '; ', n_pool, ' considered, ', tally)
          WHEN 'spec_differs' THEN concat('the library holds ', {_Q('tc.designation')}, ' but no folder agrees on ', failed_specs, '; ', n_pool, ' considered, ', tally)
          WHEN 'no_folder_in_colour' THEN concat(n_surv, ' folders match this specification but none holds a variant in ', {_COLOUR('exterior')})
          WHEN 'no_variants' THEN concat({_Q(_NAME)}, ' holds no variant folders, so there is no colour to resolve')
          ELSE concat({_Q(_NAME)}, ' is the right model, but none of its ', n_variants, ' variants is ',
            CASE WHEN failed_colour = 'interior' THEN {_COLOUR('interior')} ELSE {_COLOUR('exterior')} END) END) END, '. Remedy: ', remedy_code, ': ',
        CASE WHEN outcome = 'ambiguous' AND separable THEN concat('state the ', discriminator, ' of this car, or let a reviewer choose')
          WHEN outcome = 'ambiguous' THEN 'a reviewer has to open the folders and choose, one car may be filed twice'
          WHEN stage = 'nothing_offered' THEN 'look over the shortlist, then add a folder if the library lacks this car'
          WHEN stage = 'nameless' THEN 'give a code or description that names the car'
          WHEN stage = 'no_such_name' THEN concat('add a folder for ', {_Q('tc.designation')}, ', or record the spelling under which the library holds it')
          WHEN stage = 'spec_differs' THEN concat('check ', failed_specs, ' on the vehicle')
          ELSE 'photograph this colour, or check the colour on the vehicle' END) END AS message
      FROM located l JOIN car_strings c ON c.car_id = l.car_id JOIN tc ON tc.car_id = l.car_id""",
}
