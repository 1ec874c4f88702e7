"""Registered queries over the library crawl and its listing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotledger.functions import text as tx
from lotledger.operators import freshness, library
from lotledger.plans import parse_sql as ps
from lotledger.plans.derive import table, with_clause
from lotledger.session import merged, settle, shared_dir, small_tasks
from lotledger.sources import index_store


_SAVED: dict[tuple, object] = {}


def _saved(spark, sf, what, build):
    """One settled copy per session and data set, as a saved index would be."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _SAVED:
        _SAVED[key] = build()
    return _SAVED[key]


def entries(spark, sf):
    return _saved(spark, sf, "entries", lambda: _listed(spark, sf))


def _listed(spark, sf):
    with small_tasks(spark, table(spark, sf, "lineitem").count()):
        return settle(table(spark, sf, "library_entries"))


def _fresh(spark, sf):
    lib = library.crawl(entries(spark, sf))
    return library.Library(*[settle(t) for t in (lib.folders, lib.variants, lib.sheets)], lib.drift)


def index(spark, sf):
    return _saved(spark, sf, "index", lambda: _fresh(spark, sf))


def library_folders(spark, sf):
    """A fresh crawl; the other queries read the index it leaves behind."""
    lib = _fresh(spark, sf)
    _SAVED[(spark.sparkContext.applicationId, sf, "index")] = lib
    n = lib.variants.groupBy(F.col("folder_path").alias("path")).agg(
        F.count("*").alias("n_variants"), F.sum("photo_count").alias("n_photos"), F.sum("n_sheets").alias("n_sheets")
    )
    return (
        lib.folders.join(merged(n), "path", "left")
        .fillna(0, ["n_variants", "n_photos", "n_sheets"])
        .select(
            "path", "name", F.col("car.designation.fingerprint").alias("desig_fp"), F.array_join("path_segments", "/").alias("segments"),
            "body_type_hint", "n_variants", "n_photos", "n_sheets",
        )
    )


def library_variants(spark, sf):
    return index(spark, sf).variants


def library_sheets(spark, sf):
    return index(spark, sf).sheets


def library_reloaded(spark, sf):
    """The variants of the index after it was saved and loaded again."""
    path = f"{shared_dir(spark)}/index/{uuid.uuid4().hex}"
    index_store.save_index(index(spark, sf), path, "library", "none", F.lit("2026-01-01"))
    return index_store.load_index(spark, path)[0].variants


def library_drift(spark, sf):
    d = index(spark, sf).drift
    return d.select("kind", "subject", F.md5(library.drift_line(F.col("kind"), F.col("subject"), F.col("note"))).alias("line_md5"))


def library_counts(spark, sf):
    return library.index_counts(index(spark, sf))


def folder_index(spark, sf):
    index, pdfs = library.folder_index(entries(spark, sf))
    named = pdfs.groupBy("path").agg(F.min("pdf_name").alias("first_pdf"), F.max("pdf_name").alias("last_pdf"))
    return index.join(merged(named), "path", "left").select("path", F.size("segments").alias("depth"), "n_pdfs", "image_count", "first_pdf", "last_pdf")


def tree_fingerprint(spark, sf):
    """Count, sum and xor of a line hash that other engines have too (a digest's first 60 bits)."""
    listing = entries(spark, sf)
    line = freshness.entry_line(F.col("path"), F.col("is_dir"), F.col("size"), F.col("mtime_ns"))
    digest = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")
    return freshness.tree_fingerprint(listing, digest).select("n_entries", F.col("hash_sum").cast("string").alias("hash_sum"), "hash_xor")


def library_freshness(spark, sf):
    """The listing against itself, against a changed copy, and under other roots."""
    listing = entries(spark, sf)
    now = settle(freshness.tree_fingerprint(listing))
    changed = settle(freshness.tree_fingerprint(listing.withColumn("size", F.col("size") + (F.col("name") == "Thumbs.db").cast("int"))))
    meta = now.select("fingerprint", F.lit("/srv/lib").alias("root"), F.col("n_entries").alias("n_folders"), F.lit("2026-01-01").alias("crawled_at"))
    cases = (
        ("same", meta, "/srv/LIB/", now), ("changed", meta, "/srv/lib", changed), ("other_root", meta, "/srv/li", now),
        ("empty", meta.withColumn("n_folders", F.lit(0)), "/srv/lib", now),
    )
    out = None
    for name, m, root, current in cases:
        one = freshness.check(m, F.lit(root), current).select(F.lit(name).alias("case_name"), "state", "root_mismatch", "remedy")
        out = one if out is None else out.unionByName(one)
    return out


def car_files(spark, sf):
    listing = entries(spark, sf)
    folders = index(spark, sf).folders.select(F.col("path").alias("folder_path"))
    return library.car_files(listing, folders).select("folder_path", "kind", "relative_path", "size", "rank")


def colour_siblings(spark, sf):
    lib = index(spark, sf)
    variants = lib.variants.select("path")
    return library.colour_options(variants, variants)


QUERIES = {
    f.__name__: f
    for f in (
        library_folders, library_variants, library_reloaded, library_sheets, library_drift, library_counts, folder_index,
        tree_fingerprint, library_freshness, car_files, colour_siblings,
    )
}

_PHOTO = ps.quoted(library.PHOTO_SUFFIXES)
_SUFFIX = "lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1))"


def above(path: str, own: bool) -> str:
    """Ancestor paths of a path as a list."""
    return (
        f"list_transform(range(1, len(string_split({path}, '/')) + {1 if own else 0}), "
        f"lambda i: array_to_string(string_split({path}, '/')[1:i], '/'))"
    )


CRAWL = f"""{with_clause('library_entries')},
files AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {_SUFFIX} AS sfx,
    NOT (lower(name) IN ({ps.quoted(library.LITTER_NAMES)}) OR {_SUFFIX} IN ({ps.quoted(library.LITTER_SUFFIXES)})) AS useful FROM library_entries),
dirs0 AS (SELECT DISTINCT unnest({above('path', False)}) AS path FROM library_entries),
dirs AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM dirs0),
{ps.car_ctes('dirs', 'path', 'name', 'dcar')}, {ps.leaf_ctes('dirs', 'path', 'name', 'dleaf')},
d AS (SELECT dirs.*, c.* EXCLUDE (path), l.exterior AS ext_raw, l.interior AS int_raw, l.vin_tag AS tag,
    dirs.path IN (SELECT parent FROM dirs) AS has_dirs FROM dirs JOIN dcar c ON c.path = dirs.path JOIN dleaf l ON l.path = dirs.path),
cand AS (SELECT * FROM d WHERE ok AND path NOT IN (SELECT parent FROM d WHERE ok AND has_dirs AND ext_raw IS NULL)),
folders AS (SELECT * FROM cand WHERE NOT list_has_any({above('path', False)}, (SELECT list(path) FROM cand))),
variants AS (SELECT d.path, d.parent AS folder_path, d.name, d.ext_raw AS exterior_raw, d.int_raw AS interior_raw, d.tag AS vin_tag,
    coalesce(p, 0) AS photo_count, coalesce(s, 0) AS n_sheets FROM d JOIN folders f ON f.path = d.parent LEFT JOIN
    (SELECT parent, count(*) FILTER (WHERE useful AND sfx IN ({_PHOTO})) AS p, count(*) FILTER (WHERE useful AND sfx = '.pdf') AS s FROM files GROUP BY parent) n ON n.parent = d.path),
uc AS (SELECT parent AS path, count(*) AS n FROM files WHERE useful GROUP BY parent),
inside AS (SELECT path FROM d WHERE list_has_any({above('path', True)}, (SELECT list(path) FROM folders))),
sheets AS (SELECT files.path, parent AS variant_path, v.folder_path, files.name, size FROM files JOIN variants v ON v.path = parent WHERE useful AND sfx = '.pdf'),
dead AS (SELECT path FROM d WHERE path NOT IN (SELECT path FROM inside)
    AND path IN (SELECT unnest({above('path', True)}) FROM uc) AND path NOT IN (SELECT unnest({above('path', True)}) FROM folders))"""
_DRIFT = f"""
    SELECT 'loose-file' AS kind, f.path AS subject, concat('loose-file: ', f.path, ' — ', n, ' file(s) sit in the model folder itself, outside any variant, so no colour owns them') AS line FROM folders f JOIN uc ON uc.path = f.path
    UNION ALL SELECT 'variant-colours', path, concat('variant-colours: ', path, ' — ', '{library.NO_COLOURS.replace("'", "''")}') FROM variants WHERE exterior_raw IS NULL
    UNION ALL SELECT 'below-variant', path, concat('below-variant: ', path, ' — a directory inside a variant folder; its contents are not indexed') FROM d WHERE parent IN (SELECT path FROM variants)
    UNION ALL SELECT 'unknown-file', path, concat('unknown-file: ', path, ' — extension ', coalesce(nullif(sfx, ''), '(none)'), ' is neither a photograph nor a spec sheet')
      FROM files WHERE useful AND sfx <> '.pdf' AND sfx NOT IN ({_PHOTO}) AND parent IN (SELECT path FROM variants)
    UNION ALL SELECT 'car-name', d.path, concat('car-name: ', d.path, ' — ', n, ' file(s) sit here but the folder name does not parse as a car, so nothing in it can be matched')
      FROM d JOIN uc ON uc.path = d.path WHERE d.path NOT IN (SELECT path FROM inside)
    UNION ALL SELECT 'dead-branch', path, concat('dead-branch: ', path, ' — holds files but no folder beneath it parses as a car') FROM dead
      WHERE NOT list_has_any({above('path', False)}, (SELECT list(path) FROM dead))
    UNION ALL SELECT 'token', m, concat('token: ', m, ' — in ', path) FROM (SELECT path, concat('"', replace(concat('model folder name states colour ''', CASE WHEN exterior = interior THEN exterior ELSE concat_ws(' / ', exterior, interior) END,
        '''; ignored, because the variant folders below it hold the colour that was actually photographed'), '\\', '\\\\'), '"') AS m FROM folders WHERE exterior IS NOT NULL)"""

ORACLES = {
    "library_folders": f"""WITH {CRAWL} SELECT f.path, f.name, desig_fp, array_to_string(string_split(f.path, '/')[1:-2], '/') AS segments,
      list_filter(list_transform(string_split(f.path, '/')[1:-2], lambda x: upper(trim(x))), lambda x: x IN ({ps.quoted(library.BODY_TYPES)}))[1] AS body_type_hint,
      coalesce(nv, 0) AS n_variants, coalesce(np, 0) AS n_photos, coalesce(ns, 0) AS n_sheets FROM folders f LEFT JOIN
      (SELECT folder_path, count(*) AS nv, sum(photo_count) AS np, sum(n_sheets) AS ns FROM variants GROUP BY folder_path) v ON v.folder_path = f.path""",
    "library_variants": f"WITH {CRAWL} SELECT * FROM variants",
    "library_reloaded": f"WITH {CRAWL} SELECT * FROM variants",
    "library_sheets": f"WITH {CRAWL} SELECT * FROM sheets",
    "library_drift": f"WITH {CRAWL} SELECT DISTINCT kind, subject, md5(line) AS line_md5 FROM ({_DRIFT})",
    "library_counts": f"""WITH {CRAWL} SELECT (SELECT count(*) FROM folders) AS folders, count(*) AS variants, sum(n_sheets) AS sheets, sum(photo_count) AS photos FROM variants""",
    "folder_index": f"""WITH {with_clause('library_entries')}, f AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, name LIKE '%.pdf' AS pdf,
        {_SUFFIX} IN ({ps.quoted(library.IMAGE_SUFFIXES)}) AS image FROM library_entries)
      SELECT parent AS path, len(string_split(parent, '/')) AS depth, count(*) FILTER (WHERE pdf) AS n_pdfs, count(*) FILTER (WHERE image) AS image_count,
        min(name) FILTER (WHERE pdf) AS first_pdf, max(name) FILTER (WHERE pdf) AS last_pdf FROM f WHERE (pdf OR image) AND parent <> '' GROUP BY parent""",
    "tree_fingerprint": f"""WITH {with_clause('library_entries')}, h AS (SELECT ('0x' || md5(concat_ws(chr(31), path, CASE WHEN is_dir THEN 'd' ELSE 'f' END,
        CASE WHEN is_dir THEN '' ELSE CAST(size AS STRING) END, CASE WHEN is_dir THEN '' ELSE CAST(mtime_ns AS STRING) END))[1:15])::BIGINT AS h FROM library_entries)
      SELECT count(*) AS n_entries, CAST(sum(h) AS STRING) AS hash_sum, bit_xor(h) AS hash_xor FROM h""",
    "library_freshness": f"""WITH {with_clause('library_entries')}, n AS (SELECT count(*) FILTER (WHERE name = 'Thumbs.db') AS k FROM library_entries)
      SELECT 'same' AS case_name, 'fresh' AS state, false AS root_mismatch, '' AS remedy UNION ALL
      SELECT 'changed', CASE WHEN k > 0 THEN 'stale' ELSE 'fresh' END, false, CASE WHEN k > 0 THEN 'recrawl the library' ELSE '' END FROM n UNION ALL
      SELECT 'other_root', 'stale', true, 'point the configuration back at the library the index describes, or recrawl against this one; do NOT answer lookups from this index' UNION ALL
      SELECT 'empty', 'stale', false, 'recrawl; an empty index is never a valid description of this library'""",
    "car_files": f"""WITH {CRAWL}, x AS (SELECT f.path AS folder_path, e.path, e.size, CASE WHEN {_SUFFIX.replace('name', 'e.name')} = '.pdf' THEN 'pdf' ELSE 'photo' END AS kind
        FROM folders f JOIN library_entries e ON starts_with(e.path, f.path || '/') WHERE {_SUFFIX.replace('name', 'e.name')} IN ({ps.quoted(library.IMAGE_SUFFIXES + ('.pdf',))}))
      SELECT folder_path, kind, substr(path, length(folder_path) + 2) AS relative_path, size,
        CASE WHEN kind = 'photo' THEN row_number() OVER (PARTITION BY folder_path, kind ORDER BY path) END AS rank FROM x""",
    "colour_siblings": f"""WITH {CRAWL}, {ps.leaf_ctes('variants', 'path', 'name', 'lv')}
      SELECT v.folder_path AS parent, v.path, v.name AS folder, lv.loose_exterior AS exterior, lv.loose_interior AS interior
      FROM variants v JOIN lv ON lv.path = v.path WHERE lv.loose_exterior IS NOT NULL""",
}
