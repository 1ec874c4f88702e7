"""From a file listing to a library of model folders, variants and sheets.

Classification is a handful of joins on paths; every per-directory count is an
aggregate, so directories with very many children do not gather anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotledger.functions import carkey, leaf
from lotledger.functions import text as tx
from lotledger.session import merged, settle
from lotledger.sources.entries import ancestors, directories

# File classes of the library.
PHOTO_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".gif", ".bmp",
    ".tif", ".tiff", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".orf",
)
SHEET_SUFFIXES = (".pdf",)
LITTER_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")
LITTER_SUFFIXES = (".ini", ".db", ".tmp", ".lnk", ".url")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".bmp")
BODY_TYPES = ("SEDAN", "SUV", "PICKUP", "BUS", "MPV", "CARGO VAN", "COUPE", "HATCHBACK")

# Fixed value: the note on a folder that states no colours.
NO_COLOURS = (
    "the folder name states no '<EXTERIOR> INSIDE <INTERIOR>' pair, so which colour is outside and "
    "which is inside is not recoverable from it; the variant is indexed and its photographs are usable, "
    "but it can never be told apart from a sibling by colour"
)


def is_useful(name: Column) -> Column:
    """Not sync or shell litter."""
    return ~(F.lower(name).isin(*LITTER_NAMES) | tx.file_suffix(name).isin(*LITTER_SUFFIXES))


def file_class(name: Column) -> Column:
    suffix = tx.file_suffix(name)
    return (
        F.when(~is_useful(name), F.lit("litter"))
        .when(suffix.isin(*SHEET_SUFFIXES), F.lit("sheet"))
        .when(suffix.isin(*PHOTO_SUFFIXES), F.lit("photo"))
        .otherwise("unknown")
    )


def body_type_hint(segments: Column) -> Column:
    """First path segment that names a known body type."""
    upper = F.transform(segments, lambda s: F.upper(tx.strip(s)))
    return F.get(F.filter(upper, lambda s: s.isin(*BODY_TYPES)), F.lit(0))


#: Rounds of pointer jumping in one job; each round reads the one before twice.
JUMPS_AT_ONCE = 3


@dataclass(frozen=True)
class Library:
    """Flat index tables.

    ``folders``: path, name, car, path_segments, body_type_hint ·
    ``variants``: path, folder_path, name, exterior_raw, interior_raw, vin_tag,
    photo_count, n_sheets · ``sheets``: path, variant_path, folder_path, name,
    size · ``drift``: kind, subject, note.
    """

    folders: DataFrame
    variants: DataFrame
    sheets: DataFrame
    drift: DataFrame


def classify_directories(
    entries: DataFrame, fold: bool = True, parser=carkey.parse_model_folders, parents: DataFrame | None = None
) -> DataFrame:
    """Directories with ``parent, name, car, leaf, folder_path, is_folder, inside``; ``inside``
    marks directories at or below a model folder, the one that ``folder_path`` names.
    ``parents``: see ``directories``."""
    dirs = settle(directories(entries, parents)).withColumn("name", tx.path_name(F.col("path"))).withColumn(
        "parent", tx.path_parent(F.col("path"))
    )
    # Names repeat across the tree far more than paths do: parse each once. The
    # text is folded once, below both parsers.
    names = dirs.select("name").distinct().withColumn("text", F.col("name"))
    names = tx.fold_nfkc(names, "text") if fold else names
    names = parser(leaf.parse_leaves(names, "text", "leaf", fold=False), "text", "car", False)
    dirs = settle(dirs.join(merged(settle(names.drop("text"))), "name"))
    holders = dirs.select(F.col("parent").alias("path")).distinct().withColumn("has_dirs", F.lit(True))
    is_car = carkey.parses_as_car(F.col("car"))
    shelves = (
        dirs.filter(is_car & F.col("leaf.exterior").isNull())
        .join(merged(holders), "path", "left_semi")
        .select(F.col("parent").alias("path"))
        .distinct()
    )
    marked = dirs.join(merged(shelves.withColumn("__shelf", F.lit(True))), "path", "left").select(
        "path", F.nullif("parent", F.lit("")).alias("up"), F.when(is_car & F.col("__shelf").isNull(), F.col("path")).alias("top")
    )
    tops = topmost(marked).withColumnRenamed("top", "folder_path")
    return dirs.join(merged(tops), "path").withColumns(
        {"is_folder": F.coalesce(F.col("folder_path") == F.col("path"), F.lit(False)), "inside": F.col("folder_path").isNotNull()}
    )


def topmost(tree: DataFrame) -> DataFrame:
    """``(path, top)``: the highest of the marks on the way from each node to its root.

    ``tree``: ``path, up`` (null at the top) and ``top``, the node's own mark or null. Pointers
    jump: a round joins each node with the one its pointer has reached, takes over that one's mark
    and its pointer, and so doubles the way it has seen. A tree of depth n takes log n rounds, however
    many nodes hang on one parent.
    """
    depth = tree.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    for n in range((depth - 1).bit_length()):
        if n and n % JUMPS_AT_ONCE == 0:
            tree = settle(tree)
        reached = tree.select(F.col("path").alias("__at"), F.col("up").alias("__up"), F.col("top").alias("__top"))
        # Nodes that are done have no pointer; each goes to its own place, not all to one.
        met = (F.coalesce("up", "path") == F.col("__at")) & F.col("up").isNotNull()
        tree = tree.join(merged(reached), met, "left").select("path", F.col("__up").alias("up"), F.coalesce("__top", "top").alias("top"))
    return tree.select("path", "top")


def crawl(entries: DataFrame, fold: bool = True, parser=carkey.parse_model_folders) -> Library:
    """Classify directories as model folders or shelves; index variants and sheets;
    report drift."""
    files = entries.filter("NOT is_dir").withColumn("parent", tx.path_parent(F.col("path"))).withColumn(
        "class", file_class(F.col("name"))
    )
    counts = settle(
        files.groupBy(F.col("parent").alias("path")).agg(
            F.count_if(F.col("class") != "litter").alias("n_useful"), F.count_if(F.col("class") == "photo").alias("photo_count"),
            F.count_if(F.col("class") == "sheet").alias("n_sheets"),
        )
    )
    dirs = settle(classify_directories(entries, fold, parser, counts.select("path")))
    useful = counts.filter("n_useful > 0").select("path", "n_useful")
    segments = F.split("path", "/")
    folders = dirs.filter("is_folder").select(
        "path", "name", "car", F.slice(segments, F.lit(1), F.size(segments) - 1).alias("path_segments")
    ).withColumn("body_type_hint", body_type_hint(F.col("path_segments")))
    leaves = dirs.filter(F.col("parent") == F.col("folder_path")).select(
        "path", "folder_path", "name",
        F.col("leaf.exterior").alias("exterior_raw"), F.col("leaf.interior").alias("interior_raw"), "leaf.vin_tag",
    )
    owned = files.join(merged(leaves.select(F.col("path").alias("parent"), "folder_path")), "parent")
    variants = leaves.join(merged(counts.drop("n_useful")), "path", "left").fillna(0, ["photo_count", "n_sheets"])
    sheets = owned.filter("class = 'sheet'").select(
        "path", F.col("parent").alias("variant_path"), "folder_path", "name", "size"
    )
    drift = _drift(dirs, folders, leaves, owned, useful)
    return Library(folders, variants, sheets, drift)


def _drift(dirs: DataFrame, folders: DataFrame, leaves: DataFrame, owned: DataFrame, useful: DataFrame) -> DataFrame:
    def lines(df: DataFrame, kind: str, subject: Column, note: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), subject.alias("subject"), note.alias("note"))

    path = F.col("path")
    n_files = F.concat(F.col("n_useful").cast("string"), F.lit(" file(s) sit "))
    suffix = tx.file_suffix(F.col("name"))
    shelves = dirs.filter("NOT inside").select("path")
    with_files = useful.filter("path != ''").select(
        F.explode(ancestors(path, own=True)).alias("path")
    ).distinct()
    with_cars = folders.select(F.explode(ancestors(path, own=True)).alias("path")).distinct()
    dead = shelves.join(merged(with_files), "path", "left_semi").join(merged(with_cars), "path", "left_anti")
    # What lies between a dead branch and a dead one above it is dead as well.
    shallowest = dead.withColumn("parent", tx.path_parent(path)).join(merged(dead.select(path.alias("parent"))), "parent", "left_anti")
    parts = [
        lines(
            folders.select("path", F.explode("car.unresolved").alias("fragment")),
            "token", tx.quoted(F.col("fragment")), F.concat(F.lit("in "), path),
        ),
        lines(
            folders.join(merged(useful), "path"), "loose-file", path,
            F.concat(n_files, F.lit("in the model folder itself, outside any variant, so no colour owns them")),
        ),
        lines(leaves.filter("exterior_raw IS NULL"), "variant-colours", path, F.lit(NO_COLOURS)),
        lines(
            dirs.join(merged(leaves.select(path.alias("parent"))), "parent", "left_semi"), "below-variant", path,
            F.lit("a directory inside a variant folder; its contents are not indexed"),
        ),
        lines(
            owned.filter("class = 'unknown'"), "unknown-file", path,
            F.concat(
                F.lit("extension "), F.when(suffix == "", F.lit("(none)")).otherwise(suffix),
                F.lit(" is neither a photograph nor a spec sheet"),
            ),
        ),
        lines(
            shelves.join(merged(useful), "path"), "car-name", path,
            F.concat(n_files, F.lit("here but the folder name does not parse as a car, so nothing in it can be matched")),
        ),
        lines(
            shallowest, "dead-branch", path,
            F.lit("holds files but no folder beneath it parses as a car"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def drift_line(kind: Column, subject: Column, note: Column) -> Column:
    return F.concat(kind, F.lit(": "), subject, F.when(note.isNotNull(), F.concat(F.lit(" — "), note)).otherwise(""))


def folder_index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(index, pdfs)``: directories directly holding PDFs or images, with counts,
    and their PDF names as rows. ``.pdf`` is matched in lower case only, images
    in any case. Files at the root belong to no directory."""
    files = entries.filter("NOT is_dir").withColumn("parent", tx.path_parent(F.col("path"))).filter("parent != ''")
    files = files.withColumn("pdf", F.col("name").endswith(".pdf")).withColumn(
        "image", tx.file_suffix(F.col("name")).isin(*IMAGE_SUFFIXES)
    )
    index = (
        files.filter("pdf OR image")
        .groupBy(F.col("parent").alias("path"))
        .agg(F.count_if("pdf").alias("n_pdfs"), F.count_if("image").alias("image_count"))
        .withColumn("segments", F.split("path", "/"))
    )
    return index, files.filter("pdf").select(F.col("parent").alias("path"), F.col("name").alias("pdf_name"))


def index_counts(library: Library) -> DataFrame:
    """Folder, variant, sheet and photo counts in one row."""
    return (
        library.folders.agg(F.count("*").alias("folders"))
        .withColumn("variants", library.variants.agg(F.count("*")).scalar())
        .withColumn("sheets", library.variants.agg(F.sum("n_sheets")).scalar())
        .withColumn("photos", library.variants.agg(F.sum("photo_count")).scalar())
    )


def car_files(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """All photos and PDFs below each folder, photos ranked by path from 1.

    ``folders``: ``folder_path``. A directory meets its folders by equality on its
    ancestors, never by a prefix comparison, and its files take over what it met.
    """
    suffix = tx.file_suffix(F.col("name"))
    kind = F.when(suffix.isin(*IMAGE_SUFFIXES), F.lit("photo")).when(suffix == ".pdf", F.lit("pdf"))
    files = (
        entries.filter("NOT is_dir")
        .withColumn("kind", kind)
        .filter("kind IS NOT NULL AND contains(path, '/')")
        .select("path", "name", "size", "kind", tx.path_parent(F.col("path")).alias("parent"))
    )
    held = (
        files.select("parent").distinct()
        .select("parent", F.explode(ancestors(F.col("parent"), own=True)).alias("folder_path"))
        .join(merged(folders.select("folder_path").distinct()), "folder_path")
    )
    below = (
        files.join(merged(held), "parent")
        .select("folder_path", "path", "name", "size", "kind")
        .withColumn("relative_path", F.expr("substring(path, length(folder_path) + 2)"))
    )
    by_path = Window.partitionBy("folder_path", "kind").orderBy("path")
    return below.withColumn("rank", F.when(F.col("kind") == "photo", F.row_number().over(by_path)))


def colour_options(folders: DataFrame, siblings: DataFrame) -> DataFrame:
    """Sibling folders whose names state both colours, per parent.

    Both sides: ``path``. Returns ``parent, path, folder, exterior, interior``
    for parents of ``folders``; a parent's options are rows, not an array.
    """
    named = siblings.withColumn("parent", tx.path_parent(F.col("path"))).withColumn("folder", tx.path_name(F.col("path")))
    stated = leaf.parse_folder_colours(named, "folder", "c").filter("c.exterior IS NOT NULL")
    wanted = folders.select(tx.path_parent(F.col("path")).alias("parent")).distinct()
    return stated.join(merged(wanted), "parent", "left_semi").select("parent", "path", "folder", "c.exterior", "c.interior")
