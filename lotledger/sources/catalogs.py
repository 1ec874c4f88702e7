"""Catalog payloads (JSON text) into flat option tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import text as tx

_ROW = (
    "struct<id:string,value:string,key:string,name:string,label:string,title:string,slug:string,parent:string,"
    "parent_feature:string,parent_specification:string,mandatory:boolean,status:string,aliases:array<string>>"
)
_NODE = _ROW[:-1]
_TREE = (
    f"array<{_NODE},children:array<{_NODE},children:array<{_ROW}>,trims:array<{_ROW}>,models:array<{_ROW}>>>,"
    f"models:array<{_NODE},children:array<{_ROW}>,trims:array<{_ROW}>,models:array<{_ROW}>>>,"
    f"trims:array<{_NODE},children:array<{_ROW}>,trims:array<{_ROW}>,models:array<{_ROW}>>>>>"
)


def _first(node: str, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"{node}.{k}"), F.lit("")) for k in keys], F.lit(""))


def _catalog(payloads: DataFrame, column: str, groups: str, rows: tuple[str, ...], parent_key: str):
    fields = ",".join([f"{groups}:array<{_ROW}>"] + [f"{r}:array<{_ROW}>" for r in rows])
    own = ["payload_id"] if "payload_id" in payloads.columns else []
    doc = payloads.select(*own, F.from_json(column, f"struct<{fields}>").alias("d"))
    parents = doc.select(*own, F.posexplode(f"d.{groups}").alias("ord", "g")).select(
        *own, _first("g", "name", "label").alias("name"), _first("g", "id").alias("parent_id"),
        F.coalesce("g.mandatory", F.lit(False)).alias("mandatory"), "ord",
    )
    listed = F.coalesce(*[F.when(F.size(f"d.{r}") > 0, F.col(f"d.{r}")) for r in rows])
    flat = doc.select(*own, F.posexplode(listed).alias("ord", "v")).select(
        *own, _first("v", "id").alias("id"), _first("v", "name", "label").alias("name"), _first("v", "slug").alias("slug"),
        _first("v", "parent", parent_key).alias("parent"), _first("v", "status").alias("status"), "ord",
    )
    ids = parents.groupBy(*own, F.col("name").alias("parent")).agg(F.max_by("parent_id", "ord").alias("parent_id"))
    return parents, flat.join(ids, [*own, "parent"], "left").fillna("", ["parent_id"])


def parse_feature_catalog(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``(groups, features)``. A ``payload_id`` keeps the groups of several payloads apart."""
    groups, rows = _catalog(payloads, column, "parent_features", ("features",), "parent_feature")
    return groups, rows.drop("status")


def parse_spec_catalog(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``(parents, values)``; only published values, a missing status counting as published."""
    parents, rows = _catalog(
        payloads, column, "parent_specifications", ("values", "specifications"), "parent_specification"
    )
    published = F.lower(F.coalesce(F.nullif("status", F.lit("")), F.lit("Published"))) == "published"
    return parents, rows.filter(published).drop("status")


def parse_taxonomy(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``level, id, name, aliases, parent_id, ord`` of three fixed levels. ``ord`` is
    the path of positions, padded so that it sorts as the payload lists. A node
    without an id gets one from this path; ``payload_id`` of the payloads, if there
    is such a column, keeps the paths of several payloads apart."""
    lead = F.concat(F.col("payload_id").cast("string"), F.lit(":")) if "payload_id" in payloads.columns else F.lit("")
    padded = lambda i: F.lpad(F.col(i).cast("string"), 9, "0")
    root = payloads.select(lead.alias("lead"), F.posexplode(F.from_json(column, _TREE)).alias("ord", "n"))
    out, level = None, root.select("n", F.concat("lead", padded("ord")).alias("at"), F.lit(None).cast("string").alias("parent_id"))
    for name in ("brand", "model", "trim"):
        level = level.withColumn(
            "id", F.coalesce(*[F.nullif(F.col(f"n.{k}"), F.lit("")) for k in ("id", "value", "key")], F.concat(F.lit("@"), "at"))
        )
        flat = level.select(
            F.lit(name).alias("level"), "id", _first("n", "name", "label", "title").alias("name"),
            F.coalesce("n.aliases", F.array().cast("array<string>")).alias("aliases"), "parent_id", F.col("at").alias("ord"),
        )
        out = flat if out is None else out.unionByName(flat)
        if name != "trim":
            below = F.coalesce(*[F.when(F.size(f"n.{k}") > 0, F.col(f"n.{k}")) for k in ("children", "models", "trims")])
            level = level.select("at", F.col("id").alias("parent_id"), F.posexplode(below).alias("i", "n")).select(
                "n", F.concat("at", F.lit("."), padded("i")).alias("at"), "parent_id"
            )
    return out


def options_of(catalog: DataFrame, parent: str) -> DataFrame:
    """Options of one group or parent specification."""
    return catalog.filter(F.col("parent") == parent)
