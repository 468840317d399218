"""Reading element files and change files (XML) by Spark's XML source, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import both, elements

_META = "_id BIGINT, _version INT, _timestamp STRING, _changeset BIGINT, _uid BIGINT, _user STRING, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
_SCHEMAS = {
    "node": f"{_META}, _lat STRING, _lon STRING",
    "way": f"{_META}, nd ARRAY<STRUCT<_ref: BIGINT>>",
    "relation": f"{_META}, member ARRAY<STRUCT<_type: STRING, _ref: BIGINT, _role: STRING>>",
}


def _typed(raw: DataFrame, etype: str, *more: str) -> DataFrame:
    tags = F.coalesce(F.transform("tag", lambda t: F.struct(F.coalesce(t["_k"], F.lit("")).alias("k"), F.coalesce(t["_v"], F.lit("")).alias("v"))), F.expr("CAST(array() AS array<struct<k:string,v:string>>)"))
    columns = {"id": F.col("_id"), "version": F.col("_version"), "ts": F.to_timestamp("_timestamp"), "changeset": F.col("_changeset"), "uid": F.col("_uid"), "user": F.col("_user"), "tags": tags}
    if etype == "node":
        columns |= {c: F.expr(f"CAST(ROUND(CAST({s} AS DECIMAL(20, 9)) * 10000000) AS BIGINT)") for c, s in (("lat_e7", "_lat"), ("lon_e7", "_lon"))}
    elif etype == "way":
        columns["nds"] = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.expr("CAST(array() AS array<bigint>)"))
    else:
        columns["members"] = F.coalesce(F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))), F.expr("CAST(array() AS array<struct<type:string,ref:bigint,role:string>>)"))
    return elements(raw.withColumns(columns), etype, *more)


def read_osm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The elements of a file or folder of base files."""
    xml = lambda t: spark.read.format("xml").option("rowTag", t).option("nullValue", "\x00").schema(_SCHEMAS[t]).load(path)
    return both(*[_typed(xml(t), t) for t in _SCHEMAS])


def read_changes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The changes of a file or folder of change files: elements with `deleted`; each block gives all its elements."""
    found = []
    for block in ("create", "modify", "delete"):
        fields = ", ".join(f"{t} ARRAY<STRUCT<{s}>>" for t, s in ((t, ", ".join(f"{x.split(' ', 1)[0]}: {x.split(' ', 1)[1]}" for x in _fields(s))) for t, s in _SCHEMAS.items()))
        rows = spark.read.format("xml").option("rowTag", block).option("nullValue", "\x00").schema(fields).load(path)
        for t in _SCHEMAS:
            raw = rows.select(F.explode(t).alias("e")).select("e.*").withColumn("deleted", F.lit(block == "delete"))
            found.append(_typed(raw, t, "deleted"))
    return both(*found)


def _fields(schema: str) -> list[str]:
    """The fields of a flat schema text, split at commas outside of brackets."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
