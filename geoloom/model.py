"""The element model: one DataFrame for nodes, ways, relations, areas and derived elements.

Each type comes from its own table and carries its type as a constant, so that a filter on `etype` prunes the other
tables before they are read. Tags are a list of pairs, since keys may repeat; coordinates are integers of 1e-7 degrees.
"""

from __future__ import annotations

from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: column -> type
COLUMNS = {
    "etype": "string", "id": "bigint", "lat_e7": "bigint", "lon_e7": "bigint", "nds": "array<bigint>", "members": "array<struct<type:string,ref:bigint,role:string>>",
    "tags": "array<struct<k:string,v:string>>", "version": "int", "ts": "timestamp", "changeset": "bigint", "uid": "bigint", "user": "string", "valid_to": "timestamp", "geometry": "array<array<struct<lat:double,lon:double>>>",
}
KEY = ["etype", "id"]
#: Order of types in every output.
RANK = {"node": 1, "way": 2, "relation": 3, "area": 4}
WAY_AREA, RELATION_AREA = 2_400_000_000, 3_600_000_000


#: What is known of frames of several types: the frame of each. A step on one type then plans that type's tables alone.
_TYPES: WeakKeyDictionary[DataFrame, dict[str, DataFrame | None]] = WeakKeyDictionary()  # None: the frame itself


def typed(df: DataFrame, etype: str) -> DataFrame:
    """df, noted as elements of one type."""
    _TYPES[df] = {etype: None}
    return df


#: The memberships of frames of one type as rows, of their elements and maybe of others.
_LINKS: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def linked(df: DataFrame, links: DataFrame | None) -> DataFrame:
    """df of one type, noted with memberships (id, type, ref, role) in any order, repeats and other ids allowed: steps without a need of order read them, and no lists are made."""
    if links is not None:
        _LINKS[df] = links
    return df


def links_of(df: DataFrame) -> DataFrame | None:
    """The noted memberships of a frame, those of elements that it has not included; None if none are noted."""
    return _LINKS.get(df)


#: The nodes of frames of ways, and the members of frames of relations, as rows that have their order and number, too.
_LISTED: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def listed(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Ways, noted with their nodes (id, at, ref), or relations with their members (id, at, type, ref, role), each as often as the list has it and in the order of `at`; ids of other elements are allowed."""
    _LISTED[df] = rows
    return df


def nodes_of(ways: DataFrame) -> DataFrame:
    """(id, at, ref) of the nodes of ways: the noted rows, maybe with ids of other ways, or those of the lists."""
    return _LISTED[ways] if ways in _LISTED else ways.select("id", F.posexplode("nds").alias("at", "ref"))


def members_of(relations: DataFrame) -> DataFrame:
    """(id, at, type, ref, role) of the members of relations: the noted rows, maybe with ids of other relations, or those of the lists."""
    return _LISTED[relations] if relations in _LISTED else relations.select("id", F.posexplode("members").alias("at", "m")).select("id", "at", "m.*")


def ends_of(ways: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, first, last): the end nodes of the ways that have any; with ids, of these ways alone."""
    some = lambda rows: rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")
    if ways not in _LISTED:
        return some(ways.select("id", "nds")).filter(F.size("nds") > 0).select("id", F.get("nds", F.lit(0)).alias("first"), F.get("nds", F.size("nds") - 1).alias("last"))
    ends = some(_LISTED[ways]).groupBy("id").agg(F.min_by("ref", "at").alias("first"), F.max_by("ref", "at").alias("last"))
    return ends.join(some(ways.select("id")), "id", "left_semi")


def among(df: DataFrame, ids: DataFrame, etype: str) -> DataFrame:
    """The elements of one type with any of the ids; what is known of them stays known."""
    own = of_type(df, etype)
    return linked(typed(own.join(ids.select("id"), "id", "left_semi").select(*df.columns), etype), links_of(own))


def _parts(df: DataFrame) -> dict[str, DataFrame]:
    return {t: df if one is None else one for t, one in _TYPES[df].items()}


def types_of(df: DataFrame) -> list[str] | None:
    """The types that df has at most; None if that is not known."""
    return None if df not in _TYPES else list(_TYPES[df])


def pick(df: DataFrame, condition: Column | str) -> DataFrame:
    """The elements for which a condition holds; what is known of the types stays known."""
    if df not in _TYPES:
        return df.filter(condition)
    some = [linked(typed(one.filter(condition), t), links_of(one)) for t, one in _parts(df).items()]
    return both(*some) if some else df


def elements(df: DataFrame, etype: str | None = None, *more: str) -> DataFrame:
    """df with all columns of the model, null where it has none, and more of its own."""
    named = df.withColumn("etype", F.lit(etype)) if etype else df
    out = named.select(*[(F.col(c).cast(t) if c in named.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()], *more)
    return typed(out, etype) if etype else out


def both(*sets: DataFrame) -> DataFrame:
    """All rows of the sets, duplicates included."""
    if len(sets) == 1:
        return sets[0]
    out, parts = reduce(DataFrame.unionByName, sets), {}
    if all(x in _TYPES for x in sets):
        for x in sets:
            for t, one in _parts(x).items():
                parts[t] = parts[t].unionByName(one) if t in parts else one
        _TYPES[out] = parts
    return out


def of_type(df: DataFrame, *etypes: str) -> DataFrame:
    if df in _TYPES:
        found = [typed(one, t) for t, one in _parts(df).items() if t in etypes]
        if found:
            return both(*found)
        nothing = df.filter(F.lit(False))
        _TYPES[nothing] = {}
        return nothing
    out = df.filter(F.col("etype").isin(*etypes))
    return typed(out, etypes[0]) if len(etypes) == 1 else out


def tag_list(**tags: Column) -> Column:
    """A list of pairs from keyword columns, without those that are null."""
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in tags.items()]
    return F.filter(F.array(*pairs), lambda t: t["v"].isNotNull())


def tag(key: str | Column, tags: str | Column = "tags") -> Column:
    """The first value of a key, or an empty string."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"], F.lit(""))


def closed(df_nds: str = "nds") -> Column:
    n = F.size(df_nds)
    return (n > 0) & (F.get(df_nds, F.lit(0)) == F.get(df_nds, n - 1))


def degrees(e7: Column) -> Column:
    return e7 / F.lit(1e7)
