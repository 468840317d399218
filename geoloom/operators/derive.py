"""Derived elements: projections and aggregates that become elements of their own, and the taking apart of networks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions.geometry import point
from ..model import KEY, RELATION_AREA, degrees, elements, ends_of, members_of, of_type, tag
from ..shared import stored
from .output import numbered


def _pairs(assigned: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in assigned.items()]) if assigned else F.expr("CAST(array() AS array<struct<k:string,v:string>>)")


def convert(df: DataFrame, etype: str, assigned: dict[str, Column] | None = None, copy_tags: bool = False, drop: tuple[str, ...] = (), new_id: Column | None = None, geometry: Column | None = None) -> DataFrame:
    """One derived element per element. Assigned keys win over copied tags; empty values and dropped keys are left out."""
    assigned = assigned or {}
    taken = [*assigned, *drop]
    own = F.filter(_pairs(assigned), lambda t: t["v"] != "")
    tags = F.concat(own, F.filter("tags", lambda t: ~t["k"].isin(taken))) if copy_tags else own
    columns = {"id": F.coalesce(new_id, F.col("id")) if new_id is not None else F.col("id"), "tags": tags}
    if geometry is not None:
        columns["geometry"] = geometry
    return elements(df.withColumns(columns), etype)


def make(df: DataFrame, etype: str, assigned: dict[str, Column]) -> DataFrame:
    """One derived element from a whole set: every value is an aggregate."""
    row = df.agg(*[v.alias(f"v{i}") for i, v in enumerate(assigned.values())])
    return elements(row.select(F.lit(1).alias("id"), F.filter(_pairs({k: F.col(f"v{i}") for i, k in enumerate(assigned)}), lambda t: t["v"] != "").alias("tags")), etype)


def make_per_group(grouped: DataFrame, etype: str, assigned: dict[str, Column], key: str = "value") -> DataFrame:
    """One derived element per group (`val`, see sets.grouped): the loop over groups as one groupBy. Ids count up from 1 in the order of the keys."""
    rows = grouped.groupBy("val").agg(*[v.alias(f"v{i}") for i, v in enumerate(assigned.values())])
    tags = F.filter(_pairs({key: F.col("val"), **{k: F.col(f"v{i}") for i, k in enumerate(assigned)}}), lambda t: t["v"] != "")
    return elements(numbered(rows.select(tags.alias("tags"), F.col("val").alias("_val")), "_val", number="id"), etype)


def copy_all_keys(df: DataFrame, aggregate=agg.unique) -> DataFrame:
    """(k, v): every key of a set with an aggregate of its values, for assigning all keys of a set at once."""
    rows = df.select(F.explode("tags").alias("t")).select("t.k", "t.v")
    return rows.groupBy("k").agg(aggregate(F.col("v")).alias("v"))


def convert_each(df: DataFrame, etype: str, each: Callable[[Column, Column], Column], assigned: dict[str, Column] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """One derived element per element, with each of its keys under a value made by each(key, value). Assigned keys win, dropped keys and empty values are left out."""
    assigned = assigned or {}
    rest = F.filter("tags", lambda t: ~t["k"].isin([*assigned, *drop]))
    made = F.transform(rest, lambda t: F.struct(t["k"].alias("k"), each(t["k"], t["v"]).alias("v")))
    return elements(df.withColumn("tags", F.filter(F.concat(_pairs(assigned), made), lambda t: t["v"] != "")), etype)


def make_each(df: DataFrame, etype: str, assigned: dict[str, Column] | None = None, drop: tuple[str, ...] = (), aggregate=agg.unique) -> DataFrame:
    """One derived element from a whole set, with an aggregate of every key of the set. Assigned aggregates win, dropped keys and empty values are left out."""
    assigned = assigned or {}
    rows = copy_all_keys(df, aggregate).filter(~F.col("k").isin([*assigned, *drop]))
    if assigned:
        own = df.agg(*[v.alias(f"v{i}") for i, v in enumerate(assigned.values())])
        rows = rows.unionByName(own.select(F.explode(_pairs({k: F.col(f"v{i}") for i, k in enumerate(assigned)})).alias("t")).select("t.k", "t.v"))
    return elements(rows.filter("v <> ''").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("tags")).withColumn("id", F.lit(1)), etype)


def timeline(history: DataFrame, etype: str, ids: list[int], version: int | None = None) -> DataFrame:
    """A derived element per version: reference, version, when it was made and when it expired."""
    rows = history.filter((F.col("etype") == etype) & F.col("id").isin(ids))
    w = W.partitionBy("etype", "id").orderBy("version", "ts")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = rows.withColumn("expired", F.lead("ts").over(w))
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    tags = {"reftype": F.col("etype"), "ref": F.col("id").cast("string"), "refversion": F.col("version").cast("string"), "created": stamp(F.col("ts")), "expired": F.coalesce(stamp(F.col("expired")), F.lit(""))}
    return elements(rows.withColumn("tags", F.filter(_pairs(tags), lambda t: t["v"] != "")), "timeline")


def _local_ids(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, local_id) of the set's nodes and of its ways' nodes that share their place with another: numbered from 1 in each place."""
    used = of_type(df, "node").select("id").unionByName(of_type(df, "way").select(F.explode("nds").alias("id"))).distinct()
    place = W.partitionBy("lat_e7", "lon_e7")
    rows = of_type(nodes, "node").select("id", "lat_e7", "lon_e7").join(used, "id", "left_semi")
    return rows.select("id", F.count("*").over(place).alias("n"), F.row_number().over(place.orderBy("id")).alias("local_id")).filter("n > 1").drop("n")


def local_vertices(df: DataFrame, nodes: DataFrame, every: bool = False) -> DataFrame:
    """Tagged nodes as derived vertices, or all nodes, with their ids; keys that begin with `_` get one more. Nodes that share a place are told apart by `_local_id`."""
    own = of_type(df, "node") if every else of_type(df, "node").filter(F.size("tags") > 0)
    own = own.join(_local_ids(df, nodes), "id", "left")
    moved = F.transform("tags", lambda t: F.struct(F.when(t["k"].startswith("_"), F.concat(F.lit("_"), t["k"])).otherwise(t["k"]).alias("k"), t["v"].alias("v")))
    extra = _pairs({"_local_id": F.col("local_id").cast("string")} | ({"_node_ref": F.col("id").cast("string")} if every else {}))
    tags = F.array_sort(F.concat(F.filter(extra, lambda t: t["v"].isNotNull()), moved))
    return elements(own.withColumns({"tags": tags, "geometry": point(degrees(F.col("lat_e7")), degrees(F.col("lon_e7")))}), "vertex")


def local_links(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, part, nds): ways cut where sections meet.

    An inner use of a node by one of the ways counts once, an end twice, a tagged node of the set once more; ways are cut
    at inner nodes that count more than once or share their place with another node. A way without such is one link, one
    with an unknown node is left out.
    """
    all_ways = of_type(df, "way").filter(F.size("nds") > 0).select("id", "nds", F.size("nds").alias("n"))
    uses = all_ways.select("id", "n", F.posexplode("nds").alias("pos", "ref"))
    unknown = uses.join(of_type(nodes, "node").select(F.col("id").alias("ref")), "ref", "left_anti").select("id").distinct()
    ways, end = all_ways.join(unknown, "id", "left_anti"), (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    tagged = of_type(df, "node").filter(F.size("tags") > 0).select(F.col("id").alias("ref"), F.lit(1).alias("times"))
    often = uses.select("ref", F.when(end, 2).otherwise(1).alias("times")).unionByName(tagged).groupBy("ref").agg(F.sum("times").alias("times")).filter("times > 1").select("ref")
    cuts = often.unionByName(_local_ids(df, nodes).select(F.col("id").alias("ref"))).distinct().withColumn("cut", F.lit(True))
    at = ways.select("id", "n", F.posexplode("nds").alias("pos", "ref")).join(cuts, "ref", "left")
    places = at.filter(F.col("cut").isNotNull() | end).groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    whole = F.when(F.size("places") > 1, F.arrays_zip(F.slice("places", F.lit(1), F.size("places") - 1).alias("a"), F.slice("places", F.lit(2), F.size("places") - 1).alias("b")))
    parts = ways.join(places, "id").select("id", "nds", F.posexplode_outer(whole).alias("part", "p"))
    return parts.select(F.col("id").alias("way"), (F.coalesce("part", F.lit(0)) + 1).alias("part"), F.expr("IF(p IS NULL, nds, slice(nds, p.a + 1, p.b - p.a + 1))").alias("nds"))


def local_trigraphs(df: DataFrame) -> DataFrame:
    """(relation, pos, type, ref, role, previous, next): members of relations with their neighbours in order."""
    rows = of_type(df, "relation").select("id", F.posexplode("members").alias("pos", "m"), "members")
    near = lambda i: F.get("members", i)["ref"]
    return rows.select(F.col("id").alias("relation"), (F.col("pos") + 1).alias("pos"), "m.type", "m.ref", "m.role", F.when(F.col("pos") > 0, near(F.col("pos") - 1)).alias("previous"), near(F.col("pos") + 1).alias("next"))


def ring_members(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, whole, even) of the relations with a way that has nodes, and (id, at, ref) of the way members of those with `even`; both are written.

    Where every end is met an even number of times the hashes of all ends cancel out, so `even` rules out most other
    relations by one number each, and none that closes; `whole` tells that all way members are ways with nodes.
    """
    relations, ways = of_type(df, "relation"), of_type(df, "way")
    lines = members_of(relations).filter(F.col("type") == "way").select("id", "at", "ref")
    ends = ends_of(ways).select(F.col("id").alias("ref"), F.xxhash64("first").bitwiseXOR(F.xxhash64("last")).alias("ends"))
    sums = lines.select("id", "ref").join(ends, "ref", "left").groupBy("id").agg(F.count("*").alias("all"), F.count("ends").alias("known"), F.bit_xor("ends").alias("ends"))
    found = sums.filter("known > 0").select("id", (F.col("known") == F.col("all")).alias("whole"), (F.col("ends") == 0).alias("even"))
    found = stored(found.join(relations.select("id"), "id", "left_semi"), "rings")
    few = stored(found.filter("even").select("id"), "even")
    return found, stored(lines.join(few, "id", "left_semi"), "lines")


def unpaired(lines: DataFrame, ways: DataFrame) -> DataFrame:
    """The ids of lines (id, ref) of relations in which an end node is met an odd number of times."""
    ends = ends_of(ways, lines.select(F.col("ref").alias("id"))).select(F.col("id").alias("ref"), F.explode(F.array("first", "last")).alias("node"))
    return lines.select("id", "ref").join(ends, "ref").groupBy("id", "node").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("id").distinct()


def rings(df: DataFrame) -> DataFrame:
    """(id, area, closed): whether the ways of each relation can form rings: every end node is met an even number of times."""
    found, lines = ring_members(df)
    odd = unpaired(lines, of_type(df, "way")).withColumn("odd", F.lit(True))
    closed = F.col("even") & F.col("odd").isNull()
    return found.join(odd, "id", "left").select("id", (F.col("id") + RELATION_AREA).alias("area"), closed.alias("closed"))


def tag_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*KEY, *[tag(k).alias(k) for k in keys])
