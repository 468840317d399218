"""Expressions over one element: properties, counts of tags and members, and lists over members and vertices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import closed
from . import geometry as g
from .text import flag


def element_id() -> Column:
    return F.col("id").cast("string")


def keys() -> Column:
    return F.transform("tags", lambda t: t["k"])


def is_tag(key: str) -> Column:
    return flag(F.exists("tags", lambda t: t["k"] == key))


def count_tags() -> Column:
    return F.size("tags").cast("string")


def _refs(kind: str | None, role: str | None = None) -> Column:
    """Members as (type, ref): nodes of ways, members of relations by type and role."""
    fits = lambda m: (F.lit(True) if kind is None else m["type"] == kind) & (F.lit(True) if role is None else m["role"] == role)
    own = F.transform(F.filter("members", fits), lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref")))
    nodes = F.transform("nds", lambda n: F.struct(F.lit("node").alias("type"), n.alias("ref")))
    none = F.expr("CAST(array() AS array<struct<type:string,ref:bigint>>)")
    of_way = nodes if role is None and kind in (None, "node") else none
    return F.when(F.col("etype") == "relation", own).when(F.col("etype") == "way", of_way).otherwise(none)


def count_members(kind: str | None = None) -> Column:
    return F.size(_refs(kind)).cast("string")


def count_distinct_members(kind: str | None = None) -> Column:
    return F.size(F.array_distinct(_refs(kind))).cast("string")


def count_by_role(role: str, kind: str | None = None) -> Column:
    return F.size(_refs(kind, role)).cast("string")


def count_distinct_by_role(role: str, kind: str | None = None) -> Column:
    return F.size(F.array_distinct(_refs(kind, role))).cast("string")


def is_closed() -> Column:
    """Of ways; other types are `NaW`."""
    return F.when(F.col("etype") == "way", flag(closed())).otherwise("NaW")


def fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def length(points: str = "points") -> Column:
    """Metres of a way with its points, three decimals."""
    return fixed(g.length(points), 3)


def shape_metres(shapes: str = "shapes") -> Column:
    """Metres of an element of any type with its shapes: 0 of a node, the sum over its members of a relation."""
    return F.aggregate(F.transform(shapes, g.length), F.lit(0.0), lambda a, x: a + x)


def shape_length(shapes: str = "shapes") -> Column:
    """The same as text, three decimals."""
    return fixed(shape_metres(shapes), 3)


def shape() -> Column:
    """The geometry of an element with its shapes, for derived elements."""
    return F.filter("shapes", lambda s: F.size(s) > 0)


def lat(points: str | None = "points") -> Column:
    """The middle of the box, seven decimals; NaN without a place. Without points, of the column `bounds`."""
    return F.coalesce(fixed(_middle(points)["lat"], 7), F.lit("NaN"))


def lon(points: str | None = "points") -> Column:
    return F.coalesce(fixed(_middle(points)["lon"], 7), F.lit("NaN"))


def _middle(points: str | None) -> Column:
    return g.center(g.bounds(points) if points else F.col("bounds"))


def per_member(expression: Callable[[Column, Column], Column]) -> Column:
    """A text from each member in order, joined by semicolons. expression(member, place) gets struct(type, ref, role) and 1, 2, ..."""
    nodes = F.transform("nds", lambda n: F.struct(F.lit("node").alias("type"), n.alias("ref"), F.lit("").alias("role")))
    rows = F.when(F.col("etype") == "relation", F.col("members")).when(F.col("etype") == "way", nodes)
    return F.coalesce(F.array_join(F.transform(rows, lambda m, i: expression(m, i + 1)), ";"), F.lit(""))


def per_vertex(expression: Callable[[Column, Column, Column, Column], Column], points: str = "points") -> Column:
    """A text from each inner vertex of a way, and from the end of a closed one, joined by semicolons. expression(before, at, after, place) gets points and 2, 3, ..."""
    p, n = F.col(points), F.size(points)
    after = lambda i: F.when(i < n - 1, F.get(p, i + 1)).otherwise(F.get(p, F.lit(1)))
    end = F.when(F.get(p, F.lit(0)) == F.get(p, n - 1), n - 1).otherwise(n - 2)
    texts = F.transform(F.sequence(F.lit(1), end), lambda i: expression(F.get(p, i - 1), F.get(p, i), after(i), i + 1))
    return F.when(n > 2, F.array_join(texts, ";")).otherwise("")


def vertex_angles(points: str = "points") -> Column:
    """Turns in degrees at the vertices, three decimals; NaN where a segment has no length."""
    return per_vertex(lambda before, at, after, _: F.coalesce(fixed(g.angle(before, at, after), 3), F.lit("NaN")), points)
