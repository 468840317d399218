"""Filters of a query: tags, ids, sets, users, times and places. Each takes elements and returns those that pass.

All filters of one query are combined by applying one after the other; Catalyst merges them into one pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import truthy
from ..model import KEY, RELATION_AREA, WAY_AREA, both, closed, degrees, elements, of_type, pick, typed, types_of

_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "blank": r"\h", "xdigit": r"\p{XDigit}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """An extended POSIX pattern for the JVM: character classes by name, a dot that meets line ends."""
    named = re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]], pattern)
    return f"(?s{'iu' if ignore_case else ''}){named}"


def _matches(value: Column, pattern: str, ignore_case: bool) -> Column:
    if pattern == ".*":
        return F.lit(True)
    return value != "" if pattern == "." else value.rlike(java_regex(pattern, ignore_case))


# ---- tags ----


def has_key(key: str) -> Column:
    return F.exists("tags", lambda t: t["k"] == key)


def has_value(key: str, value: str) -> Column:
    return F.exists("tags", lambda t: (t["k"] == key) & (t["v"] == value))


def lacks_value(key: str, value: str) -> Column:
    """Passes where the key is absent, too."""
    return ~has_value(key, value)


def value_like(key: str, pattern: str, ignore_case: bool = False) -> Column:
    return F.exists("tags", lambda t: (t["k"] == key) & _matches(t["v"], pattern, ignore_case))


def value_unlike(key: str, pattern: str, ignore_case: bool = False) -> Column:
    """Passes where the key is absent, too."""
    return ~value_like(key, pattern, ignore_case)


def lacks_key(key: str) -> Column:
    return ~has_key(key)


def pair_like(key_pattern: str, value_pattern: str, ignore_case: bool = False) -> Column:
    return F.exists("tags", lambda t: _matches(t["k"], key_pattern, ignore_case) & _matches(t["v"], value_pattern, ignore_case))


def pair_unlike(key_pattern: str, value_pattern: str, ignore_case: bool = False) -> Column:
    return ~pair_like(key_pattern, value_pattern, ignore_case)


# ---- ids, sets, users, times, expressions ----


def by_ids(df: DataFrame, ids: Iterable[int]) -> DataFrame:
    wanted = [i for i in ids if i > 0]
    return pick(df, F.col("id").isin(wanted) if wanted else F.lit(False))


def by_id_range(df: DataFrame, lower: int, upper: int) -> DataFrame:
    """Both ends included."""
    return pick(df, F.col("id").between(lower, upper))


def in_set(df: DataFrame, other: DataFrame) -> DataFrame:
    """The elements that another set has, too."""
    return df.join(other.select(*KEY), KEY, "left_semi")


def by_user(df: DataFrame, names: Iterable[str] = (), uids: Iterable[int] = ()) -> DataFrame:
    """Last changed by one of the users."""
    return pick(df, F.col("user").isin(list(names)) | F.col("uid").isin(list(uids)))


def touched_by(df: DataFrame, history: DataFrame, names: Iterable[str] = (), uids: Iterable[int] = ()) -> DataFrame:
    """Of which any version is by one of the users."""
    return df.join(by_user(history, names, uids).select(*KEY), KEY, "left_semi")


def newer(df: DataFrame, since: str) -> DataFrame:
    return pick(df, F.col("ts") >= F.to_timestamp(F.lit(since)))


def changed(df: DataFrame, history: DataFrame, since: str, until: str | None = None) -> DataFrame:
    """With a version that begins or ends after `since` and not after `until`."""
    low, high = F.to_timestamp(F.lit(since)), F.to_timestamp(F.lit(until)) if until else F.current_timestamp()
    within = lambda c: (F.col(c) > low) & (F.col(c) <= high)
    return df.join(history.filter(within("ts") | within("valid_to")).select(*KEY), KEY, "left_semi")


def where(df: DataFrame, expression: Column) -> DataFrame:
    """Where a text expression is true."""
    return pick(df, truthy(expression))


# ---- places ----


def with_points(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with `points`, the places of their nodes in order; a way without any has an empty list."""
    key = ["id"] if types_of(df) == ["way"] else KEY  # a constant type is no key of the join
    at = df.select(*key, F.posexplode("nds").alias("pos", "ref"))
    place = F.struct(degrees(F.col("lat_e7")).alias("lat"), degrees(F.col("lon_e7")).alias("lon"))
    placed = nodes.filter(F.col("etype") == "node").select(F.col("id").alias("ref"), place.alias("p"))
    lists = at.join(placed, "ref").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "p")))["p"].alias("points"))
    out = df.join(lists, key, "left").select(*df.columns, F.coalesce("points", F.expr("CAST(array() AS array<struct<lat:double,lon:double>>)")).alias("points"))
    return typed(out, "way") if key == ["id"] else out


def relations_with(df: DataFrame, nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """The relations that have one of the nodes or ways as a member."""
    met = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(ways.select(F.lit("way").alias("type"), F.col("id").alias("ref")))
    edges = of_type(df, "relation").select("etype", "id", F.explode("members").alias("m")).select("etype", "id", "m.type", "m.ref")
    return df.join(edges.join(met, ["type", "ref"], "left_semi").select(*KEY), KEY, "left_semi")


def _by_place(df: DataFrame, world: DataFrame, node_test, way_test) -> DataFrame:
    """Nodes and ways by a test on their places; relations by their node and way members. Only the types that df has are planned."""
    place = lambda rows: typed(rows.filter(node_test(degrees(F.col("lat_e7")), degrees(F.col("lon_e7")))), "node")
    nodes, known = of_type(world, "node"), types_of(df)
    crossing = lambda rows: typed(with_points(rows, nodes).filter(way_test(F.col("points"))).drop("points"), "way")
    tests = {
        "node": lambda: place(of_type(df, "node")), "way": lambda: crossing(of_type(df, "way")),
        "relation": lambda: typed(relations_with(of_type(df, "relation"), place(nodes), crossing(of_type(world, "way"))), "relation"), "area": lambda: of_type(df, "area").filter(F.lit(False)),
    }
    some = [test() for t, test in tests.items() if known is None or t in known]
    return both(*some) if some else df


def in_box(df: DataFrame, world: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Nodes in a box, ways that meet it, relations with such members; areas are not filtered. Nodes compare as integers."""
    south_e7, west_e7, north_e7, east_e7 = (round(x * 10_000_000) for x in (south, west, north, east))

    def way_test(points: Column) -> Column:
        boxes = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
        alone = (F.size(points) == 1) & F.exists(points, lambda p: g.point_in_box(p["lat"], p["lon"], south, west, north, east))
        hit = alone
        for w, e in boxes:
            hit = hit | _any_segment(points, south, w, north, e)
        return hit

    def node_test(lat: Column, lon: Column) -> Column:
        return g.point_in_box(F.col("lat_e7"), F.col("lon_e7"), south_e7, west_e7, north_e7, east_e7)

    found, known = _by_place(df, world, node_test, way_test), types_of(df)
    return found if known is not None and "area" not in known else found.unionByName(of_type(df, "area"))


def _any_segment(points: Column, south: float, west: float, north: float, east: float) -> Column:
    return F.exists(g.pairs(points), lambda s: g.segment_meets_box(s, south, west, north, east))


def in_polygon(df: DataFrame, world: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Nodes inside a polygon of (lat, lon) corners or on its border; ways with a vertex inside or crossing it; relations by members."""
    ring = [*corners, corners[0]] if corners[0] != corners[-1] else corners
    place = lambda lat, lon: F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    sides = F.array(*[F.struct(place(*a).alias("a"), place(*b).alias("b")) for a, b in zip(ring, ring[1:], strict=False)])
    south, north = min(x for x, _ in ring), max(x for x, _ in ring)
    west, east = min(y for _, y in ring), max(y for _, y in ring)

    def node_test(lat: Column, lon: Column) -> Column:
        return lat.between(south, north) & lon.between(west, east) & g.in_ring(lat, lon, sides)

    def way_test(points: Column) -> Column:
        return F.exists(points, lambda p: node_test(p["lat"], p["lon"])) | F.exists(g.pairs(points), lambda s: F.exists(sides, lambda t: crosses(s, t)))

    return _by_place(df, world, node_test, way_test)


def crosses(s: Column, t: Column) -> Column:
    """Whether two segments cross in an inner point of both."""

    def side(a: Column, b: Column, p: Column) -> Column:
        return F.signum((b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"]))

    return (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) < 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) < 0)


def around(nodes: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """Nodes at most `radius` metres from a node of `sources`: a range join over a grid.

    Cells have the height of the radius, so a source meets its own row of cells and the next ones; within a row it meets
    the columns that the radius spans at that latitude. The exact distance decides.

    Nodes that share a cell of half the radius with a source are near it without a test, so only nodes in cells without one
    meet sources, of which there are then few about: the tests grow with the nodes, not with nodes times sources.
    """
    if radius < 0:
        raise ValueError("radius is negative")
    size = max(radius / 10_000_000.0 * 90.0, 1e-4) * 1.000001
    lat, lon = degrees(F.col("lat_e7")), degrees(F.col("lon_e7"))
    row = F.floor(lat / size)
    # columns get wider towards the poles, by the latitude of the row's far edge; the last row has a single column
    far = lambda r: F.greatest(F.abs(r * size), F.abs((r + 1) * size))
    columns = lambda r: F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(far(r), F.lit(90.0)))) * 360.0 / size)).cast("bigint")
    column = lambda r, x: F.least(F.floor((x + 180.0) / 360.0 * columns(r)), columns(r) - 1).cast("bigint")
    own = of_type(nodes, "node").withColumns({"_row": row, "_column": column(row, lon)})
    span = F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.try_divide(F.sin(F.radians(F.lit(size))), F.greatest(F.cos(F.radians(F.col("_lat"))), F.lit(1e-9))))))) * 1.0001
    near = of_type(sources, "node").select(lat.alias("_lat"), lon.alias("_lon")).distinct().withColumn("_row", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_lat") / size) + d)))
    n, s = columns(F.col("_row")), span
    pole = F.abs(F.col("_lat")) + size >= 90.0
    first = F.when(pole, F.lit(0)).otherwise(F.floor((F.col("_lon") - s + 180.0) / 360.0 * n))
    last = F.when(pole, n - 1).otherwise(F.least(F.floor((F.col("_lon") + s + 180.0) / 360.0 * n), first + n - 1))
    near = near.withColumn("_column", F.explode(F.array_distinct(F.transform(F.sequence(first.cast("bigint"), last.cast("bigint")), lambda c: F.pmod(c, n))))).distinct()
    close = g.distance(lat, lon, F.col("_lat"), F.col("_lon")) <= radius
    same = (F.abs(lat - F.col("_lat")) < 1e-7) & (F.abs(lon - F.col("_lon")) < 1e-7)
    half, cell = 0.49 * radius / 10_000_000.0 * 90.0, ["_half", "_place"]
    if half < 1e-4:  # too small for cells
        found = own.join(near, ["_row", "_column"]).filter(close | same).select(*KEY).distinct()
        return nodes.join(found, KEY, "left_semi")
    low = lambda r: F.least(F.abs(r * half), F.abs((r + 1) * half))
    across = F.greatest(F.lit(1), F.ceil(F.cos(F.radians(F.least(low(F.col("_half")), F.lit(90.0)))) * 360.0 / half))
    halved = lambda df: df.withColumn("_half", F.floor(lat / half)).withColumn("_place", F.least(F.floor((lon + 180.0) / 360.0 * across), across - 1))
    full = halved(of_type(sources, "node").select("lat_e7", "lon_e7")).select(*cell).distinct()
    sure = halved(own).join(full, cell, "left_semi").select(*KEY)
    found = halved(own).join(full, cell, "left_anti").join(near, ["_row", "_column"]).filter(close | same).select(*KEY).distinct()
    return nodes.join(sure.unionByName(found), KEY, "left_semi")


def around_line(df: DataFrame, line: list[tuple[float, float]], radius: float) -> DataFrame:
    """Nodes at most `radius` metres from a line of (lat, lon) points given with the query."""
    lat, lon = degrees(F.col("lat_e7")), degrees(F.col("lon_e7"))
    hit = F.lit(False)
    for a in line:
        hit = hit | (g.distance(lat, lon, F.lit(a[0]), F.lit(a[1])) <= radius)
    for a, b in zip(line, line[1:], strict=False):
        hit = hit | (segment_distance(lat, lon, a, b) <= radius)
    return of_type(df, "node").filter(hit)


def segment_distance(lat: Column, lon: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Metres to the great circle through a and b where the foot lies between them; else null."""
    def vector(p: tuple[float, float]) -> tuple[float, float, float]:
        x, y = math.radians(p[0]), math.radians(p[1])
        return math.sin(x), math.cos(x) * math.sin(y), math.cos(x) * math.cos(y)

    def cross(u, v):
        return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]

    u, v = vector(a), vector(b)
    n = cross(u, v)
    size = math.sqrt(sum(x * x for x in n))
    if size == 0:
        return F.lit(None).cast("double")
    n = tuple(x / size for x in n)
    p = (F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.cos(F.radians(lat)) * F.cos(F.radians(lon)))
    dot = lambda q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    between = (dot(cross(n, u)) >= 0) & (dot(cross(v, n)) >= 0)
    return F.when(between, F.asin(F.least(F.lit(1.0), F.abs(dot(n)))) * (g.QUARTER * 2) / math.pi)


# ---- areas ----


def areas_of(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closed ways as areas: the id moved by a fixed offset, one ring in `geometry`."""
    rings = with_points(of_type(ways, "way").filter(closed() & (F.size("nds") > 3)), nodes)
    return elements(rings.withColumns({"id": F.col("id") + WAY_AREA, "geometry": F.array("points")}), "area")


def map_to_area(df: DataFrame, areas: DataFrame) -> DataFrame:
    """The areas made of ways and relations, and the closed ways themselves, which stand for the areas inside them."""
    wanted = df.select(F.when(F.col("etype") == "way", F.col("id") + WAY_AREA).when(F.col("etype") == "relation", F.col("id") + RELATION_AREA).alias("id"))
    made = typed(areas.join(wanted, "id", "left_semi").select(*areas.columns), "area")
    return both(made, pick(of_type(df, "way"), closed()))


def pivot(df: DataFrame, areas: DataFrame) -> DataFrame:
    """The ways and relations that areas are made of."""
    i = F.col("id")
    wanted = areas.select(F.when(i >= RELATION_AREA, "relation").otherwise("way").alias("etype"), F.when(i >= RELATION_AREA, i - RELATION_AREA).otherwise(i - WAY_AREA).alias("id"))
    return df.join(wanted, KEY, "left_semi")


def _cells(areas: DataFrame, size: float) -> DataFrame:
    """A row per area and grid cell that its box meets, with its sides."""
    sides = F.flatten(F.transform("geometry", g.pairs))
    box = g.bounds(F.flatten("geometry"))
    cut = areas.select(F.col("id").alias("area"), sides.alias("sides"), box.alias("box")).filter("box IS NOT NULL")
    steps = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return cut.withColumn("row", F.explode(steps(F.col("box.minlat"), F.col("box.maxlat")))).withColumn("column", F.explode(steps(F.col("box.minlon"), F.col("box.maxlon"))))


def covering(points: DataFrame, areas: DataFrame, size: float = 5.0, border: bool = True) -> DataFrame:
    """(area, etype, id) for nodes inside areas: an equi-join on grid cells, then the even-odd rule."""
    lat, lon = degrees(F.col("lat_e7")), degrees(F.col("lon_e7"))
    own = of_type(points, "node").select("etype", "id", lat.alias("lat"), lon.alias("lon"), F.floor(lat / size).alias("row"), F.floor(lon / size).alias("column"))
    met = own.join(_cells(areas, size), ["row", "column"])
    return met.filter(g.in_ring(F.col("lat"), F.col("lon"), F.col("sides"), border)).select("area", *KEY)


def in_areas(df: DataFrame, areas: DataFrame) -> DataFrame:
    """Nodes inside any of the areas, borders included."""
    return df.join(covering(df, areas).select(*KEY).distinct(), KEY, "left_semi")


def is_in(points: DataFrame, areas: DataFrame) -> DataFrame:
    """The areas that cover any of the nodes."""
    return areas.join(covering(points, areas).select(F.col("area").alias("id")).distinct(), "id", "left_semi").select(*areas.columns)
