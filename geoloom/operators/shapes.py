"""Places of elements of any type, areas of relations, and areas as filters of ways and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import RELATION_AREA, WAY_AREA, both, closed, degrees, elements, nodes_of, of_type, pick, typed, types_of
from ..shared import stored
from . import derive, filters

_NO_SHAPES = "CAST(array() AS array<array<struct<lat:double,lon:double>>>)"
_NO_POINTS = "CAST(array() AS array<struct<lat:double,lon:double>>)"


def _place() -> Column:
    return F.struct(degrees(F.col("lat_e7")).alias("lat"), degrees(F.col("lon_e7")).alias("lon"))


def with_shapes(df: DataFrame, world: DataFrame) -> DataFrame:
    """df with `shapes`, the places of each part in order, and `points`, those of all parts.

    A node is one part of one point and a way one part of its nodes' places. A relation has a part for each member: one
    point for a node, a way's points for a way, and nothing for a relation or where the place is unknown.
    """
    nodes, known = of_type(world, "node"), types_of(df)

    def of_nodes() -> DataFrame:
        one = F.when(F.col("lat_e7").isNotNull(), F.array(F.array(_place()))).otherwise(F.expr(_NO_SHAPES))
        return of_type(df, "node").withColumns({"points": F.flatten(one), "shapes": one})

    def of_ways() -> DataFrame:
        return filters.with_points(of_type(df, "way"), nodes).withColumn("shapes", F.array("points"))

    def of_relations() -> DataFrame:
        own = of_type(df, "relation")
        edges = own.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.type", "m.ref")
        lines = filters.with_points(of_type(world, "way").join(edges.filter("type = 'way'").select(F.col("ref").alias("id")), "id", "left_semi"), nodes)
        parts = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref"), F.array(_place()).alias("part")).unionByName(lines.select(F.lit("way").alias("type"), F.col("id").alias("ref"), F.col("points").alias("part")))
        found = edges.join(parts, ["type", "ref"], "left").select("id", F.struct("pos", F.coalesce("part", F.expr(_NO_POINTS)).alias("part")).alias("x"))
        lists = found.groupBy("id").agg(F.sort_array(F.collect_list("x"))["part"].alias("shapes"))
        placed = own.join(lists, "id", "left").withColumn("shapes", F.coalesce("shapes", F.expr(_NO_SHAPES)))
        return placed.withColumn("points", F.flatten("shapes"))

    made = {"node": of_nodes, "way": of_ways, "relation": of_relations}
    columns = [*df.columns, "points", "shapes"]
    return both(*[f().select(*columns) for t, f in made.items() if known is None or t in known])


def _box(rows: DataFrame, south: str, west: str, north: str, east: str) -> DataFrame:
    least, most = (south, west), (north, east)
    return rows.groupBy("id").agg(*[F.min(c).alias(n) for c, n in zip(least, ("south", "west"), strict=True)], *[F.max(c).alias(n) for c, n in zip(most, ("north", "east"), strict=True)])


def with_bounds(df: DataFrame, world: DataFrame) -> DataFrame:
    """df with `bounds` of all its places as with_shapes has them, null without any: by least and greatest values alone, so that no list of places is made."""
    nodes, known = of_type(world, "node").filter("lat_e7 IS NOT NULL"), types_of(df)
    box = F.struct(*[degrees(F.col(c)).alias(n) for c, n in (("south", "minlat"), ("west", "minlon"), ("north", "maxlat"), ("east", "maxlon"))])
    placed = lambda own, boxes: own.join(boxes, "id", "left").select(*df.columns, F.when(F.col("south").isNotNull(), box).alias("bounds"))
    kept = {}

    def boxes_of(ways: DataFrame) -> DataFrame:
        at = ways.select("id", F.explode("nds").alias("ref")).join(nodes.select(F.col("id").alias("ref"), "lat_e7", "lon_e7"), "ref")
        return _box(at, "lat_e7", "lon_e7", "lat_e7", "lon_e7")

    def of_ways() -> DataFrame:
        own, every = of_type(df, "way"), of_type(world, "way")
        if own is every and (known is None or "relation" in known):  # relations ask for the same boxes
            kept["way"] = stored(boxes_of(every), "boxes")
        return placed(own, kept.get("way") or boxes_of(own))

    def of_relations() -> DataFrame:
        own = of_type(df, "relation")
        edges = own.select("id", F.explode("members").alias("m")).select("id", "m.type", "m.ref").distinct()
        ways = kept.get("way") or boxes_of(of_type(world, "way").join(edges.filter("type = 'way'").select(F.col("ref").alias("id")), "id", "left_semi"))
        sides = ("south", "west", "north", "east")
        points = nodes.select(F.col("id").alias("ref"), F.col("lat_e7").alias("south"), F.col("lon_e7").alias("west"), F.col("lat_e7").alias("north"), F.col("lon_e7").alias("east"))
        of = lambda t, parts: edges.filter(F.col("type") == t).join(parts, "ref").select("id", *sides)
        return placed(own, _box(of("node", points).unionByName(of("way", ways.withColumnRenamed("id", "ref"))), *sides))

    def of_nodes() -> DataFrame:
        own = F.struct(degrees(F.col("lat_e7")).alias("minlat"), degrees(F.col("lon_e7")).alias("minlon"), degrees(F.col("lat_e7")).alias("maxlat"), degrees(F.col("lon_e7")).alias("maxlon"))
        return of_type(df, "node").select(*df.columns, F.when(F.col("lat_e7").isNotNull(), own).alias("bounds"))

    made = {"node": of_nodes, "way": of_ways, "relation": of_relations}
    return both(*[f() for t, f in made.items() if known is None or t in known])


def with_metres(df: DataFrame, world: DataFrame) -> DataFrame:
    """df with `metres`: 0 of a node, the length of a way, and of a relation the sum over its way members; no list of places is made."""
    nodes, known = of_type(world, "node"), types_of(df)
    kept = {}

    def lengths(ways: DataFrame) -> DataFrame:
        placed = nodes.select(F.col("id").alias("ref"), degrees(F.col("lat_e7")).alias("lat"), degrees(F.col("lon_e7")).alias("lon"))
        line = W.partitionBy("id").orderBy("pos")
        rows = ways.select("id", F.posexplode("nds").alias("pos", "ref")).join(placed, "ref").drop("ref").withColumns({"lat2": F.lead("lat").over(line), "lon2": F.lead("lon").over(line)})
        return rows.groupBy("id").agg(F.sum(g.distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("metres"))

    placed = lambda own, found: own.join(found, "id", "left").select(*df.columns, F.coalesce("metres", F.lit(0.0)).alias("metres"))

    def of_ways() -> DataFrame:
        own, every = of_type(df, "way"), of_type(world, "way")
        if own is every and (known is None or "relation" in known):  # relations ask for the same lengths
            kept["way"] = stored(lengths(every), "lengths")
        return placed(own, kept.get("way") or lengths(own))

    def of_relations() -> DataFrame:
        own = of_type(df, "relation")
        edges = own.select("id", F.explode("members").alias("m")).filter("m.type = 'way'").select("id", "m.ref")
        ways = kept.get("way") or lengths(of_type(world, "way").join(edges.select(F.col("ref").alias("id")), "id", "left_semi"))
        return placed(own, edges.join(ways.withColumnRenamed("id", "ref"), "ref").groupBy("id").agg(F.sum("metres").alias("metres")))

    made = {"node": lambda: of_type(df, "node").select(*df.columns, F.lit(0.0).alias("metres")), "way": of_ways, "relation": of_relations}
    return both(*[f() for t, f in made.items() if known is None or t in known])


def turns(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pos, turn) of each inner place of the ways: the signed turn in degrees, null where a segment has no length."""
    lat, lon = F.radians(degrees(F.col("lat_e7"))), F.radians(degrees(F.col("lon_e7")))
    placed = of_type(nodes, "node").select(F.col("id").alias("ref"), F.sin(lat).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), (F.cos(lat) * F.cos(lon)).alias("z"))
    line = W.partitionBy("id").orderBy("pos")
    rows = of_type(ways, "way").select("id", F.posexplode("nds").alias("pos", "ref")).join(placed, "ref").drop("ref")
    rows = rows.withColumns({f"{c}{i}": f(c).over(line) for i, f in ((0, F.lag), (2, F.lead)) for c in "xyz"}).filter("x0 IS NOT NULL AND x2 IS NOT NULL")
    cross = lambda a, b: {"x": f"y{a} * z{b} - z{a} * y{b}", "y": f"z{a} * x{b} - x{a} * z{b}", "z": f"x{a} * y{b} - y{a} * x{b}"}
    rows = rows.select("id", "pos", *[F.col(c).alias(f"{c}{i}") if i == 1 else c for i, c in ((0, "x0"), (0, "y0"), (0, "z0"), (1, "x"), (1, "y"), (1, "z"), (2, "x2"), (2, "y2"), (2, "z2"))])
    rows = rows.select("id", "pos", "x1", "y1", "z1", *[F.expr(e).alias(f"u{c}") for c, e in cross(0, 1).items()], *[F.expr(e).alias(f"v{c}") for c, e in cross(1, 2).items()])
    sized = rows.select("id", "pos", F.expr("sqrt((ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz))").alias("size"), F.expr("ux * vx + uy * vy + uz * vz").alias("dot"), F.expr("x1 * (uy * vz - uz * vy) + y1 * (uz * vx - ux * vz) + z1 * (ux * vy - uy * vx)").alias("side"))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("dot", "size"))))) * F.when(F.col("side") < 0, -1.0).otherwise(1.0)
    return sized.select("id", "pos", F.when(F.col("size") > 1e-20, angle).alias("turn"))


def relation_areas(df: DataFrame, world: DataFrame) -> DataFrame:
    """Areas of the relations whose way members close: every end is met an even number of times and every way is known.

    The geometry is the members' lines; the even-odd rule takes their sides in any order, so rings need no joining.
    """
    relations, ways = of_type(df, "relation"), of_type(world, "way")
    found, lines = derive.ring_members(both(relations, ways))
    lines = lines.join(found.filter("whole AND even").select("id"), "id", "left_semi").join(derive.unpaired(lines, ways), "id", "left_anti")
    lines = stored(lines, "closed")
    placed = of_type(world, "node").select(F.col("id").alias("ref"), _place().alias("p"))
    at = nodes_of(ways).join(lines.select(F.col("ref").alias("id")), "id", "left_semi").join(placed, "ref")
    points = at.groupBy(F.col("id").alias("ref")).agg(F.sort_array(F.collect_list(F.struct("at", "p")))["p"].alias("points"))
    made = lines.join(points.filter(F.size("points") > 1), "ref", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "points")))["points"].alias("geometry"))
    known = relations.drop("geometry").join(made.filter(F.forall("geometry", lambda line: line.isNotNull())), "id")
    return elements(known.withColumn("id", F.col("id") + RELATION_AREA), "area")


def _cut(segments: DataFrame, size: float) -> DataFrame:
    """Segments `s` with each (row, column) of a grid that they pass: columns one by one, and in each the rows between the segment's two latitudes there."""
    a, b = F.col("s.a"), F.col("s.b")
    west, east = F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])
    by_column = segments.withColumn("column", F.explode(F.sequence(F.floor(west / size), F.floor(east / size))))
    at = lambda lon: a["lat"] + (lon - a["lon"]) * F.try_divide(b["lat"] - a["lat"], b["lon"] - a["lon"])
    first, last = at(F.greatest(west, F.col("column") * size)), at(F.least(east, (F.col("column") + 1) * size))
    south = F.coalesce(F.least(first, last), F.least(a["lat"], b["lat"])) - 1e-9
    north = F.coalesce(F.greatest(first, last), F.greatest(a["lat"], b["lat"])) + 1e-9
    steep = west == east
    low, high = F.when(steep, F.least(a["lat"], b["lat"])).otherwise(south), F.when(steep, F.greatest(a["lat"], b["lat"])).otherwise(north)
    return by_column.withColumn("row", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def inside(points: DataFrame, areas: DataFrame, size: float = 5.0) -> DataFrame:
    """The ids of the nodes inside any of the areas, borders included.

    A cell that no side of an area passes is wholly in or out of it, so its middle decides for all its nodes, and a node in
    a covered cell needs no test. The others meet the areas whose sides pass their cell. Cells are as many as the grid has at most.
    """
    cell = ["row", "column"]
    lat, lon = degrees(F.col("lat_e7")), degrees(F.col("lon_e7"))
    own = of_type(points, "node").select("id", lat.alias("lat"), lon.alias("lon"), F.floor(lat / size).alias("row"), F.floor(lon / size).alias("column"))
    cells = filters._cells(areas, size)
    passed = _cut(areas.select(F.col("id").alias("area"), F.explode(F.flatten(F.transform("geometry", g.pairs))).alias("s")), size).select("area", *cell).distinct()
    middle = lambda c: (F.col(c) + 0.5) * size
    whole = cells.join(passed, ["area", *cell], "left_anti").filter(g.in_ring(middle("row"), middle("column"), F.col("sides"), False)).select(*cell).distinct()
    whole = stored(whole, "cells")
    partly = cells.join(passed, ["area", *cell], "left_semi").select(*cell, "sides")
    rest = own.join(F.broadcast(whole), cell, "left_anti").join(partly, cell)
    return own.join(F.broadcast(whole), cell, "left_semi").select("id").unionByName(rest.filter(g.in_ring(F.col("lat"), F.col("lon"), F.col("sides"))).select("id")).distinct()


def ways_in_areas(ways: DataFrame, world: DataFrame, areas: DataFrame, size: float = 5.0, nodes: DataFrame | None = None) -> DataFrame:
    """Ways with a node inside an area or on its border, and ways that cross a side. nodes: the ids of `inside`, if they are known.

    Only ways without such a node need their segments, and of these only the cells that any side passes, which are as many
    as the grid has at most; then an equi-join on those cells.
    """
    own = of_type(ways, "way")
    met = stored(inside(of_type(world, "node"), areas, size), "inside") if nodes is None else nodes
    uses = stored(own.select("id", F.explode("nds").alias("ref")).join(met.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct(), "uses")
    rest = typed(own.join(uses, "id", "left_anti").select(*ways.columns), "way")
    segments = filters.with_points(rest, world).select("id", F.explode(g.pairs("points")).alias("s"))
    sides = stored(_cut(areas.select(F.explode(F.flatten(F.transform("geometry", g.pairs))).alias("s")), size).select("row", "column", F.col("s").alias("t")), "sides")
    near = _cut(segments, size).join(F.broadcast(sides.select("row", "column").distinct()), ["row", "column"], "left_semi")
    crossing = near.join(sides, ["row", "column"]).filter(filters.crosses(F.col("s"), F.col("t"))).select("id").distinct()
    return typed(own.join(uses.unionByName(crossing), "id", "left_semi").select(*ways.columns), "way")


def in_areas(df: DataFrame, world: DataFrame, areas: DataFrame) -> DataFrame:
    """Elements of any type in areas: nodes and ways by their places, relations by their node and way members."""
    known = types_of(df)
    if known == ["node"]:
        return typed(filters.in_areas(df, areas).select(*df.columns), "node")
    areas = stored(areas.select("id", "geometry"), "areas")
    met = stored(inside(of_type(world, "node"), areas), "inside")
    tests = {
        "node": lambda: typed(filters.in_areas(of_type(df, "node"), areas).select(*df.columns), "node"), "way": lambda: ways_in_areas(of_type(df, "way"), world, areas, nodes=met),
        "relation": lambda: typed(filters.relations_with(of_type(df, "relation"), met, ways_in_areas(of_type(world, "way"), world, areas, nodes=met)).select(*df.columns), "relation"),
    }
    return both(*[test() for t, test in tests.items() if known is None or t in known])


def is_in(points: DataFrame, areas: DataFrame, ways: DataFrame) -> DataFrame:
    """The areas that cover any of the nodes, and the closed ways that stand for such areas."""
    found = filters.is_in(points, areas)
    lines = found.select((F.col("id") - WAY_AREA).alias("id"))
    return both(typed(found, "area"), typed(pick(of_type(ways, "way"), closed()).join(lines, "id", "left_semi").select(*ways.columns), "way"))


def literal_point(world: DataFrame, lat: float, lon: float) -> DataFrame:
    """A place of a query as a node, for is_in."""
    place = world.sparkSession.range(1).select((F.col("id") + 1).alias("id"), F.lit(round(lat * 1e7)).alias("lat_e7"), F.lit(round(lon * 1e7)).alias("lon_e7"))
    return elements(place, "node")


def bounded(world: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """A world for a query with a global box: every filter that reads it meets elements of the box alone. Traversals take the whole world as their universe."""
    return filters.in_box(world, world, south, west, north, east)
