"""Output: how much of each element is shown, in which order, how many, and in which format.

Rows are formatted by Spark and written by its writers, in order where an order is asked for; nothing is collected.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import RANK, degrees, nodes_of, of_type, tag
from ..shared import stored

LEVELS = {
    "ids": (), "skel": ("lat_e7", "lon_e7", "nds", "members"), "tags": ("tags",), "body": ("lat_e7", "lon_e7", "nds", "members", "tags"),
    "meta": ("lat_e7", "lon_e7", "nds", "members", "tags", "version", "ts", "changeset", "uid", "user"),
}


def rank() -> Column:
    return reduce(lambda c, kv: c.when(F.col("etype") == kv[0], kv[1]), RANK.items(), F.when(F.lit(False), 0)).otherwise(5)


def level(df: DataFrame, name: str = "body", ids: bool = True) -> DataFrame:
    """The columns of a level of detail; without ids if wished."""
    return df.select("etype", *(["id"] if ids else []), *LEVELS[name])


def z_order(lat_e7: Column, lon_e7: Column) -> Column:
    """The interleaved upper 16 bits of both coordinates: places near each other get numbers near each other."""

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    upper = lambda c, low: F.shiftright(c + F.lit(low), 16).cast("bigint").bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return spread(upper(lat_e7, 910_000_000)).bitwiseOR(F.shiftleft(spread(upper(lon_e7, 1_800_000_000)), 1))


def ordered(df: DataFrame, by: str = "asc", limit: int | None = None) -> DataFrame:
    """Types in their fixed order, then by id (`asc`) or by place (`qt`); a limit counts over all types."""
    keys = [rank(), F.col("id")] if by == "asc" else [rank(), z_order(F.col("lat_e7"), F.col("lon_e7")), F.col("id")]
    out = df.orderBy(*keys)
    return out if limit is None else out.limit(limit)


def numbered(df: DataFrame, *keys: str, number: str = "place") -> DataFrame:
    """df with the number of each row, from 1, in the order of the keys: rows are dealt out by range and written, and each part counts on from those before."""
    ranged = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per part of the shuffle
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = ranged.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(*keys)))
    return own.join(F.broadcast(starts), "_part").withColumn(number, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_part", "_own", "_before")


def counts(df: DataFrame) -> DataFrame:
    """One row: how many nodes, ways, relations and areas, and their total; derived elements do not count."""
    of = lambda *t: F.count_if(F.col("etype").isin(*t))
    return df.agg(of("node").alias("nodes"), of("way").alias("ways"), of("relation").alias("relations"), of("area").alias("areas"), of(*RANK).alias("total"))


def with_box(df: DataFrame, points: str = "points") -> DataFrame:
    """df with `bounds` of its points and their `center`."""
    return df.withColumn("bounds", g.bounds(points)).withColumn("center", g.center(F.col("bounds")))


def clipped(df: DataFrame, south: float, west: float, north: float, east: float, points: str = "points") -> DataFrame:
    """df with points outside a box made null, but for those next to one inside."""
    inside = lambda p: F.coalesce(g.point_in_box(p["lat"], p["lon"], south, west, north, east), F.lit(False))
    p = F.col(points)
    near = F.transform(p, lambda x, i: F.when(inside(x) | inside(F.get(p, i - 1)) | inside(F.get(p, i + 1)), x))
    return df.withColumn(points, near)


# ---- formats ----

_SPECIAL = {
    "::id": lambda: F.col("id").cast("string"), "::type": lambda: F.col("etype"), "::otype": lambda: rank().cast("string"), "::lat": lambda: F.format_string("%.7f", degrees(F.col("lat_e7"))),
    "::lon": lambda: F.format_string("%.7f", degrees(F.col("lon_e7"))), "::version": lambda: F.col("version").cast("string"), "::timestamp": lambda: stamp("ts"),
    "::changeset": lambda: F.col("changeset").cast("string"), "::uid": lambda: F.col("uid").cast("string"), "::user": lambda: F.col("user"),
}


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A text column per key or `::` property; empty where an element has none. With `center` (see with_box), ways and relations have its place."""
    special = dict(_SPECIAL)
    if "center" in df.columns:
        for c, e7, part in (("::lat", "lat_e7", "center.lat"), ("::lon", "lon_e7", "center.lon")):
            special[c] = lambda e7=e7, part=part: F.format_string("%.7f", F.coalesce(degrees(F.col(e7)), F.col(part)))
        for c in ("::lat", "::lon"):
            special[c] = lambda made=special[c]: F.when(F.col("lat_e7").isNotNull() | F.col("center.lat").isNotNull(), made())
    return df.select(*[F.coalesce(special[c]() if c in special else F.lit(None) if c in _COUNTED else tag(c), F.lit("")).alias(c) for c in columns])


def _quoted(c: Column, separator: str) -> Column:
    return F.when(c.rlike('[",\n\r]') | c.contains(separator), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(df: DataFrame, columns: list[str], separator: str = "\t") -> DataFrame:
    """One line per element; fields with the separator, a quote or a line end are quoted."""
    table = csv_columns(df, columns)
    return table.select(F.concat_ws(separator, *[_quoted(F.col(f"`{c}`"), separator) for c in columns]).alias("value"))


#: The columns that only a row of counts fills, with its field.
_COUNTED = {"::count": "total", "::count:nodes": "nodes", "::count:ways": "ways", "::count:relations": "relations", "::count:areas": "areas"}


def csv_counts(df: DataFrame, columns: list[str], separator: str = "\t") -> DataFrame:
    """The line of a set's counts: the `::count` columns, and the type and number of a derived element."""
    own = {"::id": F.lit("0"), "::type": F.lit("count"), "::otype": F.lit("4")} | {c: F.col(n).cast("string") for c, n in _COUNTED.items()}
    tags = {"nodes", "ways", "relations", "areas", "total"}
    return counts(df).select(F.concat_ws(separator, *[own.get(c, F.col(c).cast("string") if c in tags else F.lit("")) for c in columns]).alias("value"))


def csv_header(df: DataFrame, columns: list[str], separator: str = "\t") -> DataFrame:
    """The header as one row, for a file of its own before those of the lines: `::` properties begin with @."""
    names = [f"@{c[2:]}" if c.startswith("::") else c for c in columns]
    return df.sparkSession.range(1).select(F.concat_ws(separator, *[_quoted(F.lit(n), separator) for n in names]).alias("value"))


def _shown_shape(df: DataFrame, shape: str | None) -> None:
    if shape not in (None, "bounds", "center", "geometry"):
        raise ValueError(f"unknown shape: {shape}")
    if shape and not {"shapes", "points"} <= set(df.columns) and not (shape != "geometry" and "bounds" in df.columns):
        raise ValueError("take shapes.with_shapes first, or shapes.with_bounds for bounds and centres")


def json_lines(df: DataFrame, detail: str = "body", shape: str | None = None) -> DataFrame:
    """One JSON object per element, as Spark's writers of text or a reader of lines want it.

    shape: `bounds`, `center` or `geometry` (bounds and all places) of elements that shapes.with_shapes has placed; nodes always show their place then.
    """
    _shown_shape(df, shape)
    shown = LEVELS[detail]
    if shape:
        return df.select(F.to_json(F.struct(*_json_with_shape(shown, shape, F.col("bounds") if "points" not in df.columns else g.bounds("points")))).alias("value"))
    parts = [F.col("etype").alias("type"), F.col("id")]
    if "lat_e7" in shown:
        parts += [degrees(F.col("lat_e7")).alias("lat"), degrees(F.col("lon_e7")).alias("lon")]
    if "version" in shown:
        parts += [stamp("ts").alias("timestamp"), F.col("version"), F.col("changeset"), F.col("user"), F.col("uid")]
    if "nds" in shown:
        parts += [F.col("nds").alias("nodes"), F.col("members")]
    if "tags" in shown:
        parts.append(_tag_map())
    return df.select(F.to_json(F.struct(*parts)).alias("value"))


def _tag_map() -> Column:
    first = lambda k: F.struct(k, F.get(F.filter("tags", lambda t: t["k"] == k), F.lit(0))["v"])
    return F.when(F.size("tags") > 0, F.map_from_entries(F.transform(F.array_distinct(F.transform("tags", lambda t: t["k"])), first))).alias("tags")


def _json_with_shape(shown: tuple[str, ...], shape: str, box: Column) -> list[Column]:
    node, way, relation = (F.col("etype") == t for t in ("node", "way", "relation"))
    parts = [F.col("etype").alias("type"), F.col("id"), F.when(node, degrees(F.col("lat_e7"))).alias("lat"), F.when(node, degrees(F.col("lon_e7"))).alias("lon")]
    if "version" in shown:
        parts += [stamp("ts").alias("timestamp"), F.col("version"), F.col("changeset"), F.col("user"), F.col("uid")]
    parts.append(F.when(~node, g.center(box)).alias("center") if shape == "center" else F.when(~node, box).alias("bounds"))
    geometry = shape == "geometry"
    if "nds" in shown:
        parts.append(F.when(F.size("nds") > 0, F.col("nds")).alias("nodes"))
    if geometry:
        parts.append(F.when(way, F.get("shapes", F.lit(0))).alias("geometry"))
    if "nds" in shown:
        at = lambda m, s: F.when(m["type"] == "node", F.get(s, F.lit(0)))
        placed = lambda m, s: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role"), at(m, s)["lat"].alias("lat"), at(m, s)["lon"].alias("lon"), F.when(m["type"] == "way", s).alias("geometry"))
        members = F.zip_with("members", "shapes", placed) if geometry else F.col("members")
        parts.append(F.when(relation & (F.size("members") > 0), members).alias("members"))
    return [*parts, _tag_map()] if "tags" in shown else parts


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _attribute(name: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), escape(c.cast("string")), F.lit('"')), F.lit(""))


def _place_attributes(p: Column) -> Column:
    """lat and lon of a point; nothing where it is unknown."""
    both_of = F.concat(F.lit(' lat="'), F.format_string("%.7f", p["lat"]), F.lit('" lon="'), F.format_string("%.7f", p["lon"]), F.lit('"'))
    return F.when(p["lat"].isNotNull(), both_of).otherwise("")


def _xml_element(get, detail: str, shape: str | None = None) -> Column:
    """The text of one element; get(name) is the column that holds a property. shape `made`: of a relation whose `_box` and text of `_members` are columns."""
    shown = LEVELS[detail]
    node = F.col("etype") == "node"
    e7 = F.struct(degrees(get("lat_e7")).alias("lat"), degrees(get("lon_e7")).alias("lon")) if "lat_e7" in shown or shape else None
    head = [F.lit("<"), F.col("etype"), _attribute("id", F.col("id"))]
    if e7 is not None:
        head.append(_place_attributes(e7))
    if "version" in shown:
        head += [_attribute("version", get("version")), _attribute("timestamp", stamp(get("ts"))), _attribute("changeset", get("changeset")), _attribute("uid", get("uid")), _attribute("user", get("user"))]
    inner = []
    if shape in ("bounds", "geometry", "made"):
        box = get("_box") if shape == "made" else g.bounds(get("points"))
        inner.append(F.when(~node & box.isNotNull(), F.concat(F.lit("<bounds"), *[_attribute(n, F.format_string("%.7f", box[n])) for n in ("minlat", "minlon", "maxlat", "maxlon")], F.lit("/>"))))
    elif shape == "center":
        middle = g.center(g.bounds(get("points")))
        inner.append(F.when(~node & middle["lat"].isNotNull(), F.concat(F.lit("<center"), _place_attributes(middle), F.lit("/>"))))
    if "nds" in shown and shape == "made":
        inner.append(get("_members"))
    elif "nds" in shown:
        line = F.get(get("shapes"), F.lit(0)) if shape == "geometry" else None
        at = (lambda i: _place_attributes(F.get(line, i))) if line is not None else (lambda i: F.lit(""))
        inner.append(F.array_join(F.transform(get("nds"), lambda n, i: F.concat(F.lit('<nd ref="'), n.cast("string"), F.lit('"'), at(i), F.lit("/>"))), ""))
        named = lambda m: F.concat(F.lit('<member type="'), m["type"], F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), escape(m["role"]), F.lit('"'))
        if shape == "geometry":
            nodes = lambda s: F.array_join(F.transform(s, lambda p: F.concat(F.lit("<nd"), _place_attributes(p), F.lit("/>"))), "")
            placed = lambda m, s: F.when((m["type"] == "way") & (F.size(s) > 0), F.concat(named(m), F.lit(">"), nodes(s), F.lit("</member>"))).otherwise(F.concat(named(m), F.when(m["type"] == "node", _place_attributes(F.get(s, F.lit(0)))).otherwise(""), F.lit("/>")))
            members = F.zip_with(get("members"), get("shapes"), placed)
            inner.append(F.when(F.col("etype") == "relation", F.array_join(members, "")))
        else:
            inner.append(F.array_join(F.transform(get("members"), lambda m: F.concat(named(m), F.lit("/>"))), ""))
    if "tags" in shown:
        inner.append(F.array_join(F.transform(get("tags"), lambda t: F.concat(F.lit('<tag k="'), escape(t["k"]), F.lit('" v="'), escape(t["v"]), F.lit('"/>'))), ""))
    body = F.concat_ws("", *inner) if inner else F.lit("")
    return F.concat(*head, F.when(body == "", "/>").otherwise(F.concat(F.lit(">"), body, F.lit("</"), F.col("etype"), F.lit(">"))))


def xml_lines(df: DataFrame, detail: str = "body", shape: str | None = None) -> DataFrame:
    """One XML element per row; header and footer are the caller's, since files are written in parts. shape as for JSON."""
    _shown_shape(df, shape)
    return df.select(_xml_element(F.col, detail, shape).alias("value"))


def xml_relations(df: DataFrame, world: DataFrame, detail: str = "body") -> DataFrame:
    """The lines that xml_lines gives for the relations of shapes.with_shapes with `geometry`: places and members become texts as rows, and no list of places is made."""
    own, nodes, ways = of_type(df, "relation"), of_type(world, "node"), of_type(world, "way")
    sides = {"minlat": ("lat_e7", F.min), "minlon": ("lon_e7", F.min), "maxlat": ("lat_e7", F.max), "maxlon": ("lon_e7", F.max)}
    joined = lambda text: F.array_join(F.sort_array(F.collect_list(F.struct("pos", text.alias("x"))))["x"], "")
    at = nodes.select(F.col("id").alias("ref"), "lat_e7", "lon_e7", _place_attributes(F.struct(degrees(F.col("lat_e7")).alias("lat"), degrees(F.col("lon_e7")).alias("lon"))).alias("at"))
    edges = own.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.*")
    of = lambda t: edges.filter(F.col("type") == t)
    used = ways.select("id").join(of("way").select(F.col("ref").alias("id")), "id", "left_semi")
    lines = nodes_of(ways).select("id", F.col("at").alias("pos"), "ref").join(used, "id", "left_semi").join(at, "ref").groupBy(F.col("id").alias("ref")).agg(joined(F.concat(F.lit("<nd"), F.col("at"), F.lit("/>"))).alias("at"), *[f(c).alias(n) for n, (c, f) in sides.items()])
    named = F.concat(F.lit('<member type="'), F.col("type"), F.lit('" ref="'), F.col("ref").cast("string"), F.lit('" role="'), escape(F.col("role")), F.lit('"'))
    found = [
        (of("node").join(at, "ref", "left"), F.concat(named, F.coalesce("at", F.lit("")), F.lit("/>")), {n: F.col(c) for n, (c, _) in sides.items()}),
        (of("way").join(lines, "ref", "left"), F.when(F.col("at").isNotNull(), F.concat(named, F.lit(">"), F.col("at"), F.lit("</member>"))).otherwise(F.concat(named, F.lit("/>"))), {n: F.col(n) for n in sides}),
        (edges.filter("type NOT IN ('node', 'way')"), F.concat(named, F.lit("/>")), {n: F.lit(None).cast("bigint") for n in sides}),
    ]
    texts = reduce(DataFrame.unionByName, [rows.select("id", "pos", text.alias("text"), *[c.alias(n) for n, c in box.items()]) for rows, text, box in found])
    made = texts.groupBy("id").agg(joined(F.col("text")).alias("_members"), *[f(n).alias(n) for n, (_, f) in sides.items()])
    box = F.when(F.col("minlat").isNotNull(), F.struct(*[degrees(F.col(n)).alias(n) for n in sides]))
    return own.join(made, "id", "left").withColumn("_box", box).select(_xml_element(F.col, detail, "made").alias("value"))


def xml_diff_lines(found: DataFrame, detail: str = "body", augmented: bool = False) -> DataFrame:
    """One action per row of history.difference: create shows the new state, modify both, delete the old one.

    augmented: a deleted element is shown as new without content, visible if it exists and has only left the result.
    """
    old, new = (_xml_element(lambda c, side=side: F.col(f"{side}.{c}"), detail) for side in ("old", "new"))
    action = F.col("action")
    left = F.concat(F.lit("<"), F.col("etype"), _attribute("id", F.col("id")), F.when(action == "push_away", ' visible="true"/>').otherwise(' visible="false"/>'))
    gone = F.concat(F.lit("<new>"), left, F.lit("</new>")) if augmented else F.lit("")
    text = (
        F.when(action == "create", F.concat(F.lit('<action type="create">'), new)).when(action == "modify", F.concat(F.lit('<action type="modify"><old>'), old, F.lit("</old><new>"), new, F.lit("</new>")))
        .otherwise(F.concat(F.lit('<action type="delete"><old>'), old, F.lit("</old>"), gone))
    )
    return found.select(F.concat(text, F.lit("</action>")).alias("value"))


def template_lines(df: DataFrame, template: str) -> DataFrame:
    """A text per element from a template with {{{id}}}, {{{lat}}}, {{{lon}}}, {{{type}}} and {{{a key}}}."""
    own = {"id": "::id", "lat": "::lat", "lon": "::lon", "type": "::type"}
    parts = []
    for i, piece in enumerate(re.split(r"\{\{\{(.*?)\}\}\}", template)):
        special = _SPECIAL.get(own.get(piece, ""))
        parts.append(F.lit(piece) if i % 2 == 0 else F.coalesce(special() if special else tag(piece), F.lit("")))
    return df.select(F.concat(*parts).alias("value"))


def popup_lines(df: DataFrame, categories: list[tuple[str, str, Column]]) -> DataFrame:
    """(category, value): an HTML paragraph per element under the first of (title, key of its name, test) that fits."""
    title = reduce(lambda c, x: c.when(x[2], x[0]), categories, F.when(F.lit(False), ""))
    name = reduce(lambda c, x: c.when(x[2], tag(x[1])), categories, F.when(F.lit(False), ""))
    rows = F.array_join(F.transform("tags", lambda t: F.concat(escape(t["k"]), F.lit(": "), escape(t["v"]))), "<br/>")
    return df.select(title.alias("category"), F.concat(F.lit("<p><strong>"), escape(name), F.lit("</strong><br/>"), rows, F.lit("</p>")).alias("value")).filter("category IS NOT NULL")
