"""More registered queries: shapes of all types, areas as filters of ways and relations, documents with places, differences as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import geometry as g
from ..functions import members, text
from ..model import KEY, degrees, of_type, pick, tag
from ..operators import derive, filters, history, output, sets, shapes
from ..sources import star
from .catalog import _AREA_SIDES, _BOX, _CROSS, _FINAL, _IN_BOX, _INSIDE, _ODD, _ON, _SINCE, _STEP, _TWO, _UNTIL, _WAY_BOX, QUERIES, SQL, _final, _nodes, _relations, _thirteen, _ways, ids, query  # noqa: F401

# ---- output ----

_TYPES = "(SELECT count(*) FROM {})"
_N = {t: _TYPES.format(t) for t in ("node", "way", "rel")}


@query("SELECT '@type' || chr(9) || '@id' || chr(9) || 'brand' AS value")
def output_csv_header(w):
    return output.csv_header(w, ["::type", "::id", "brand"])


@query(f"SELECT 'count,4,0,' || ({_N['node']} + {_N['way']} + {_N['rel']}) || ',' || {_N['node']} || ',' || {_N['way']} || ',' || {_N['rel']} || ',0,' || {_N['way']} || ',' AS value")
def output_csv_counts(w):
    return output.csv_counts(w, ["::type", "::otype", "::id", "::count", "::count:nodes", "::count:ways", "::count:relations", "::count:areas", "ways", "brand"], ",")


@query("SELECT 'way' || chr(9) || way || chr(9) || printf('%.7f', (min(lat) + max(lat)) / 2) || chr(9) || printf('%.7f', (min(lon) + max(lon)) / 2) AS value FROM waynd JOIN node ON node.id = ref GROUP BY way UNION ALL SELECT 'way' || chr(9) || id || chr(9) || chr(9) FROM way WHERE id NOT IN (SELECT way FROM waynd)")
def output_csv_center(w):
    return output.csv_lines(output.with_box(shapes.with_shapes(_ways(w), w)), ["::type", "::id", "::lat", "::lon"])


@query("SELECT lat_e7, lon_e7, brand FROM node")
def output_noids(w):
    rows = output.level(_nodes(w), "body", ids=False)
    assert "id" not in rows.columns
    return rows.select("lat_e7", "lon_e7", tag("brand").alias("brand"))


_POINTS = """pts AS (SELECT 'node' AS etype, id, lat, lon FROM node UNION ALL SELECT 'way', way, lat, lon FROM waynd JOIN node ON node.id = ref UNION ALL
SELECT 'relation', m.id, lat, lon FROM member m JOIN node ON node.id = m.ref AND m.type = 'node' UNION ALL SELECT 'relation', m.id, lat, lon FROM member m JOIN waynd ON waynd.way = m.ref AND m.type = 'way' JOIN node ON node.id = waynd.ref),
keys AS (SELECT 'way' AS etype, id FROM way UNION ALL SELECT 'relation', id FROM rel),
boxes AS (SELECT keys.etype, keys.id, min(lat) AS minlat, min(lon) AS minlon, max(lat) AS maxlat, max(lon) AS maxlon FROM keys LEFT JOIN pts ON pts.etype = keys.etype AND pts.id = keys.id GROUP BY keys.etype, keys.id)"""
_EDGES = ("minlat", "minlon", "maxlat", "maxlon")


def _parsed(rows, shape, *columns):
    """Columns of JSON lines; shape: their fields. A line is read once."""
    return rows.select(F.from_json("value", f"type string, id bigint, {shape}").alias("x")).select(F.col("x.type").alias("etype"), "x.id", *columns)


@query(f", {_POINTS} SELECT * FROM boxes")
def output_json_bounds(w):
    rows = shapes.with_bounds(of_type(w, "way", "relation"), w)
    box = ", ".join(f"{e}: double" for e in _EDGES)
    return _parsed(output.json_lines(rows, "body", "bounds"), f"bounds struct<{box}>", *[f"x.bounds.{e}" for e in _EDGES])


@query(f", {_POINTS} SELECT etype, id, (minlat + maxlat) / 2 AS lat, (minlon + maxlon) / 2 AS lon FROM boxes UNION ALL SELECT 'node', id, lat, lon FROM node")
def output_json_center(w):
    found = output.json_lines(shapes.with_bounds(w, w), "tags", "center")
    return _parsed(found, "lat double, lon double, center struct<lat: double, lon: double>", *[F.coalesce(f"x.{c}", f"x.center.{c}").alias(c) for c in ("lat", "lon")])


@query("SELECT way AS id, '[' || string_agg('{\"lat\":' || lat || ',\"lon\":' || lon || '}', ',' ORDER BY pos) || ']' AS geometry, '[' || string_agg(ref, ',' ORDER BY pos) || ']' AS nodes FROM waynd JOIN node ON node.id = ref GROUP BY way")
def output_json_geometry(w):
    rows = output.json_lines(shapes.with_shapes(pick(_ways(w), "size(nds) > 0"), w), "skel", "geometry")
    return rows.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.get_json_object("value", "$.geometry").alias("geometry"), F.get_json_object("value", "$.nodes").alias("nodes"))


_AT = "' lat=\"' || printf('%.7f', lat) || '\" lon=\"' || printf('%.7f', lon) || '\"'"


@query(f""", {_POINTS}, lines AS (SELECT way, string_agg('<nd' || {_AT} || '/>', '' ORDER BY pos) AS nds FROM waynd JOIN node ON node.id = ref GROUP BY way),
shown AS (SELECT m.id, m.type, m.ref, m.role, '<member type="' || m.type || '" ref="' || m.ref || '" role="' || m.role || '"' || CASE WHEN lines.nds IS NOT NULL THEN '>' || lines.nds || '</member>' WHEN node.id IS NOT NULL THEN {_AT} || '/>' ELSE '/>' END AS x
  FROM member m LEFT JOIN lines ON m.type = 'way' AND lines.way = m.ref LEFT JOIN node ON m.type = 'node' AND node.id = m.ref)
SELECT '<relation id="' || b.id || '"' || CASE WHEN list IS NULL AND minlat IS NULL THEN '/>' ELSE '>' || coalesce('<bounds minlat="' || printf('%.7f', minlat) || '" minlon="' || printf('%.7f', minlon) || '" maxlat="' || printf('%.7f', maxlat) || '" maxlon="' || printf('%.7f', maxlon) || '"/>', '') || coalesce(list, '') || '</relation>' END AS value
FROM boxes b LEFT JOIN (SELECT id, string_agg(x, '' ORDER BY type, ref, role) AS list FROM shown GROUP BY id) l ON l.id = b.id WHERE etype = 'relation'""")
def output_xml_geometry(w):
    return output.xml_relations(_relations(w), w, "skel")


@query("SELECT '<way id=\"' || id || '\"' || coalesce('><center lat=\"' || printf('%.7f', lat) || '\" lon=\"' || printf('%.7f', lon) || '\"/></way>', '/>') AS value FROM way LEFT JOIN (SELECT way, (min(lat) + max(lat)) / 2 AS lat, (min(lon) + max(lon)) / 2 AS lon FROM waynd JOIN node ON node.id = ref GROUP BY way) b ON b.way = id")
def output_xml_center(w):
    return output.xml_lines(shapes.with_shapes(_ways(w), w), "ids", "center")


def _element_sql(t: str) -> str:
    return f"'<node id=\"' || {t}.id || '\"><tag k=\"event_type\" v=\"' || {t}.event_type || '\"/>' || coalesce('<tag k=\"k\" v=\"' || {t}.k || '\"/>', '') || '</node>'"


@query(f"""SELECT CASE WHEN o.id IS NULL THEN '<action type="create">' || {_element_sql('n')} || '</action>' WHEN n.id IS NULL THEN '<action type="delete"><old>' || {_element_sql('o')} || '</old><new><node id="' || o.id || '" visible="false"/></new></action>'
ELSE '<action type="modify"><old>' || {_element_sql('o')} || '</old><new>' || {_element_sql('n')} || '</new></action>' END AS value FROM {_TWO} WHERE o.version IS DISTINCT FROM n.version""")
def output_xml_diff(spark, d):
    h = star.history(spark, d)
    return output.xml_diff_lines(history.difference(history.snapshot(h, _SINCE), history.snapshot(h, _UNTIL)), "tags", augmented=True)


# ---- places ----


@query(f"SELECT 'node' AS etype, id FROM node WHERE {_IN_BOX} AND brand = 'Brand#13' UNION ALL SELECT 'way', id FROM {_WAY_BOX} WHERE id IN {_FINAL}")
def global_bbox(w):
    box = shapes.bounded(w, *_BOX)
    return ids(_thirteen(box)).unionByName(ids(_final(box)))


_AREA_WAY = f"(SELECT way AS id FROM waynd WHERE ref IN (SELECT id FROM ({_INSIDE})) UNION SELECT way FROM seg, {_AREA_SIDES} s WHERE {_CROSS})"


@query(f"SELECT 'way' AS etype, id FROM {_AREA_WAY} WHERE id IN {_FINAL}")
def area_ways(w):
    return ids(shapes.in_areas(_final(w), w, filters.areas_of(w, w)))


@query(f"SELECT DISTINCT 'relation' AS etype, id FROM member WHERE (type = 'node' AND ref IN (SELECT id FROM ({_INSIDE}))) OR (type = 'way' AND ref IN (SELECT id FROM {_AREA_WAY}))")
def area_relations(w):
    return ids(shapes.in_areas(_relations(w), w, filters.areas_of(w, w)))


_OVER = f"(SELECT area FROM (SELECT 12.345::DOUBLE AS lat, 20.678::DOUBLE AS lon), {_AREA_SIDES} s GROUP BY area HAVING {_ODD} OR {_ON})"


@query(f"SELECT 'area' AS etype, area + 2400000000 AS id FROM {_OVER} UNION ALL SELECT 'way', area FROM {_OVER}")
def is_in_point(w):
    return ids(shapes.is_in(shapes.literal_point(w, 12.345, 20.678), filters.areas_of(w, w), w))


@query("""SELECT m.id + 3600000000 AS id, sum(n - 1)::BIGINT AS sides FROM member m JOIN (SELECT way, max(n) AS n FROM waynd GROUP BY way) l ON m.type = 'way' AND l.way = m.ref
WHERE m.id NOT IN (SELECT m.id FROM member m JOIN (SELECT way, ref FROM waynd WHERE pos = 1 UNION ALL SELECT way, ref FROM waynd WHERE pos = n) e ON e.way = m.ref AND m.type = 'way' GROUP BY m.id, e.ref HAVING count(*) % 2 = 1)
GROUP BY m.id HAVING min(n) > 1 AND count(*) = (SELECT count(*) FROM member k WHERE k.id = m.id AND k.type = 'way')""")
def derive_relation_areas(w):
    made = shapes.relation_areas(w, w)
    return made.select("id", F.aggregate("geometry", F.lit(0), lambda a, line: a + F.size(line) - 1).cast("bigint").alias("sides"))


# ---- expressions ----


@query(f""", len AS (SELECT way, sum({_STEP}) AS m FROM seg GROUP BY way) SELECT 'node' AS etype, id, 0.0::DOUBLE AS km FROM node UNION ALL SELECT 'way', id, round(coalesce(m, 0) / 1000, 2) FROM way LEFT JOIN len ON way = id UNION ALL
SELECT 'relation', rel.id, round(coalesce(sum(m), 0) / 1000, 2) FROM rel LEFT JOIN member ON member.id = rel.id AND type = 'way' LEFT JOIN len ON way = ref GROUP BY rel.id""")
def expression_length(w):
    return shapes.with_metres(w, w).select(*KEY, F.round(F.col("metres") / 1000, 2).alias("km"))


@query(f", {_POINTS} SELECT etype, id, coalesce(printf('%.7f', (minlat + maxlat) / 2), 'NaN') AS lat, coalesce(printf('%.7f', (minlon + maxlon) / 2), 'NaN') AS lon FROM boxes UNION ALL SELECT 'node', id, printf('%.7f', lat), printf('%.7f', lon) FROM node")
def expression_lat_lon(w):
    return shapes.with_bounds(w, w).select(*KEY, members.lat(None).alias("lat"), members.lon(None).alias("lon"))


@query("""SELECT way AS id, string_agg(pos || ':' || printf('%.3f', lat), ';' ORDER BY pos) AS list FROM waynd x JOIN node ON node.id = ref
WHERE n > 2 AND pos > 1 AND (pos < n OR ref = (SELECT ref FROM waynd y WHERE y.way = x.way AND y.pos = 1)) GROUP BY way""")
def expression_per_vertex(w):
    rows = shapes.with_shapes(pick(_ways(w), "size(nds) > 2"), w)
    one = members.per_vertex(lambda before, at, after, i: F.concat_ws(":", i.cast("string"), members.fixed(at["lat"], 3)))
    return rows.select("id", one.alias("list"))


@query("SELECT id, count(DISTINCT ref)::VARCHAR AS n FROM member WHERE role = 'O' AND type = 'way' GROUP BY id UNION ALL SELECT id, '0' FROM rel WHERE id NOT IN (SELECT id FROM member WHERE role = 'O' AND type = 'way')")
def expression_distinct_by_role(w):
    return _relations(w).select("id", members.count_distinct_by_role("O", "way").alias("n"))


@query("SELECT id, CAST(CAST(size AS INT) + (SELECT max(CAST(size AS INT)) FROM node WHERE brand = 'Brand#13') AS VARCHAR) AS more, (SELECT min(brand) FROM node WHERE brand = 'Brand#13') AS brand FROM node")
def expression_set_property(w):
    rows = sets.with_property(_nodes(w), "most", _thirteen(w), agg.largest(tag("size")))
    rows = sets.with_property(rows, "same", _thirteen(w), agg.unique(tag("brand")))
    return rows.select("id", text.plus(tag("size"), F.col("most")).alias("more"), F.col("same").alias("brand"))


@query("SELECT id, '<' || name || '>' AS name, '7' AS size, '<' || brand || '>' AS brand, '' AS type FROM node")
def derive_each_key(w):
    made = derive.convert_each(_nodes(w), "thing", lambda k, v: F.concat(F.lit("<"), v, F.lit(">")), {"size": F.lit("7")}, drop=("type",))
    return made.select("id", *[tag(k).alias(k) for k in ("name", "size", "brand", "type")])


@query("""SELECT 1::BIGINT AS id, k, v FROM (SELECT 'brand' AS k, 'Brand#13' AS v UNION ALL SELECT 'n', count(*)::VARCHAR FROM node WHERE brand = 'Brand#13'
UNION ALL SELECT 'size', CASE WHEN min(size) = max(size) THEN min(size) ELSE '< multiple values found >' END FROM node WHERE brand = 'Brand#13')""")
def derive_make_each(w):
    made = derive.make_each(_thirteen(w), "stat", {"n": agg.count("node")}, drop=("name", "type"))
    return made.select("id", F.explode("tags").alias("t")).select("id", "t.k", "t.v")


@query("SELECT id FROM node WHERE brand LIKE '%3'")
def filter_derived_tags(w):
    made = derive.convert(_nodes(w), "thing", {"label": tag("brand")})
    return made.filter(filters.value_like("label", "3$")).select("id")


@query("SELECT id, 2::BIGINT AS points, round(lat, 3) AS lat FROM node")
def geometry_derived_line(w):
    own = g.point(degrees(F.col("lat_e7")), degrees(F.col("lon_e7")))
    made = derive.convert(_nodes(w), "line", geometry=g.line(own, g.point(F.lit(0.0), F.lit(0.0))))
    return made.select("id", F.size(F.flatten("geometry")).cast("bigint").alias("points"), F.round(F.get(F.flatten("geometry"), F.lit(0))["lat"], 3).alias("lat"))


# ---- time ----


@query(f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'erase' ELSE 'modify' END AS action FROM {_TWO} WHERE o.event_type IS DISTINCT FROM n.event_type")
def time_diff_derived(spark, d):
    h = star.history(spark, d)
    made = lambda at: derive.convert(history.snapshot(h, at), "state", {"is": tag("event_type")})
    return history.difference(made(_SINCE), made(_UNTIL), compared=("tags", "geometry")).select("id", "action")


@query("""SELECT id, v AS version, t AS ts, lead(t) OVER (PARTITION BY id ORDER BY v) AS valid_to FROM (SELECT *, min(t) OVER (PARTITION BY id ORDER BY v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (
  SELECT *, row_number() OVER (PARTITION BY id, v ORDER BY t DESC) AS place FROM (SELECT id, CAST((version + 1) // 2 AS INT) AS v, ts + to_days(CAST(version * 7 % 5 AS INT)) AS t FROM ver)) WHERE place = 1) WHERE after IS NULL OR t < after""")
def time_versions(spark, d):
    """Changes in which numbers repeat and times run backwards."""
    moved = star.history(spark, d).withColumn("ts", F.expr("ts + make_dt_interval(version * 7 % 5)")).withColumn("version", F.expr("CAST((version + 1) DIV 2 AS INT)"))
    return history.versions(moved).select("id", "version", "ts", "valid_to")
