"""Operators on a small hand-built world: tags with repeated and empty keys, cycles, empty ways, the antimeridian."""

import pytest
from geoloom.functions import members
from geoloom.model import COLUMNS, both, closed, elements, tag
from geoloom.operators import derive, filters, history, output, sets, shapes, traverse
from geoloom.sources import osm
from geoloom.streaming.changes import Versions, merge, stream_changes
from pyspark.sql import functions as F

NODES = [(i, lat, lon) for i, (lat, lon) in enumerate([(10.0, 1.0), (10.0, 1.1), (10.0, 1.2), (10.1, 1.0), (10.1, 1.1), (10.1, 1.2), (0.0, 179.9), (0.0, -179.9)], 1)]
WAYS = [(11, [1, 2, 3]), (12, [3, 6, 5, 4, 1]), (13, [1, 2, 5, 4, 1]), (14, []), (15, [7, 8])]
RELATIONS = [(21, [("node", 1, "a"), ("way", 11, "b"), ("node", 1, "a")]), (22, [("relation", 21, "")]), (23, [("relation", 22, ""), ("relation", 23, "")])]


@pytest.fixture(scope="module")
def world(spark):
    pairs = "tags array<struct<k:string,v:string>>"
    tags = {1: [("k", "x"), ("k", "y"), ("", "")], 2: [("n", "5 m")], 3: []}
    nodes = spark.createDataFrame([(i, round(a * 1e7), round(b * 1e7), tags.get(i, [])) for i, a, b in NODES], f"id long, lat_e7 long, lon_e7 long, {pairs}")
    ways = spark.createDataFrame([(i, n, []) for i, n in WAYS], f"id long, nds array<long>, {pairs}")
    relations = spark.createDataFrame([(i, m, []) for i, m in RELATIONS], f"id long, members array<struct<type:string,ref:long,role:string>>, {pairs}")
    return both(elements(nodes, "node"), elements(ways, "way"), elements(relations, "relation"))


def keys(df):
    rows = [(r.etype, r.id) for r in df.select("etype", "id").collect()]
    assert len(rows) == len(set(rows)), "elements repeat"
    return set(rows)


def of(kind, *ids):
    return {(kind, i) for i in ids}


def test_tags(world):
    n = world.filter("etype = 'node'")
    assert keys(n.filter(filters.has_value("k", "y"))) == of("node", 1) and n.filter("id = 1").select(tag("k")).first()[0] == "x"
    assert keys(n.filter(filters.has_key(""))) == of("node", 1) and len(keys(n.filter(filters.lacks_value("k", "x")))) == 7
    assert keys(n.filter(filters.pair_like(".*", "^5"))) == of("node", 2) and keys(n.filter(filters.value_like("k", "."))) == of("node", 1)


def test_traversals(world):
    pick = lambda *ids: world.filter(F.col("id").isin(*ids))
    assert keys(traverse.down(world, pick(21))) == of("way", 11) | of("node", 1, 2, 3)
    assert keys(traverse.down_all(world, pick(23))) == of("relation", 21, 22, 23) | of("way", 11) | of("node", 1, 2, 3)
    assert keys(traverse.up(world, pick(1))) == of("way", 11, 12, 13) | of("relation", 21)
    assert keys(traverse.up_all(world, pick(1))) == of("way", 11, 12, 13) | of("relation", 21, 22, 23)
    assert keys(traverse.way_nodes(world, pick(12), (1, -2))) == of("node", 3, 4)
    assert keys(traverse.way_count(world, world.filter("etype = 'way'"), 3)) == of("node", 1)
    assert keys(traverse.way_link(world, pick(11, 12), 2, 2)) == of("node", 1, 2, 3, 4, 5, 6)
    assert keys(traverse.members(world, pick(21), ("node",), "b")) == set() and keys(traverse.members(world, pick(21), ("way",), "b")) == of("way", 11)
    assert keys(traverse.parents(world, pick(3), "way", "node", positions=(-1,))) == of("way", 11)
    assert keys(sets.complete(pick(23), lambda new: traverse.members(world, new, ("relation",)))) == of("relation", 21, 22, 23)


def test_places(world):
    assert keys(filters.in_box(world, world, 9.0, 0.9, 10.05, 1.05)) == of("node", 1) | of("way", 11, 12, 13) | of("relation", 21)
    assert keys(filters.in_box(world.filter("etype = 'node'"), world, -1.0, 179.0, 1.0, -179.0)) == of("node", 7, 8)
    n = world.filter("etype = 'node'")
    assert keys(filters.around(n, n.filter("id = 7"), 30_000)) == of("node", 7, 8)
    assert keys(filters.around(n, n.filter("id = 2"), 0)) == of("node", 2)
    with pytest.raises(ValueError):
        filters.around(n, n, -1)
    assert keys(filters.in_polygon(n, world, [(9.9, 0.9), (9.9, 1.15), (10.2, 1.15), (10.2, 0.9)])) == of("node", 1, 2, 4, 5)
    areas = filters.areas_of(world, world)
    assert keys(areas) == {("area", 2_400_000_013)} and keys(filters.in_areas(n, areas)) == of("node", 1, 2, 4, 5)
    assert keys(filters.map_to_area(world, areas)) == of("area", 2_400_000_013) | of("way", 13)
    assert keys(filters.pivot(world, areas)) == of("way", 13) and keys(world.filter("etype = 'way'").filter(closed())) == of("way", 13)
    assert keys(filters.is_in(n.filter("id = 6"), areas)) == set()


def test_sets_and_branches(world):
    a, b = world.filter("id < 4"), world.filter("id IN (3, 4, 11)")
    assert keys(sets.union(a, b)) == of("node", 1, 2, 3, 4) | of("way", 11) and keys(sets.difference(a, b)) == of("node", 1, 2) and keys(sets.intersection(a, b)) == of("node", 3)
    assert keys(sets.when(a, F.lit("0"), lambda: a, lambda: b)) == keys(b)


def test_links(spark, world):
    rows = {(r.way, r.part): r.nds for r in derive.local_links(world.filter("etype = 'way'"), world).collect()}
    assert rows[15, 1] == [7, 8] and rows[11, 1] == [1, 2] and rows[11, 2] == [2, 3] and rows[12, 1] == [3, 6, 5]
    alone = derive.local_links(world.filter("id = 12"), world).collect()
    assert [(r.part, r.nds) for r in alone] == [(1, [3, 6, 5, 4, 1])]
    tagged = derive.local_links(world.filter("(etype = 'way' AND id = 11) OR (etype = 'node' AND id = 2)"), world).collect()
    assert sorted(r.nds for r in tagged) == [[1, 2], [2, 3]]
    missing = world.filter("NOT (etype = 'node' AND id = 6)")
    assert {r.way for r in derive.local_links(world.filter("etype = 'way'"), missing).collect()} == {11, 13, 15}


def test_vertices_that_share_a_place(spark):
    pairs = "tags array<struct<k:string,v:string>>"
    nodes = elements(spark.createDataFrame([(1, 5, 5, [("_a", "x")]), (2, 5, 5, []), (3, 5, 6, [("a", "y")])], f"id long, lat_e7 long, lon_e7 long, {pairs}"), "node")
    found = {r.id: [(t.k, t.v) for t in r.tags] for r in derive.local_vertices(nodes, nodes, every=True).collect()}
    assert found == {1: [("__a", "x"), ("_local_id", "1"), ("_node_ref", "1")], 2: [("_local_id", "2"), ("_node_ref", "2")], 3: [("_node_ref", "3"), ("a", "y")]}
    assert {r.id for r in derive.local_vertices(nodes, nodes).collect()} == {1, 3}


def test_a_traversal_reads_each_table_few_times(spark):
    """Steps share written keys, and a step on one type does not plan the tables of the others."""
    from geoloom.plans import catalog

    for name in ("recurse_up", "map_call", "recurse_down"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 20, (name, plan.count("Relation ["))


def test_types_stay_known(world):
    from geoloom.model import of_type, pick, types_of

    assert types_of(world) == ["node", "way", "relation"] and types_of(of_type(world, "way")) == ["way"] and types_of(world.filter("id > 0")) is None
    some = pick(world, "id < 12")
    assert types_of(some) == ["node", "way", "relation"] and keys(some) == of("node", *range(1, 9)) | of("way", 11)
    assert keys(of_type(of_type(world, "way"), "node")) == set() and keys(of_type(world, "way", "node")) == of("node", *range(1, 9)) | of("way", 11, 12, 13, 14, 15)
    assert keys(both(of_type(world, "way"), of_type(world, "relation"))) == of("way", 11, 12, 13, 14, 15) | of("relation", 21, 22, 23)


def test_numbers_in_order(spark):
    rows = output.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), "x").collect()
    assert all(r.place == r.x + 1 for r in rows)


def test_output(world):
    n = world.filter("id = 1")
    assert output.csv_lines(n, ["::id", "::lat", "k"], ",").first().value == "1,10.0000000,x"
    assert output.xml_lines(n).first().value == '<node id="1" lat="10.0000000" lon="1.0000000"><tag k="k" v="x"/><tag k="k" v="y"/><tag k="" v=""/></node>'
    assert output.json_lines(n).first().value == '{"type":"node","id":1,"lat":10.0,"lon":1.0,"tags":{"k":"x","":""}}'
    assert [r.id for r in output.ordered(world, limit=9).collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 11]
    assert tuple(output.counts(world).first()) == (8, 5, 3, 0, 16)


OSM = '<osm><node id="1" lat="10.5" lon="-1.25" version="1" timestamp="2020-01-01T00:00:00Z" uid="7" user="u"><tag k="a" v="b"/></node><way id="2" version="1"><nd ref="1"/><nd ref="1"/></way><relation id="3"><member type="way" ref="2" role="r"/></relation></osm>'
CHANGES = '<osmChange><modify><node id="1" lat="11.0" lon="-1.25" version="2" timestamp="2020-02-01T00:00:00Z"/></modify><delete><node id="1" version="3" timestamp="2020-03-01T00:00:00Z"/></delete><create><node id="9" lat="1" lon="2" version="1" timestamp="2020-02-15T00:00:00Z"/></create></osmChange>'


def test_files_history_and_stream(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    base = osm.read_osm(spark, str(tmp_path / "a.osm"))
    rows = {(r.etype, r.id): r for r in base.collect()}
    assert rows["node", 1].lat_e7 == 105_000_000 and rows["node", 1].lon_e7 == -12_500_000 and rows["way", 2].nds == [1, 1] and rows["relation", 3].members[0].role == "r" and rows["node", 1].tags[0].v == "b"
    folder = tmp_path / "changes"
    folder.mkdir()
    (folder / "1.osc").write_text(CHANGES)
    changes = osm.read_changes(spark, str(folder / "1.osc"))
    whole = merge(merge(None, base.filter("etype = 'node'").withColumn("deleted", F.lit(False))), changes)
    assert set(whole.columns) == {*COLUMNS, "deleted"}
    assert {r.id: r.lat_e7 for r in history.snapshot(whole, "2020-02-20 00:00:00").collect()} == {1: 110_000_000, 9: 10_000_000}
    assert {r.id for r in history.current(whole).collect()} == {9} and {r.id for r in history.snapshot(whole, "2020-01-10 00:00:00").collect()} == {1}
    found = history.difference(history.snapshot(whole, "2020-01-10 00:00:00"), history.snapshot(whole, "2020-03-10 00:00:00"))
    assert {(r.id, r.action) for r in found.collect()} == {(1, "erase"), (9, "create")}
    table = Versions(spark, str(tmp_path / "versions"))
    for _ in range(2):  # the second run finds nothing new
        stream_changes(spark, str(folder), table, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted((r.id, r.version) for r in table.read().collect()) == [(1, 2), (1, 3), (9, 1)]


def test_late_versions_are_dropped(spark):
    rows = [(1, 1, "2020-01-01"), (1, 2, "2020-03-01"), (1, 3, "2020-02-01")]
    changes = elements(spark.createDataFrame(rows, "id long, version int, ts string").withColumns({"ts": F.to_timestamp("ts"), "deleted": F.lit(False)}), "node", "deleted")
    assert sorted(r.version for r in history.versions(changes).collect()) == [1, 3]


def test_shapes_and_documents(spark, world):
    pairs = "tags array<struct<k:string,v:string>>"
    more = spark.createDataFrame([(31, [("way", 13, "outer"), ("node", 1, "")], [("n", "x")]), (32, [("way", 11, ""), ("way", 99, "")], [])], f"id long, members array<struct<type:string,ref:long,role:string>>, {pairs}")
    all_of = both(world, elements(more, "relation"))
    placed = {(r.etype, r.id): r for r in shapes.with_shapes(all_of, all_of).collect()}
    assert [len(s) for s in placed["relation", 31].shapes] == [5, 1] and len(placed["relation", 31].points) == 6
    assert [len(s) for s in placed["relation", 32].shapes] == [3, 0] and placed["way", 14].points == [] and placed["relation", 22].shapes == [[]]
    areas = shapes.relation_areas(all_of, all_of)
    assert [(r.id, len(r.geometry)) for r in areas.collect()] == [(3_600_000_031, 1)]
    assert keys(shapes.in_areas(all_of.filter("id < 20 AND etype <> 'relation'"), all_of, areas)) >= of("node", 1, 2, 4, 5) | of("way", 11, 12, 13)
    assert not keys(shapes.in_areas(all_of.filter("id = 15"), all_of, areas))
    own = filters.areas_of(all_of, all_of)
    assert keys(shapes.is_in(shapes.literal_point(all_of, 10.05, 1.05), own, all_of)) == of("area", 2_400_000_013) | of("way", 13)
    one = lambda kind, i: shapes.with_shapes(all_of.filter((F.col("etype") == kind) & (F.col("id") == i)), all_of)
    assert output.xml_lines(one("way", 15), "skel", "geometry").first().value == '<way id="15"><bounds minlat="0.0000000" minlon="-179.9000000" maxlat="0.0000000" maxlon="179.9000000"/><nd ref="7" lat="0.0000000" lon="179.9000000"/><nd ref="8" lat="0.0000000" lon="-179.9000000"/></way>'
    assert output.xml_lines(one("way", 14), "skel", "center").first().value == '<way id="14"/>'
    assert '"center":{"lat":0.0,"lon":0.0}' in output.json_lines(one("way", 15), "body", "center").first().value
    assert output.csv_header(all_of, ["::id", "a,b"], ",").first().value == '@id,"a,b"'
    assert output.csv_counts(all_of, ["::type", "::count", "::count:relations"]).first().value == "count\t18\t5"
    with pytest.raises(ValueError, match="with_shapes"):
        output.json_lines(all_of, "body", "center")
    angles = one("way", 11).select(members.vertex_angles().alias("a"), members.per_vertex(lambda a, b, c, i: i.cast("string")).alias("i")).first()
    assert len(angles.a.split(";")) == 1 and angles.i == "2" and one("way", 13).select(members.per_vertex(lambda a, b, c, i: i.cast("string")).alias("i")).first().i == "2;3;4;5"


def test_differences_as_documents(spark):
    pairs = "tags array<struct<k:string,v:string>>"
    state = lambda rows: elements(spark.createDataFrame(rows, f"id long, {pairs}"), "node")
    old, new = state([(1, [("a", "1")]), (2, []), (3, [])]), state([(1, [("a", "2")]), (4, [])])
    found = history.difference(old, new, state([(1, []), (2, []), (4, [])]))
    lines = {r.value for r in output.xml_diff_lines(found, "tags", augmented=True).collect()}
    assert lines == {
        '<action type="modify"><old><node id="1"><tag k="a" v="1"/></node></old><new><node id="1"><tag k="a" v="2"/></node></new></action>', '<action type="create"><node id="4"/></action>',
        '<action type="delete"><old><node id="2"/></old><new><node id="2" visible="true"/></new></action>', '<action type="delete"><old><node id="3"/></old><new><node id="3" visible="false"/></new></action>',
    }
    assert '<action type="delete"><old><node id="3"/></old></action>' in {r.value for r in output.xml_diff_lines(found, "tags").collect()}
