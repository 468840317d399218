"""Steps that must not grow faster than their input, against plain versions."""

from geoloom.model import both, elements
from geoloom.operators import filters, shapes
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _grid(spark):
    """A square area, a long way through it without a node inside, one far away, and nodes on a grid of halves of a degree."""
    corners = [(90001, 1.0, 1.0), (90002, 1.0, 14.0), (90003, 13.0, 14.0), (90004, 13.0, 1.0), (90005, 6.0, -9.0), (90006, 7.0, 29.0), (90007, -40.0, -9.0), (90008, -41.0, 29.0)]
    some = [(1 + i * 60 + j, -3.0 + i * 0.5, -3.0 + j * 0.5) for i in range(60) for j in range(60)]
    nodes = spark.createDataFrame([(i, round(a * 1e7), round(b * 1e7)) for i, a, b in some + corners], "id long, lat_e7 long, lon_e7 long")
    ways = spark.createDataFrame([(1, [90001, 90002, 90003, 90004, 90001]), (2, [90005, 90006]), (3, [90007, 90008])], "id long, nds array<long>")
    return both(elements(nodes, "node"), elements(ways, "way"))


def test_nodes_of_covered_cells_need_no_test_of_their_own(spark):
    w = _grid(spark)
    areas = filters.areas_of(w, w)
    plain = {r.id for r in filters.covering(w.filter("etype = 'node'"), areas).collect()}
    for size in (1.0, 5.0):
        assert {r.id for r in shapes.inside(w.filter("etype = 'node'"), areas, size).collect()} == plain and len(plain) > 500
    assert {r.id for r in shapes.in_areas(w.filter("etype = 'way'"), w, areas).collect()} == {1, 2}


def test_ways_are_planned_without_customers_where_names_are_not_used(spark):
    from __spark_entry__ import DATA
    from geoloom.sources import star

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    ways = star.ways(spark, DATA)
    assert "c_name" in plan(ways.select("id", "user")) and "c_custkey" not in plan(ways.select("id", F.size("nds")))


def test_nodes_near_sources_with_and_without_shared_cells(spark):
    w = _grid(spark)
    nodes = w.filter("etype = 'node'")
    places = {r.id: (r.lat_e7 / 1e7, r.lon_e7 / 1e7) for r in nodes.collect()}
    sources = [i for i in places if i % 97 == 0 or i == 90008]
    from math import asin, cos, pi, radians, sin, sqrt

    def metres(a, b):
        (p, q), (r, s) = a, b
        x = sin(radians(r - p) / 2) ** 2 + cos(radians(p)) * cos(radians(r)) * sin(radians(s - q) / 2) ** 2
        return 2 * 2e7 / pi * asin(min(1.0, sqrt(x)))

    for radius in (90_000, 260_000):
        near = {i for i, at in places.items() if any(metres(at, places[j]) <= radius for j in sources)}
        found = filters.around(nodes, nodes.filter(F.col("id").isin(*sources)), radius)
        assert {r.id for r in found.collect()} == near and len(sources) < len(near)
    assert "_half" in found._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_lengths_and_turns_without_lists_of_places(spark):
    w = _grid(spark)
    relations = elements(spark.createDataFrame([(5, [("way", 1, ""), ("node", 90007, ""), ("way", 2, "")]), (6, [])], "id long, members array<struct<type:string,ref:long,role:string>>"), "relation")
    small = both(w.filter("etype <> 'node' OR id > 90000"), relations)
    w = both(w, relations)
    rows = lambda df, *c: {(r.etype, r.id): r for r in df.select("etype", "id", *c).collect()}
    from geoloom.functions import geometry, members

    listed = rows(shapes.with_shapes(small, w), geometry.bounds("points").alias("bounds"), members.shape_metres().alias("metres"))
    boxes, lengths = rows(shapes.with_bounds(small, w), "bounds"), rows(shapes.with_metres(small, w), "metres")
    assert boxes.keys() == listed.keys() == lengths.keys() and len(boxes) == 13
    assert all(boxes[k].bounds == listed[k].bounds and abs(lengths[k].metres - listed[k].metres) < 1e-6 for k in listed)
    turned = shapes.turns(w.filter("etype = 'way'"), w.filter("etype = 'node'")).collect()
    assert [(r.id, r.pos) for r in sorted(turned)] == [(1, 1), (1, 2), (1, 3)] and all(abs(abs(r.turn) - 90) < 3 for r in turned)


def test_traversals_read_memberships_as_rows(spark):
    """No lists of nodes or members are made for steps that need no order; elements that are missing have no members."""
    from geoloom.model import both, links_of, of_type, pick
    from geoloom.operators import traverse
    from geoloom.sources import star

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    w = star.world(spark, "/root/testdata/sf0.001")
    some = pick(of_type(w, "way"), "id % 7 = 0")
    assert "collect_list" not in plan(traverse.way_nodes(w, some).select("id")) and "collect_list" not in plan(traverse.parent_keys(w, some, "relation"))
    bare = both(*[x.filter("id % 3 > 0").transform(lambda y, t=t: elements(y, t)) for t in ("node", "way", "relation") for x in [of_type(w, t)]])
    assert links_of(of_type(bare, "way")) is None
    thin = pick(w, "id % 3 > 0")
    for step in (traverse.down, traverse.up, traverse.down_all, traverse.up_all):
        rows = lambda x: sorted(tuple(r) for r in step(x, pick(x, "id % 5 = 1")).select("etype", "id").collect())  # noqa: B023, E731
        found = rows(thin)
        assert found == rows(bare) and found


def test_relations_as_xml_without_lists_of_places(spark):
    """The lines of xml_lines with places, for members of all types, without places, names or elements, and for ways that nothing is noted of."""
    from geoloom.model import nodes_of, of_type, pick
    from geoloom.operators import output
    from geoloom.plans.placed import QUERIES
    from geoloom.sources import star

    w = _grid(spark)
    bare = elements(spark.createDataFrame([(90010, None, None)], "id long, lat_e7 long, lon_e7 long"), "node")
    lines = elements(spark.createDataFrame([(4, [90010, 90006, 90006]), (5, [90010]), (6, []), (7, [77])], "id long, nds array<long>"), "way")
    kinds = [("way", 4, "a&b"), ("way", 1, ""), ("node", 90007, '"'), ("node", 90010, ""), ("node", 77, ""), ("way", 5, ""), ("way", 6, ""), ("way", 7, ""), ("way", 78, ""), ("relation", 5, "x"), ("way", 4, ""), ("way", 2, None), (None, 1, "")]
    relations = elements(spark.createDataFrame([(5, kinds, [("k", "<v>")]), (6, [], []), (7, None, []), (8, kinds[6:8], [])], "id long, members array<struct<type:string,ref:long,role:string>>, tags array<struct<k:string,v:string>>"), "relation")
    w = both(w, bare, lines, relations)
    thin = pick(star.world(spark, "/root/testdata/sf0.001"), "id % 3 > 0")
    for world in (w, thin):
        own = of_type(world, "relation")
        for detail in ("ids", "skel", "body", "meta"):
            rows = lambda df: sorted(r.value for r in df.collect())
            assert rows(output.xml_relations(own, world, detail)) == rows(output.xml_lines(shapes.with_shapes(own, world), detail, "geometry"))
    ways = of_type(star.world(spark, "/root/testdata/sf0.001"), "way")
    listed = ways.select("id", F.posexplode("nds").alias("pos", "ref"))
    numbered = nodes_of(ways).select("id", (F.row_number().over(W.partitionBy("id").orderBy("at")) - 1).alias("pos"), "ref")
    assert listed.exceptAll(numbered).isEmpty() and numbered.exceptAll(listed).isEmpty()
    plan = QUERIES["output_xml_geometry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def _ring_world(spark):
    """Relations whose ways close or do not: by chance, with a way twice or in two roles, unknown or empty ways, a way of one node, nodes without a place."""
    from random import Random

    rng = Random(5)
    nodes = [(i, i * 1000, i * 2000) for i in range(1, 13)] + [(13, None, None)]
    ways = [(i, [rng.randint(1, 6) for _ in range(rng.randint(2, 4))]) for i in range(1, 41)] + [(50, [1]), (51, []), (52, [2, 99, 2]), (53, [99, 98, 99]), (54, [3, 13, 3]), (55, [1, 2]), (56, [2, 1])]
    ways += [(57, [7, 8]), (58, [8, 9]), (59, [9, 7])]
    some = [[("way", rng.randint(1, 40), "") for _ in range(rng.randint(1, 3))] for _ in range(120)]
    some += [[("way", 55, ""), ("way", 56, "")], [("way", 55, ""), ("way", 55, "")], [("way", 55, "a"), ("way", 55, "b")], [("way", 50, "")], [("way", 51, "")], [("way", 52, "")], [("way", 53, "")], [("way", 54, "")], [("way", 77, "")]]
    some += [[("way", 59, "x"), ("node", 1, ""), ("way", 57, ""), ("relation", 3, ""), ("way", 58, "y")], [("way", 57, ""), ("way", 58, "")], [("way", 55, ""), ("way", 56, ""), ("way", 77, "")], [("way", 55, ""), ("way", 56, ""), ("way", 51, "")], [("node", 1, "")], []]
    make = lambda rows, schema, t: elements(spark.createDataFrame(rows, f"id long, {schema}"), t)
    relations = make(list(enumerate(some, 1)), "members array<struct<type:string,ref:long,role:string>>", "relation")
    return (make(nodes, "lat_e7 long, lon_e7 long", "node"), make(ways, "nds array<long>", "way"), relations), (dict(ways), dict(enumerate(some, 1)), {n[0]: n[1] for n in nodes})


def test_rings_by_sums_of_ends(spark):
    """Relations that can form rings and their areas, as a plain count of ends has them: of lists, and of noted rows with ids of elements that are missing."""
    from collections import Counter

    from geoloom.model import listed, members_of, nodes_of
    from geoloom.operators import derive

    (nodes, ways, relations), (nds, members, places) = _ring_world(spark)
    closes, areas = {}, {}
    for i, own in members.items():
        refs = [ref for kind, ref, _ in own if kind == "way"]
        ends = [end for ref in refs if nds.get(ref) for end in (nds[ref][0], nds[ref][-1])]
        if not ends:
            continue
        closes[i] = all(n % 2 == 0 for n in Counter(ends).values())
        lines = [[places[n] and n * 1e-4 for n in nds.get(ref, []) if n in places] for ref in refs]
        if closes[i] and all(len(line) > 1 for line in lines):
            areas[i + 3_600_000_000] = lines
    assert 10 < len(areas) < sum(closes.values()) < len(closes) - 10

    plain = both(nodes, ways, relations)
    rows = lambda df: spark.createDataFrame(df.collect(), df.schema)
    strange = spark.createDataFrame([(77, 0, 1), (77, 1, 2)], "id long, at int, ref long")
    more = spark.createDataFrame([(999, 0, "way", 55, ""), (999, 1, "way", 56, "")], "id long, at int, type string, ref long, role string")
    noted = both(nodes, listed(elements(ways, "way"), rows(nodes_of(ways)).unionByName(strange)), listed(elements(relations, "relation"), rows(members_of(relations)).unionByName(more)))
    for w in (plain, noted):
        assert {r.id: (r.area - r.id, r.closed) for r in derive.rings(w).collect()} == {i: (3_600_000_000, c) for i, c in closes.items()}
        found = {r.id: [[p.lat for p in line] for line in r.geometry] for r in shapes.relation_areas(w, w).collect()}
        assert found.keys() == areas.keys()
        assert all([len(a) for a in found[i]] == [len(b) for b in areas[i]] and all(x == y or abs(x - y) < 1e-9 for a, b in zip(found[i], areas[i], strict=True) for x, y in zip(a, b, strict=True)) for i in areas)


def test_relation_areas_make_no_lists_of_all_members(spark):
    """The closed relations are known before lists are made, which then hold the nodes of their ways alone; members noted as rows are those of the lists."""
    from geoloom.model import of_type
    from geoloom.operators import derive
    from geoloom.plans.placed import QUERIES
    from geoloom.sources import star

    data = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made, world = plan(QUERIES["derive_relation_areas"](spark, data)), star.world(spark, data)
    assert "collect_list(struct(at," in made and "collect_list(struct(type," not in made and "supplies" not in made
    assert "collect_list" not in plan(derive.rings(world))
    from geoloom.model import members_of

    relations = of_type(world, "relation")
    lists = relations.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.*")
    numbered = members_of(relations).withColumn("pos", F.row_number().over(W.partitionBy("id").orderBy("at")) - 1).select(*lists.columns)
    assert lists.exceptAll(numbered).isEmpty() and numbered.exceptAll(lists).isEmpty()


def test_members_are_counted_as_the_sql_counts_them(spark, tmp_path):
    """Copies with shifted keys, customers without orders, lines that repeat a part or their number: the rows of the SQL, and no lists on the way."""
    import duckdb
    from geoloom.plans.catalog import QUERIES, SQL

    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    shifted = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "nation": [], "region": [], "events": []}
    for name, keys in shifted.items():
        copies = f"range({2 if keys else 1})" if name != "customer" else "range(3)"  # the third customers have no orders
        moved = "REPLACE (" + ", ".join(f"{k} + i * 10000000 AS {k}" for k in keys) + ")" if keys else ""
        rows = f"SELECT * EXCLUDE (i) FROM (SELECT * {moved} FROM read_parquet('{data}/{name}.parquet'), {copies} r(i))"
        if name == "lineitem":
            rows += " UNION ALL SELECT * REPLACE (l_linenumber + 50 AS l_linenumber) FROM read_parquet('%s/lineitem.parquet') WHERE l_linenumber = 1 AND l_orderkey %% 3 = 0 UNION ALL SELECT * FROM read_parquet('%s/lineitem.parquet') WHERE l_orderkey %% 7 = 0" % (data, data)
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(con.execute(SQL["expression_members"]).fetchall())
    found = QUERIES["expression_members"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sum(r[5] == "1" for r in want) > 100 and sum(r[3:5] == ("0", "1") for r in want) > 100 and any(r[0] == "relation" and r[1] < 13_000_000 and r[1] > 10_000_000 and r[2] == "2" for r in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("supplies") <= 1
