"""Traversals along membership: from parents down to members, from members up to parents, and both closures.

Results are distinct elements; a traversal is a semi-join on exploded membership rows. `world` has all elements. Steps
work on (etype, id) alone, and on memberships as rows where a source notes them: a set of keys that several steps use is written once (`kept`), and whole rows are fetched at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, RANK, among, both, ends_of, links_of, members_of, nodes_of, of_type, typed, types_of
from ..shared import stored


def edges(df: DataFrame, role: str | None = None) -> DataFrame:
    """(etype, id, pos, type, ref, role) of ways' nodes and relations' members; with a role, of relations' members in it only."""
    members = of_type(df, "relation").select(*KEY, F.posexplode("members").alias("pos", "m")).select(*KEY, "pos", "m.type", "m.ref", "m.role")
    if role is not None:
        return members.filter(F.col("role") == role)
    nodes = of_type(df, "way").select(*KEY, F.posexplode("nds").alias("pos", "ref")).select(*KEY, "pos", F.lit("node").alias("type"), "ref", F.lit("").alias("role"))
    return nodes.unionByName(members)


def _links(df: DataFrame, of: str, role: str | None = None, every: bool = False) -> DataFrame:
    """(etype, id, type, ref, role) of the elements of one type, repeats allowed: from noted rows if there are any. every: rows of other ids may be among them."""
    own = of_type(df, of)
    rows = links_of(own)
    if rows is None:
        return edges(own, role).drop("pos")
    rows = (rows if role is None else rows.filter(F.col("role") == role)).select(F.lit(of).alias("etype"), "id", "type", "ref", "role")
    return rows if every else rows.join(own.select("id"), "id", "left_semi")


def _fetch(world: DataFrame, keys: DataFrame) -> DataFrame:
    """The elements with these (etype, id)."""
    types = types_of(world)
    if types is None:
        return world.join(keys.select(*KEY), KEY, "left_semi")
    found = [typed(of_type(world, t).join(keys.filter(F.col("etype") == t).select("id"), "id", "left_semi").select(*world.columns), t) for t in types]
    return both(*found) if found else world


def kept(df: DataFrame) -> DataFrame:
    """The keys of a set, written once, for several steps to use; its types stay known."""
    rows, types = stored(df.select(*KEY).distinct(), "keys"), types_of(df)
    if types is None:
        return rows
    parts = [typed(rows.filter(F.col("etype") == t), t) for t in types]
    return both(*parts) if parts else rows


def members(world: DataFrame, parents: DataFrame, types: tuple[str, ...], role: str | None = None, of: str = "relation") -> DataFrame:
    """Members of given types of the parents of one type."""
    found = _links(parents, of, role).filter(F.col("type").isin(*types)).select(F.col("type").alias("etype"), F.col("ref").alias("id"))
    return _fetch(of_type(world, *types), found)


def way_nodes(world: DataFrame, ways: DataFrame, positions: tuple[int, ...] = ()) -> DataFrame:
    """Nodes of ways, or those at given places: from 1 on, from -1 backwards; 0 stands for none."""
    rows = _links(ways, "way")
    if positions:
        rows = of_type(ways, "way").select(F.size("nds").alias("n"), F.posexplode("nds").alias("pos", "ref")).filter(_at(positions, F.col("pos") + 1, F.col("n")))
    return _fetch(of_type(world, "node"), rows.select(F.lit("node").alias("etype"), F.col("ref").alias("id")))


def _at(positions: tuple[int, ...], place: Column, n: Column) -> Column:
    front, back = [p for p in positions if p > 0], [p for p in positions if p < 0]
    return place.isin(front) | (place - n - 1).isin(back)


def way_count(world: DataFrame, ways: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Nodes that are in at least `low` and at most `high` of the ways."""
    counts = of_type(ways, "way").select("id", F.explode(F.array_distinct("nds")).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))
    return _counted(world, counts, low, high)


def way_link(world: DataFrame, ways: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Nodes at which so many segments of the ways meet: two for an inner place, one for an end."""
    n = F.size("nds")
    rows = of_type(ways, "way").filter(n > 0).select(F.posexplode("nds").alias("pos", "ref"), n.alias("n"))
    ends = F.when(F.col("pos") == 0, 1).otherwise(0) + F.when(F.col("pos") == F.col("n") - 1, 1).otherwise(0)
    counts = rows.groupBy("ref").agg((2 * F.count("*") - F.sum(ends)).alias("n"))
    return _counted(world, counts, low, high)


def member_counts(df: DataFrame, role: str, of: str = "relation") -> DataFrame:
    """(etype, id, tags, n, n_distinct, n_role, closed) of ways and relations: their members, the distinct ones, those of a type in a role, and whether a way's first node is its last. Counted on rows, no lists are made."""
    ways, relations = of_type(df, "way"), of_type(df, "relation")
    zero = F.lit(0).cast("bigint")
    # all nodes of a way meet in one task, so that they are shuffled once; only a way with a repeated node can have equal ends
    nodes = nodes_of(ways).select("id", "ref").repartition("id").groupBy("id", "ref").agg(F.count("ref").alias("n"))
    nodes = stored(nodes.groupBy("id").agg(F.sum("n").alias("n"), F.count("ref").alias("n_distinct"), F.count("*").alias("refs"), F.max("n").alias("most")))
    ends = ends_of(ways, nodes.filter("n > 1 AND most > 1")).filter("first = last").select("id", F.lit(True).alias("same"))
    closed = F.coalesce("same", (F.col("n") == 1) & (F.col("refs") == 1), F.lit(False)).alias("closed")
    # rows of one type leave the tables of the others unread, and rows that are distinct already are not shuffled again
    parts = []
    for etype in RANK:
        fits = F.count_if((F.col("role") == role) & F.col("ref").isNotNull()) if etype == of else F.lit(0).cast("bigint")
        rows = members_of(relations).filter(F.col("type") == etype).groupBy("id", "ref").agg(F.count("ref").alias("n"), fits.alias("n_role"))
        parts.append(rows.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.sum("n_role").alias("n_role")))
    sums = reduce(DataFrame.unionAll, parts).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", "n_distinct", "n_role")])
    count = lambda c: F.coalesce(c, zero).alias(c)
    own = lambda some: some.select(*KEY, F.size("tags").alias("tags"))
    of_ways = own(ways).join(nodes, "id", "left").join(ends, "id", "left").select(*KEY, "tags", count("n"), count("n_distinct"), zero.alias("n_role"), closed)
    of_relations = own(relations).join(sums, "id", "left").select(*KEY, "tags", count("n"), count("n_distinct"), count("n_role"), F.lit(None).cast("boolean").alias("closed"))
    return of_ways.unionAll(of_relations)


def _counted(world: DataFrame, counts: DataFrame, low: int, high: int | None) -> DataFrame:
    fits = F.col("n") >= low if high is None else F.col("n").between(low, high)
    return _fetch(of_type(world, "node"), counts.filter(fits).select(F.lit("node").alias("etype"), F.col("ref").alias("id")))


def parents(world: DataFrame, children: DataFrame, of: str, child: str, role: str | None = None, positions: tuple[int, ...] = ()) -> DataFrame:
    """Ways or relations (`of`) with a member of type `child` among the children, in a role or at given places of a way."""
    return _fetch(of_type(world, of), parent_keys(world, of_type(children, child), of, role, positions))


def parent_keys(world: DataFrame, children: DataFrame, of: str, role: str | None = None, positions: tuple[int, ...] = ()) -> DataFrame:
    """The keys of ways or relations with any of the children as a member: one pass over the memberships of that type."""
    own = of_type(world, of)
    rows = _links(own, of, role, every=True)
    if positions and of == "way":
        rows = own.select(*KEY, F.size("nds").alias("n"), F.posexplode("nds").alias("pos", "ref"), F.lit("node").alias("type")).filter(_at(positions, F.col("pos") + 1, F.col("n")))
    known = types_of(children)
    if known is not None and len(known) == 1:  # a constant type is no key of the join
        met = rows.filter(F.col("type") == known[0]).join(children.select(F.col("id").alias("ref")), "ref", "left_semi")
    else:
        met = rows.join(children.select(F.col("etype").alias("type"), F.col("id").alias("ref")), ["type", "ref"], "left_semi")
    found = met.select(*KEY).distinct()
    return typed(found if links_of(own) is None else found.join(own.select("id"), "id", "left_semi").select(*KEY), of)


def distinct(df: DataFrame) -> DataFrame:
    """Each element once; of a single known type, which stays known."""
    out, types = df.dropDuplicates(KEY), types_of(df)
    return typed(out, types[0]) if types and len(types) == 1 else out


def _keys(of: str, *sets: DataFrame) -> DataFrame:
    """The keys of all sets, which are of one type, written once."""
    rows = both(*[of_type(x, of).select(*KEY) for x in sets]) if len(sets) > 1 else of_type(sets[0], of).select(*KEY)
    return typed(stored(rows.distinct(), "keys"), of)


def down(world: DataFrame, df: DataFrame) -> DataFrame:
    """Ways of the relations, and the nodes of these ways, of the ways and of the relations; the start itself is not returned."""
    ways = _keys("way", members(world, df, ("way",)))
    sources = among(world, _keys("way", ways, df), "way")
    nodes = _keys("node", way_nodes(world, sources), members(world, df, ("node",)))
    return both(_fetch(of_type(world, "way"), ways), _fetch(of_type(world, "node"), nodes))


def closure(start: DataFrame, step: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Ids reachable from start(id) along step(source, target), the start included: a frontier per round, cycles end it."""
    seen = stored(start.select("id").distinct(), "seen")
    frontier = seen
    for _ in range(most_rounds):
        found = frontier.join(step, frontier["id"] == step["source"]).select(F.col("target").alias("id")).distinct()
        frontier = stored(found.join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"the closure did not end in {most_rounds} rounds")


def _relation_steps(world: DataFrame) -> DataFrame:
    rows = _links(world, "relation").filter(F.col("type") == "relation")
    return rows.select(F.col("id").alias("source"), F.col("ref").alias("target")).distinct()


def down_all(world: DataFrame, df: DataFrame) -> DataFrame:
    """Relations reached by any number of steps, the start included; their ways; and nodes of those, of the start's ways and of the relations."""
    ids = stored(closure(of_type(df, "relation"), stored(_relation_steps(world), "steps")), "closure")
    relations = among(world, ids, "relation")
    own = of_type(df, "way")
    return both(relations, down(world, both(relations, own)))


def up(world: DataFrame, df: DataFrame) -> DataFrame:
    """Ways with the nodes; relations with the nodes, with these ways or the start's ways; and the start's relations."""
    start = kept(df)
    ways = _keys("way", parent_keys(world, of_type(start, "node"), "way"))
    below = both(of_type(start, "node").select(*KEY), of_type(start, "way").select(*KEY), ways)
    relations = _keys("relation", parent_keys(world, below, "relation"), start)
    return both(_fetch(of_type(world, "way"), ways), _fetch(of_type(world, "relation"), relations))


def up_all(world: DataFrame, df: DataFrame) -> DataFrame:
    """As `up`, and relations that hold any of those relations by any number of steps."""
    first = up(world, df)
    steps = stored(_relation_steps(world).select(F.col("target").alias("source"), F.col("source").alias("target")), "steps")
    ids = stored(closure(of_type(first, "relation"), steps), "closure")
    return both(of_type(first, "way"), typed(of_type(world, "relation").join(ids, "id", "left_semi").select(*world.columns), "relation"))
