"""What fingerprints' keys do not reach is found by prefixes: components as by brute force, whatever the keys bring."""

import random

import pytest
from geoloom.llm import simhash
from pyspark.sql import functions as F
from test_simhash import jaccard, shingle_set


def _texts():
    """Near copies on either side of 0.8, of several lengths; texts of a few common parts; short and empty ones."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(30, 300))
        texts.append(base)
        for share in (0.01, 0.02, 0.03):
            copy = list(base)
            for i in rng.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[i] = rng.choice(vocabulary)
            texts += [copy, copy[: round(len(copy) * rng.uniform(0.75, 1))]]
    parts = [rng.choices(vocabulary, k=30) for _ in range(6)]
    texts += [[w for p in rng.sample(parts, 4) for w in p] + rng.choices(vocabulary, k=rng.randint(0, 12)) for _ in range(80)]
    return [" ".join(x) for x in texts] + ["a b", "A  b", "a c", "", None, " \n"]


def _components(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_dedup_loses_no_pair(spark):
    texts, blind = _texts(), simhash.Similar(most_bits=0)  # no pair but those of equal fingerprints
    want = {*_components(texts)}
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", settings=blind)
    assert {r.id for r in got.collect()} == want and len(texts) - len(want) > 100


@pytest.mark.parametrize("sets_upto", [simhash.SETS_UPTO, 6])
def test_links_without_any_keys(spark, sets_upto):
    """All pairs from prefixes alone: as rows, or for shingles of more than six sets in blocks."""
    texts, s = _texts(), simhash.Similar()
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    made = simhash._with_sketches(rows, "text", s).repartition(5)
    made = spark.createDataFrame(made.collect(), made.schema)
    firsts = {r._set: r.first for r in made.groupBy("_set").agg(F.min("_row").alias("first")).collect()}
    sketches = made.filter(F.col("_row").isin([*firsts.values()])).select("_row", "_set", "_fps")
    none = spark.createDataFrame([], "node long, root long")
    links = simhash.rest_links(made.select("_row", "_set", "text"), sketches, none, s, sets_upto)
    found = dict(simhash.components(links.toDF("a", "b")).collect())
    by_set = {}
    for text, i in zip(_components(texts), range(len(texts)), strict=True):
        by_set.setdefault(text, set()).add(i)
    own = {i: x for x, i in firsts.items()}
    got = {}
    for i, x in own.items():
        got.setdefault(found.get(x, x), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g & own.keys()) for g in by_set.values())


def test_common_shingles_come_last(spark):
    texts = [f"one two three four five six seven own{i} x{i} y{i} z{i} u{i} v{i} t{i}" for i in range(50)]
    shingles, rank = simhash.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), simhash.Similar())
    assert len(shingles) == 3 and sorted(rank.tolist()) == [1, 2, 3] and (shingles[:-1] < shingles[1:]).all()
    frame = spark.createDataFrame(list(enumerate(texts)), "_set long, text string")
    taken = simhash._prefix_rows(frame, (shingles, rank), simhash.Similar()).collect()
    assert len(taken) == 50 * 3 and not {r.shingle % (1 << 64) for r in taken} & {*map(int, shingles)}
    assert {r["at"] >> 32 for r in taken} == {10} and {r["at"] % (1 << 32) for r in taken} == {0, 1, 2}
