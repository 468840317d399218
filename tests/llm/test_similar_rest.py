"""A pair of similar texts that is neither the least nor the nearest of either in any key."""

from geoloom.llm import simhash


def test_pairs_beside_the_least_and_nearest_partner_are_verified(spark):
    words = lambda n, last: " ".join([*[f"w{n}x{i}" for i in range(60)], last])
    texts = [words(n, "end") for n in (1, 2, 3, 4)] + [words(5, "one"), words(5, "two")]
    sketches = spark.createDataFrame([(i, i, bytes(64)) for i in range(1, 7)], "_row long, _set long, _fps binary")  # all look alike
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "_row long, text string")
    found = simhash.similar_components(sketches, rows, simhash.Similar())
    assert [(r.node, r.root) for r in found.collect()] == [(6, 5)]


def test_a_large_group_of_near_copies_is_never_written_as_pairs(spark):
    """Copies with some words replaced, of which many pairs are below 0.8: components as by brute force, and edges instead of pairs."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for i in rng.sample(range(120), rng.choice((1, 2, 3, 4, 5))):
            copy[i] = f"x{rng.random()}"
        texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(300))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(300):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted(find(i) for i in range(300))
    sketches = spark.createDataFrame([(i, i, bytes(64)) for i in range(300)], "_row long, _set long, _fps binary")  # all look alike
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "_row long, text string")
    s = simhash.Similar()
    for upto in (simhash.SETS_UPTO, 20):
        found = {r.node: r.root for r in simhash.similar_components(sketches, rows, s, upto).collect()}
        assert sorted(found.get(i, i) for i in range(300)) == want and 100 < len(set(want)) < 200
    alone = sketches.withColumn("root", sketches["_set"])
    assert simhash._similar_found(alone, simhash.key_places(300, s), s, simhash.STORED_UPTO, True).count() < 3000
