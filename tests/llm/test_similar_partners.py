"""Sets with two partners bring both; sets with more are written with one, however many keys show others."""

import random

import pyarrow as pa
from geoloom.llm import simhash


def test_the_second_of_two_partners_is_verified(spark):
    words = lambda n, last: " ".join([*[f"w{n}x{i}" for i in range(60)], last])
    sketches = spark.createDataFrame([(i, i, bytes(64)) for i in (1, 2, 3)], "_row long, _set long, _fps binary")  # set 1 is the least and nearest of both others
    rows = spark.createDataFrame([(1, words(1, "end")), (2, words(2, "one")), (3, words(2, "two"))], "_row long, text string")
    assert [(r.node, r.root) for r in simhash.similar_components(sketches, rows, simhash.Similar()).collect()] == [(3, 2)]


def test_pairs_grow_with_sets_not_with_their_keys(spark):
    rng, n = random.Random(4), 400
    near = lambda: sum(1 << rng.randrange(512) for _ in range(12)) % (1 << 512)
    sketches = spark.createDataFrame([(i, near().to_bytes(64, "little")) for i in range(n)], "_set long, _fps binary")
    for upto in (simhash.STORED_UPTO, 20):
        pairs = simhash.similar_pairs(sketches, simhash.Similar(), upto)
        assert n - 1 <= pairs.count() <= 2 * n
        assert simhash.components(pairs.toDF("a", "b")).select("root").distinct().count() == 1


def test_a_group_may_go_on_in_the_next_batch():
    rows = [(5, 0, 2, own, 0, 0, own) for own in (11, 12, 13, 14)] + [(6, 0, 2, own, 0, 0, own) for own in (21, 22)]
    names = ("key", "salt", "side", "set", "fp", "fp2", "root")
    types = (pa.int64(), pa.int32(), pa.int8(), *[pa.int64()] * 4)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    want = [(11, 12, True), (12, 11, True), (13, 11, True), (14, 11, True), (21, 22, False), (22, 21, False)]
    for cut in range(len(rows)):
        found = simhash.similar_sorted(iter([batch.slice(0, cut), batch.slice(cut)]), 36)
        assert sorted(tuple(r.values()) for x in found for r in x.to_pylist()) == want
