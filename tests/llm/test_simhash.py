"""Fingerprints, keys, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from corpus import documents, odd
from geoloom.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fingerprint); the least id of each row's component."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for doc, f in fps:
        r = find(f)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(least[r], doc)
    return [(doc, f, least[find(f)]) for doc, f in fps]


@pytest.mark.parametrize("docs", [documents, odd])
def test_documents(spark, docs):
    df = docs(spark)
    got = sorted(((r.doc_id, r._fp % (1 << 64), r.component_id) for r in simhash.near_components(df).collect()), key=str)
    want = sorted(brute_components([(r.doc_id, brute_fp(r.text)) for r in df.collect()]), key=str)
    assert got == want


def test_clusters_and_hot_keys(spark):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:40]:
        for _ in range(6):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    hot = rng.getrandbits(64)
    fps += [hot ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(20, 40)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, first long")
    want = {f: c for (_, _, c), f in zip(brute_components(list(enumerate(fps))), signed, strict=True)}
    for upto in (8192, 20):
        roots = dict(simhash.components(simhash.links(classes, upto)).collect())
        first = dict(zip(signed, range(len(fps)), strict=True))
        groups = {}
        for f in signed:
            groups.setdefault(roots.get(f, f), []).append(f)
        assert {f: min(first[x] for x in g) for g in groups.values() for f in g} == want


def test_four_errors_always_share_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 4096, dtype=np.int64)
    y = x.view(np.uint64).copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    (r, k), _ = simhash.keys(x)
    _, (s, q) = simhash.keys(y.view(np.int64))
    assert {r for r, _ in set(zip(r.tolist(), k.tolist())) & set(zip(s.tolist(), q.tolist()))} == set(range(4096))


def test_near_dedup(spark):
    rows = [(3, "a b c d e", "x"), (1, "A  b c\nd e", "y"), (1, "A  b c\nd e", "y"), (2, "other words stand in this text", "z"), (None, None, "n"), (9, "", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.fp) for r in got.collect()) == [(1, "y"), (2, "z"), (9, "m")]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_dedup_similarity(spark):
    """Near copies at 0.8 to 0.95 against brute force: none below 0.8 goes, nearly all from 0.8 on do."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(150):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts.append(base)
        for share in (0.01, 0.02, 0.03, 0.04):  # of the words replaced: similarity of some 0.9 to 0.65
            copy = list(base)
            for i in rng.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[i] = rng.choice(vocabulary)
            texts.append(copy)
    texts = [" ".join(x) for x in texts] + ["a b", "A  b", "a c", "", None]
    sets = [shingle_set(t) for t in texts]
    near = [(j, i) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, i in near:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = {i for i in range(len(texts)) if find(i) == i}
    got = {r.id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    assert want <= got
    gone = len(texts) - len(want)
    assert gone > 250 and len(texts) - len(got) >= 0.97 * gone


def test_similar_pairs_of_hot_keys(spark):
    """A key that many sets share is dealt over tasks; the components stay."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"x{rng.random()}", *base[k + 1 :]]) for k in range(100)]
    docs = simhash._with_sketches(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", simhash.Similar())
    assert {len({*simhash.components(simhash.similar_pairs(docs, simhash.Similar(), upto).toDF("a", "b")).select("root").toPandas()["root"]}) for upto in (8192, 10)} == {1}


def test_ones():
    rng = np.random.default_rng(2)
    count = np.array([1, 254, 255, 256, 1000, 3])
    h = rng.integers(0, 1 << 64, count.sum(), dtype=np.uint64)
    got = simhash._ones(h, np.cumsum(count) - count, count)
    want = [[sum(int(x) >> b & 1 for x in run) for b in range(64)] for run in np.split(h, np.cumsum(count)[:-1])]
    assert got.tolist() == want
