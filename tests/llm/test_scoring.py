"""LM scores: the base against brute force, the model against the base, odd rows."""

import re
from collections import Counter
from math import log10

import pytest
from corpus import SF, crc, documents, odd
from geoloom.llm import scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    def tokens(text):
        return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]

    c = Counter(t for doc, text in rows if crc(doc) % 5 != 1 for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = Counter()
    for doc, text in rows:
        ts = tokens(text)
        out[doc, crc(doc) % 5 == 1, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4)] += 1
    return out


@pytest.mark.parametrize("docs", [documents, odd])
def test_base(spark, docs):
    df = docs(spark)
    got = scoring.score(df.select("doc_id", "text"), scoring.Settings(chunk_bytes=100_000, rounds=1)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert all(r.score <= 0 for r in got)


def test_model_beats_base_on_held_out(spark):
    rows = [r for r in scoring.op3_maxent_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    import numpy as np

    s = scoring.Settings(classes=4, width=3, class_bits=4, word_bits=4)
    rng = np.random.default_rng(1)
    m = scoring.Model(rng.normal(size=(16, 4)), rng.normal(size=(16, 3)), rng.normal(size=4), rng.normal(size=(4, 3)))
    of = lambda *ids: 10 ** scoring.log10_of(m, scoring.Batch([np.array(ids, "<u4").tobytes()], s), 1, s)[0]
    assert abs(sum(of(4, 2, last) for last in range(12)) / of(4, 2) - 1) < 1e-6


def test_every_word_has_a_place_and_features_of_its_own():
    import numpy as np

    s = scoring.sized(scoring.Settings(), 1_000_000)
    rng = np.random.default_rng(4)
    word = np.unique(rng.integers(-(1 << 62), 1 << 62, 20_000))
    c = rng.integers(0, 50, len(word))
    common = np.array([scoring.END, *word[:50]])
    place = scoring._places(word, c, common, s)
    assert place[:50].tolist() == list(range(1, 51)) and (place[50:][c[50:] == 0] == s.unknown).all()
    rare = place[50:][c[50:] > 0]
    assert rare.min() >= s.head and rare.max() < s.unknown and len(np.unique(rare)) > 4 * s.width
    # two rare words of one place are different histories
    a, b = (np.array([5 | x << scoring.PLACE_BITS, 7], "<u4").tobytes() for x in (1, 2))
    batch = scoring.Batch([a, b], s)
    assert batch.feature[0][1] != batch.feature[0][3] and batch.cls[1] == batch.cls[3]


def test_settings_grow_with_the_vocabulary():
    sizes = [scoring.sized(scoring.Settings(), v) for v in (0, 10**5, 10**7, 10**9, 10**12)]
    assert all(a.classes <= b.classes and a.class_bits <= b.class_bits for a, b in zip(sizes, sizes[1:], strict=False))
    assert sizes[0].class_bits < sizes[2].class_bits < sizes[3].class_bits and sizes[-1].class_bits == 18 and sizes[-1].classes * sizes[-1].width < 1 << scoring.PLACE_BITS


def test_ranks_are_by_full_counts(spark):
    """A word that is rare in each of many chunks is ranked by its sum."""
    rows = [(k, w, 1 if w == 7 else 3 if w == 1000 + k else 0) for k in range(50) for w in (7, 1000 + k, scoring.END)]
    v, s = scoring._vocabulary(scoring._totals(spark.createDataFrame(rows, "chunk long, word long, n long")), scoring.Settings())
    assert v.words[:2].tolist() == [scoring.END, 7] and v.n == 200 and v.v == 51
    assert abs(v.mass.sum() - (200 + 51 * 0.5 + 0.5 + 0.5)) < 1e-9


def test_empty_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert scoring.score(df.limit(0)).count() == 0
    held = df.filter("crc32(cast(doc_id AS string)) % 5 = 1")
    rows = scoring.score(held).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_train_on_every_position(rounds):
    import numpy as np

    s = scoring.sized(scoring.Settings(rounds=rounds), 0)
    b = scoring.Batch([np.arange(n).astype("<u4").tobytes() for n in (1, 7, 0, 20)], s)
    met = np.concatenate([scoring.positions(b, k, s) for k in range(rounds)])
    assert sorted(met.tolist()) == list(range(28))
