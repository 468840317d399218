"""Language models: against a plain Kneser-Ney, odd rows, and held-out languages."""

from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from corpus import crc, odd
from geoloom.llm import language as g

SF = "/root/testdata/sf0.01"


def plain(words):
    """log P(last character | three before) of interpolated Kneser-Ney, from dictionaries."""
    top = Counter()
    for w in words:
        w = g._START * 3 + w + g._END
        top.update(w[i - 3 : i + 1] for i in range(3, len(w)))
    levels = [top]
    for _ in range(3):
        levels.insert(0, Counter(x[1:] for x in levels[0]))
    size = len(levels[0])

    def p(gram):
        if not gram:
            return 1 / (size + 1)
        own = levels[len(gram) - 1]
        once, twice = (sum(v == k for v in own.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        ctx = {x: v for x, v in own.items() if x[:-1] == gram[:-1]}
        if not ctx:
            return p(gram[1:])
        total = sum(ctx.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(ctx) / total * p(gram[1:])

    return top, p


def test_same_as_plain_model():
    words = ["banana", "bandana", "an", "nab", "été", "cabana", "ban"]
    top, p = plain(words)
    points = np.array([[ord(c) for c in gram] for gram in top])
    model = g.Model(["x"], [g._kneser_ney(points, np.array(list(top.values()), float))])
    asked = [*top, "zzzz", "bana", g._START * 3 + "b", "an" + g._END + "x", "cany"]
    got = model.log_probabilities(np.array([[ord(c) for c in x] for x in asked]))[:, 0]
    assert np.allclose(got, [log(p(x)) for x in asked])


def test_text_entropy_is_the_sum_over_words():
    words = ["banana", "bandana", "an"]
    top, p = plain(words)
    points = np.array([[ord(c) for c in gram] for gram in top])
    model = g.Model(["x"], [g._kneser_ney(points, np.array(list(top.values()), float))])
    entropy, chars = model.entropies([b"Banana, an\n12 !?", b"", b"77"])
    grams = [g._START * 3 + w + g._END for w in ("banana", "an")]
    want = [log(p(x[i - 3 : i + 1])) for x in grams for i in range(3, len(x))]
    assert chars.tolist() == [len(want), 0, 0] and entropy[0, 0] == pytest.approx(-sum(want) / len(want))


def test_held_out_accuracy_and_contract(spark):
    rows = g.op8_language(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = defaultdict(list)
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1
        right[r.held_out].append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right[True]) >= 0.97 and np.mean([r.accepted for r in rows]) > 0.9


def test_odd_rows(spark):
    df = odd(spark)
    got = g.identify(df.withColumnRenamed("_h", "score"), g.fit(df)).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0) if not any(map(str.isalpha, r.text or "")) else r.lang_pred == "en"
    none = g.identify(df, g.fit(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"} and g.identify(df.limit(0), g.Model()).count() == 0
