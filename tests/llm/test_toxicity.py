"""Lexicon scores: folding, exceptions, odd rows, and accuracy on labels set aside."""

from corpus import crc, odd
from geoloom.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def test_fold():
    assert t.fold("IDI0T") == t.fold("іdiоt") == t.fold("i​diot") == "idiot"


def test_matcher_brute():
    model = t.Model({"idiot": 2.0, "mor*": 1.5}, ("trash can", "idiot proof"), (-3.0, 2.0, 1.0))
    m = t.Matcher(model)
    for text, want in (("an 1d10t", 2.0), ("idiots", 0.0), ("moron more", 3.0), ("humor", 0.0), ("idiot proof", 0.0), ("", 0.0)):
        assert m.sums(text)[0] == want, text


def test_held_out_accuracy_and_contract(spark):
    rows = t.op10_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    mine = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    assert sum(p == y for p, y in mine) >= 0.9 * len(mine)


def test_odd_rows(spark):
    df = odd(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (11, None)], "doc_id long, toxic int")
    got = t.score(df.withColumnRenamed("_h", "score"), t.fit(df, labels))
    assert got.count() == df.count() and got.filter("score IS NULL OR predicted IS NULL").count() == 0
    assert t.score(df.limit(0), t.fit(df.limit(0), labels.limit(0))).count() == 0


def test_late_phrases_of_long_toxic_documents_count(spark, monkeypatch):
    """A phrase of three clean documents is no shield if a toxic document has it, however many phrases that one has before."""
    clean = [(f"{k} one zebra idiot", 0, 2) for k in ("a", "b", "c")]
    long = " ".join(f"w{i:03d} idiot" for i in range(200)) + " zebra idiot"
    taught = spark.createDataFrame([*clean, (long, 1, 2)], "text string, toxic int, part int")
    monkeypatch.setattr(t, "_taught", lambda *_: taught)
    monkeypatch.setattr(t, "_lexicon", lambda *_: {"idiot": 2.0})
    assert "zebra idiot" not in t.fit(taught, taught).exceptions
    monkeypatch.setattr(t, "_taught", lambda *_: taught.filter("toxic = 0"))
    assert "zebra idiot" in t.fit(taught, taught).exceptions


def test_lexicon_and_curve_against_plain_versions(spark):
    """The learned weights from counts made in plain Python, the curve by plain gradient steps."""
    import math
    from collections import Counter

    s = t.Settings()
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taught = t._taught(docs, labels, s).collect()
    count, n = {0: Counter(), 1: Counter()}, Counter()
    for r in taught:
        if r.part < 2:
            words = {w for w in t._WORD.findall(t.fold(r.text)) if 2 < len(w) <= 40}
            count[int(r.toxic > 0)].update(words | {w[:k] + "*" for w in words for k in s.stems if len(w) > k})
            n[int(r.toxic > 0)] += 1
    good = {e for e, c in count[1].items() if c >= s.min_docs and c / (c + count[0][e] + 0.5) >= s.min_precision}
    good = {e for e in good if not any(f"{e.rstrip('*')[:k]}*" in good for k in s.stems if k < len(e.rstrip("*")))}
    want = {e: math.log((count[1][e] + 0.5) / (n[1] + 1)) - math.log((count[0][e] + 0.5) / (n[0] + 1)) for e in good}
    model = t.fit(docs, labels, s)
    assert model.weights.keys() == {e for e, w in want.items() if w > 0} and all(abs(model.weights[e] - want[e]) < 1e-9 for e in model.weights)
    first = t.Matcher(t.Model(model.weights))
    rows = [(t._inputs(*first.sums(r.text)[:2]), int(r.toxic > 0)) for r in taught if r.part == 2]
    for j in range(3):  # at the optimum the ridge's pull is the gradient
        slope = sum(x[j] * (y - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.curve, strict=True))))) for x, y in rows) - 1e-2 * model.curve[j]
        assert abs(slope) < 1e-3


def test_the_best_entries_stay(spark):
    """With room for few entries, those stay whose weight times documents is largest."""
    rows = [("rare foul", 1, 0)] * 4 + [("common", 1, 0)] * 9 + [("common", 0, 0)] * 2 + [("clean text", 0, 0)] * 30
    taught = spark.createDataFrame(rows, "text string, toxic int, part int")
    kept = t._lexicon(taught, t.Settings(entries=1, stems=(), min_precision=0.5))
    score = {"foul": 4 * 2.2, "common": 9 * 1.3}
    assert set(kept) == {max(score, key=score.get)}
