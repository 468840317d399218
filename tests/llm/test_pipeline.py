"""The pipeline stage by stage on the smallest tables, against plain versions of each stage."""

import corpus_pipeline
from corpus import SF
from test_decontamination import brute as leaks
from test_packing_parts import whole_pieces
from test_pii import brute as spans
from test_simhash import jaccard, shingle_set
from test_spans_urls_quality_packing import brute_quality


def similar_kept(texts):
    """The least id of each group that a shingle similarity of 0.8 or more connects."""
    sets, root = {d: shingle_set(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[:i]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in texts}


def test_empty_documents(spark):
    """Every stage takes an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, SF)
        assert now.count() == 0 and (name == "packing" or now.columns == docs.columns)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = corpus_pipeline.stored(stage(spark, now, SF))
        after = {r.doc_id: r for r in now.collect()}
        if name != "packing":
            assert now.columns == docs.columns and all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality":
            assert all(not brute_quality(before[d].text)[5] for d in after)
            assert {d for d, r in before.items() if not brute_quality(r.text)[5] and "|" not in r.text and "&&&" not in r.text} <= set(after)
        elif name == "near_duplicates":
            want = similar_kept({d: r.text for d, r in before.items()})
            gone = len(before) - len(want)
            assert want <= set(after) and gone and len(before) - len(after) >= 0.97 * gone
        elif name == "decontamination":
            assert set(after) == set(before) - {d for d, *_ in leaks([(d, r.text) for d, r in before.items()], bench)}
        elif name == "pii":
            assert set(after) == set(before) and not any(spans(r.text) for r in after.values())
            assert all(after[d].text == r.text for d, r in before.items() if not any(c.isdigit() or c == "@" for c in r.text))
        else:
            rows = now.collect()
            assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows} == {(d, *x) for d, r in before.items() for x in whole_pieces(r.text)}
    assert corpus_pipeline.run(spark, SF).count() == now.count()
