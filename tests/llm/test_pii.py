"""Personal data: base spans against brute force, added spans, the model and redaction."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from corpus import documents, odd
from geoloom.llm import pii
from pyspark.sql import functions as F

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx in RULES.items() for m in re.finditer(rx, text or "") if holds(k, m[0])]


TRICKY = [
    "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 001.2.3.255 1.2.3.256 256.1.1.1.1", "4111 1111-1111 1111 2 4111111111111111", "+1 (988) 555-2485+44 20 7946 0958 +12 +1-2",
    "é𝒳 mail@host.example, é𝒳 +49 (0) 30-1234567.", "@a.b a@b a@b. a@.b .@-.-", "9" * 5000 + " " + "1 " * 4000, "x" * 50000 + "@" + "y" * 100, "1." * 3000, "+1" + "(" * 3000 + "1",
    "write to jo (at) site (dot) org", "call 212-555-0187 now", "IBAN DE89 3704 0044 0532 0130 00", "pages 112-119", "٣٤٥ 12345678901234567",
]


@pytest.mark.parametrize("docs", [documents, odd, "tricky"])
def test_base_spans(spark, docs):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string") if docs == "tricky" else docs(spark)
    got = pii.digests(df).collect()
    want, have = defaultdict(Counter), defaultdict(Counter)
    for r in df.collect():
        s = brute(r.text)
        want[r.doc_id][tuple(sum(x.startswith(k + ":") for x in s) for k in RULES), hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
        assert any(set(s) <= set(g.spans.split(",")) or not s for g in got if g.doc_id == r.doc_id)
    for g in got:
        have[g.doc_id][(g.n_email, g.n_ip, g.n_card, g.n_phone), g.base_sha256] += 1
    assert have == want


def test_wide_candidates_add_spans(spark):
    df = spark.createDataFrame([(1, "please write to jo (at) site (dot) org or phone 212-555-0187"), (2, "see pages 112-119 and 230-241 on 2021-03-04")], "doc_id long, text string")
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.find_pii(df).collect()}
    assert ("contact", 16, 38) in rows[1] and ("number", 48, 60) in rows[1]
    assert rows[2] == []


def test_model_column_equals_margin(spark):
    model = pii.boost({0: (50.0, 1.0), 5: (2.0, 30.0), 130: (10.0, 12.0), 2047: (0.0, 9.0)}, pii.Settings(trees=5))
    rows = spark.range(0, 2048, 37).select(F.col("id").cast("int").alias("m")).withColumn("p", model.column(F.col("m"))).collect()
    import math

    assert all(abs(r.p - 1 / (1 + math.exp(-model.margin(r.m)))) < 1e-9 for r in rows)


def test_redact(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4", "kept"), (2, None, "kept"), (3, "plain", "kept")], "doc_id long, text string, pii string")
    rows = {r.doc_id: r for r in pii.redact(pii.find_pii(df.withColumnRenamed("pii", "extra"))).collect()}
    assert rows[1].redacted == "é [EMAIL], [IP]" and rows[2].redacted is None and rows[3].redacted == "plain" and rows[1].extra == "kept"
    assert pii.digests(df.limit(0)).count() == 0


def test_added_spans_do_not_depend_on_corpus_size(spark):
    planted = ["call 212-555-0187 after six", "IBAN DE89 3704 0044 0532 0130 00 is mine", "SSN 123-45-6789 on file", "jo (at) site (dot) org", "mail a@b.cd or +49 (0) 30-1234567", "see pages 112-119 and 230-241 of 1998", "version 10.2.33.1.7 and 4711"]
    found = []
    for times in (5, 500):
        df = spark.range(len(planted) * times).select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(x) for x in planted]), (F.col("id") % len(planted) + 1).cast("int")).alias("text"))
        rows = pii.find_pii(df).groupBy("text").agg(F.collect_set("pii").alias("all")).collect()
        assert all(len(r["all"]) == 1 for r in rows)
        found.append({r.text: [(x.kind, x.start, x.end) for x in r["all"][0]] for r in rows})
    assert found[0] == found[1]
    assert all(kind in [k for k, *_ in found[1][x]] for kind, x in zip(("number", "code", "number", "contact"), planted, strict=False)), found[1]
    assert found[1][planted[5]] == []


def test_thirty_thousand_matches_in_one_text(spark):
    """Spans and redaction of a text with very many matches, in seconds: nothing is quadratic in them."""
    import time

    many = " ".join(f"é{i} u{i}@host.example +1 (988) 555-{i:04d} 10.0.{i % 256}.7" for i in range(10_000))
    df = spark.createDataFrame([(1, many), (2, "jo (at) site (dot) org " * 1500 + "a@b.cd" * 500)], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in pii.redact(pii.find_pii(df)).collect()}
    assert time.time() - began < 90
    assert sorted(f"{s.kind}:{s.start}:{s.end}" for s in rows[1].pii if s.kind in RULES) == sorted(brute(many))
    for r, text in ((rows[1], many), (rows[2], df.filter("doc_id = 2").first().text)):
        parts, at, spans = [], 0, sorted((s.start, -s.end, s.kind) for s in r.pii)
        for start, back, kind in spans:
            if start >= at:
                parts += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, -back)
        assert r.redacted == "".join(parts) + text[at:]


def test_wide_spans_in_a_large_background(spark):
    """Recall and precision of added spans among a background a hundred times as large, which holds base spans and look-alikes."""
    good = ["call {n3}-{n3}-{n4} after six", "SSN {n3}-{n2}-{n4} on file", "IBAN DE{n2} {n4} {n4} {n4} {n4} {n2} here", "mail jo{n2} (at) site (dot) org today", "account GB{n2}NWBK{n4}{n4}{n4}{n2} now", "ip fe80::{n4}:{n3}:{n4}:{n2} seen"]
    bad = ["see pages {n3}-{n3} and {n3}-{n3}", "in {n4}-{n4} they left", "version {n2}.{n2}.{n2}.{n2}.{n1} came", "order {n4}-{n3}-{n2} sent", "scores {n2} {n2} {n2} {n2} again", "table {n1}.{n1} {n1}.{n1} {n1}.{n1} below"]
    plain = ["mail a{n3}@b.cd or x{n4}@y.org", "server 10.{n2}.{n2}.{n2} answered", "nothing {n4} here {n2}", "phone +49 {n3} {n4}{n2}"]
    import random

    rng = random.Random(8)
    fill = lambda t: re.sub(r"\{n(\d)\}", lambda m: str(rng.randrange(10 ** (int(m[1]) - 1), 10 ** int(m[1]))), t)
    rows = [(i, 1, fill(good[i % 6])) for i in range(120)] + [(1000 + i, 0, fill(bad[i % 6])) for i in range(120)]
    rows += [(10_000 + i, 2, fill(plain[i % 4])) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, what int, text string")
    found = {(r.what, r.doc_id): r.added for r in pii.find_pii(df).select("what", "doc_id", F.exists("pii", lambda c: c["kind"].isin(*pii.WIDE_KINDS)).alias("added")).collect()}
    hit, false = sum(v for (w, _), v in found.items() if w == 1), sum(v for (w, _), v in found.items() if w == 0)
    assert hit >= 0.9 * 120, hit
    assert hit >= 0.9 * (hit + false), (hit, false)
