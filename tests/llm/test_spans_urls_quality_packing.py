"""Secret spans, url verdicts, quality counts and packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import documents, odd
from geoloom.llm import packing, quality, secrets, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_spans(text):
    kinds = (("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    found = [(m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(kinds) for m in rx.finditer(text or "") if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


@pytest.mark.parametrize("docs", [documents, odd])
def test_secret_base_spans(spark, docs):
    df = docs(spark)
    got = secrets.digests(df).collect()
    assert len(got) == df.count()
    want = defaultdict(Counter)
    for r in df.collect():
        s = brute_spans(r.text)
        want[r.doc_id][hashlib.sha256(",".join(s).encode()).hexdigest(), *[sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")]] += 1
        have = [x for g in got if g.doc_id == r.doc_id for x in g.spans.split(",")]
        assert set(s) <= set(have)
    have = defaultdict(Counter)
    for g in got:
        have[g.doc_id][g.base_sha256, g.n_assign, g.n_access, g.n_hex] += 1
    assert have == want


def test_secret_method_adds_and_index_loses_nothing(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "Zq1" * 13 + " https://user:pa55@host/x pwd=abcdefgh1"
    row = secrets.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [x.split(":")[0] for x in row.spans.split(",")] == ["private_key", "provider", "url_login", "credential"]
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == frozenset({frozenset({"aki", "kia"})})
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(secrets.BASE[0].regex)


def test_secret_empty_table(spark):
    assert secrets.digests(documents(spark).limit(0)).count() == 0


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h, p, v) for h, p, v in urls.ENTRIES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: (x[0].count("."), len(x[0]), len(x[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [None, "", "x", "http://", "http://net", "http://net/", "http://A.Example.NET/en/x?q#f", "http://example.net/en", "https://b.example.com/de/1", "http://example.com/de", "http://example.com/dex", "http://x.org/fr/", "http://xorg/fr/", "a://b://c.net/", "http://é.net/", "http://notexample.com/de/", "http://a.net?x=/", "http://a.net#/"]


def test_urls(spark):
    given = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + URLS + URLS
    df = spark.createDataFrame([(i, u, "kept", "h") for i, u in enumerate(given)], "page_id long, url string, extra string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(given)}
    entries = spark.createDataFrame(urls.ENTRIES, "host string, path string, verdict string")
    joined = urls.judge_by_join(urls.host_and_path(df.drop("host")), entries)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in joined.collect()} == got
    assert urls.judge_urls(df.limit(0)).count() == 0


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 8))
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


@pytest.mark.parametrize("docs", [documents, odd])
def test_quality(spark, docs):
    df = docs(spark)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    got = quality.clean(df)
    assert set(df.columns) < set(got.columns)
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert tuple(r[f"quality_{n}"] for n in names) == brute_quality(r.text), r.doc_id
        assert not (r.quality_base_failed and r.quality_kept)


def test_quality_lines(spark):
    rules = quality.Rules()
    assert quality.line_rule(b"All rights reserved.", rules) == "boilerplate"
    assert quality.line_rule(b"Home | News | About | More", rules) == "navigation"
    assert quality.line_rule(b"*** %%% a### b&&&", rules) == "punctuation"
    assert quality.line_rule("Ein gewöhnlicher Satz, nichts weiter.".encode(), rules) == ""
    for notice in ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Released under the MIT License."):
        assert quality.line_rule(notice.encode(), rules) == "boilerplate", notice
    for menu in ("Zurück", "Lire la suite", "Iniciar sesión"):
        assert quality.line_rule(menu.encode(), rules) == "navigation", menu
    import re

    for phrases in quality._PHRASES:  # each phrase has an anchor
        for alternative in re.split(r"\|(?![^(]*\))", phrases):
            plain = re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", alternative.replace("[sc]", "s").replace("\\b", "").replace(".", "'"))
            assert quality.line_rule(plain.encode(), rules) == "boilerplate", plain
    legal = "Our privacy policy and the terms of use say that all rights reserved by the owner stay with " + " ".join(f"x{i}" for i in range(80))
    assert quality.line_rule(legal.encode(), rules) == "boilerplate" and quality.line_rule(b"a law about copyright " + b" ".join(b"w%d" % i for i in range(60)), rules) == ""
    good = "Line %s has a few words all %s own.\n"
    text = "".join(good % (i, i) for i in "abc") + "All rights reserved.\n"
    rows = quality.clean(spark.createDataFrame([(1, text), (2, "All rights reserved. x y z.\n" * 1 + "|| a || b || c\n" * 3 + good % (1, 1))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].quality_kept and rows[0].quality_text == "".join(good % (i, i) for i in "abc")
    assert not rows[1].quality_kept


@pytest.mark.parametrize("docs", [documents, odd])
def test_packing(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    df = docs(spark)
    rows = packing.pack_documents(df).collect()
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append([*whole.encode(r.text or "", add_special_tokens=False).ids, 0])
    pieces = defaultdict(Counter)
    for r in rows:
        pieces[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
    want = defaultdict(Counter)
    for doc, several in ids.items():
        for x in several:
            n = len(x)
            first = n if n <= 2048 else n % 2048 or 2048
            cuts = [0, *range(first, n, 2048), n] if n > first else [0, n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[doc][k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert pieces == want
    packed = defaultdict(list)
    for r in rows:
        packed[r.sequence_id].append((r.offset, r.length))
    for s in packed.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(packed) <= max(-(-total // 2048) * 1.03 + 1, sum(r.length > 1024 for r in rows) + 1)


def test_packing_empty(spark):
    assert packing.pack_documents(documents(spark).limit(0)).count() == 0


def test_plan_is_exact():
    counts = {2048: 5, 2000: 7, 48: 9, 1024: 3, 700: 4, 1: 1}
    rows, n = packing.plan(counts)
    fill = Counter()
    used = Counter()
    for length, first, ranks, sequence, offset in rows:
        assert used[length] == first
        used[length] += ranks
        for i in range(ranks):
            fill[sequence + i] += length
    assert used == counts and max(fill.values()) <= 2048 and len(fill) == n
