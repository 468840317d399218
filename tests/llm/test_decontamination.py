"""Benchmark passages in documents, against brute force on tokens."""

from collections import defaultdict

import pytest
import regex
from corpus import SF, documents, odd
from geoloom.llm import decontamination as d

K = 5
NUMBER, UNIT, DOT = "\ue000", "\ue001", "\ue002"


def tokens(text):
    """(word, last name before it) of what is no capitalised word."""
    text = regex.sub("[\ue000-\ue007]", " ", text)
    if regex.search("[0-9]", text):
        text = regex.sub("(?<=[0-9])[.,](?=[0-9])", DOT, text)
        text = regex.sub(rf"([0-9][ \t\n\x0b\f\r]?)(?=(?:{'|'.join(d.UNITS.split())})\b)", rf"\1 {UNIT}", text)
    out, names = [], []
    for m in regex.finditer(rf"[\p{{L}}\p{{N}}\ue000-\ue007]+", text):
        if regex.match(r"\p{Lu}\p{Ll}", m[0]) and not set(m[0]) & {UNIT, DOT}:
            if regex.search(r"[\p{L}\p{N},;)] \Z", text[max(0, m.start() - 2) : m.start()]):
                names.append(m[0].lower())
            continue
        out.append((m[0].lower(), names[-1] if names else ""))
        names = []
    return out


def shape(w):
    return UNIT if w[0] == UNIT else NUMBER if "0" <= w[0] <= "9" else w


def cover(places):
    return len({p + x for p in places for x in range(K)})


def consistent(pairs):
    return len({a for a, _ in pairs}) == len(pairs)


def brute(docs, bench):
    """(doc, item, covered share, kind): consistent template windows, or plain windows, over 80 % of the item."""
    index, size, plain = defaultdict(list), {}, {}
    for item, text in bench:
        w = tokens(text)
        own = [(j, w[j : j + K]) for j in range(len(w) - K + 1)]
        own = [(j, cut) for j, cut in own if sum(shape(x) == x for x, _ in cut) >= 2]
        if own and cover({j for j, _ in own}) >= 0.8 * len(w):
            size[item] = len(w)
            for j, cut in own:
                index[tuple(shape(x) for x, _ in cut)].append((item, j, cut))
        elif regex.search(r"[\p{L}\p{N}]", text):
            plain[item] = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    found = set()
    for doc, text in docs:
        w = tokens(text or "")
        runs = defaultdict(lambda: (set(), set()))
        for i in range(len(w) - K + 1):
            mine = w[i : i + K]
            for item, j, cut in index.get(tuple(shape(x) for x, _ in mine), ()):
                at, pairs = runs[item, i - j]
                at.add(j)
                pairs |= {("v" + a, "v" + b) for (a, _), (b, _) in zip(cut, mine, strict=True) if shape(a) != a}
                pairs |= {("n" + a, "n" + b) for (_, a), (_, b) in zip(cut, mine, strict=True) if a and b}
        of = defaultdict(list)
        for (item, shift), (at, pairs) in runs.items():
            if consistent(pairs):
                of[item].append(((cover(at), -abs(shift), shift), at, pairs))
        for item, several in of.items():
            all_pairs = set().union(*[p for _, _, p in several])
            best = max(several, key=lambda x: x[0])
            c, pairs = (cover(set().union(*[a for _, a, _ in several])), all_pairs) if consistent(all_pairs) else (best[0][0], best[2])
            if c >= 0.8 * size[item]:
                found.add((doc, item, round(c / size[item], 6), "exact" if all(a == b for a, b in pairs) else "re-parameterised"))
        raw = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        there = defaultdict(set)
        for i in range(len(raw) - K + 1):
            there[tuple(raw[i : i + K])].add(i)
        for item, words in plain.items():
            if len(words) < K:
                c = len(words) if raw == words else 0
            else:
                c = cover({j for j in range(len(words) - K + 1) if tuple(words[j : j + K]) in there})
            if c and c >= 0.8 * len(words):
                found.add((doc, item, round(c / len(words), 6), "exact"))
    return found


def run(docs, bench):
    return {(r.doc_id, r.item_id, round(r.share, 6), r.kind) for r in d.find_leaks(docs, bench).collect()}


ITEMS = [(1, "If Tom buys 12 apples and 7 pears for 3.50 euros; how many pieces of fruit does Tom carry home?"), (2, "too short"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9")]
TEXTS = [
    (1, "intro. If Tom buys 12 apples and 7 pears for 3.50 euros; how many pieces of fruit does Tom carry home? end"),
    (2, "And if Ann buys 90 apples and 41 pears for 17.25 euros; how many pieces of fruit does Ann carry home? ok"),
    (3, "so if Ann buys 90 apples and 41 pears for 17.25 euros; how many pieces of fruit does Bob carry home? ok"),
    (4, "so Ann buys 90 oranges or 41 plums at 17.25 euros; what is the price"), (5, "then 1 2 3 4 5 6 7 8 9 or so"), (6, None), (7, "Too short!"), (8, "it is too short"),
]


def test_reparameterised(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(a, b): k for a, b, _, k in run(docs, bench)}
    assert got == {(1, 1): "exact", (2, 1): "re-parameterised", (5, 5): "exact", (7, 2): "exact"}, got
    assert run(docs, bench) == brute(TEXTS, [(i, t or "") for i, t in ITEMS])
    assert run(docs, bench.limit(0)) == set() and run(docs.limit(0), bench) == set()
    assert {r.doc_id for r in d.decontaminate(docs, bench).collect()} == {3, 4, 6, 8}


def test_recall_of_reparameterised_items(spark):
    """Planted items with other numbers and with names of another length, also where a sentence begins; a name with a lower-case part may be lost."""
    import random

    rng = random.Random(6)
    people = ["Tom", "Anna", "Mary Jane", "José", "Dr Miller", "Li", "Karim", "Maria de Souza"]
    shapes = [
        "{a} has {x} apples. {a} buys {y} pears. How many pieces of fruit has {a} now?", "A train leaves at {x} and travels {y} km to {b}. When does {a} arrive in {b}, if it stops for {z} minutes?",
        "In the morning {a} gives {b} {x} coins and {b} pays {y} euros for a book; what does {b} have left?", "Wie viele Stunden braucht {a} für {x} km mit {y} km pro Stunde, wenn {b} schon {z} minutes wartet?",
        "Compute {x} + {y} * {z} - {x} / {y}", "If {a} runs {x} miles in {y} minutes, how far does {a} run in {z} hours at the same speed?",
    ]
    items, docs = [], []
    for k in range(120):
        t = shapes[k % 6]
        fill = lambda: t.format(**dict(zip("ab", rng.sample(people, 2), strict=True)), **dict(zip("xyz", rng.sample(range(2, 900), 3), strict=True)))  # noqa: B023, E731
        if k < 6:
            items.append((k, fill()))
        docs.append((k, f"some words before it. {fill() if k % 6 != 4 else items[4][1]} And some more after."))
    got = {(a, b) for a, b, *_ in run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))}
    assert len(got & {(k, k % 6) for k in range(120)}) >= 0.9 * 120 and all(b == a % 6 for a, b in got)


def test_alignments_must_agree(spark):
    """Two parts of an item, moved against each other: found if the slots agree over both, else not."""
    item = "first we count 12 red apples in a box and then again later we see 12 green apples on the table over there"
    docs = [(1, item.replace("12", "30").replace("later", "later that day")), (2, item.replace("12 red", "30 red").replace("12 green", "31 green").replace("later", "later that day"))]
    got = {a for a, *_ in run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))}
    assert got == {1} and {a for a, *_ in brute(docs, [(1, item)])} == {1}


@pytest.mark.parametrize("docs", [documents, odd])
def test_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    df = docs(spark)
    assert run(df, bench) == brute([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert d.decontaminate(df, bench).columns == df.columns


def test_planted_passage_and_shuffle_join(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    docs = spark.createDataFrame([(7, f"Vorher. {item.text} nachher"), (8, "nothing here")], "doc_id long, text string")
    monkeypatch.setattr(d, "MOST_BROADCAST", 0)
    assert {(a, b) for a, b, _, _ in run(docs, bench)} == {(7, item.item_id)}
