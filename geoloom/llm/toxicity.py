"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick, length normalisation and exception phrases.

Folding lower-cases, maps homoglyphs to the letters they look like, and digits and signs that stand for letters to those
(everywhere in the text), and drops zero-width characters. The lexicon is learned from labelled documents: words, and beginnings of words of four to
eight letters that stand for whole families, each with the log of its odds ratio as a weight. A document's weights, less
those inside exception phrases, are summed and divided by its length; a logistic curve over both sums turns them
into a score. The labelled rows are a bounded sample (`Settings.sample`, by a hash of the id): two thirds make the
lexicon, one third the curve and the exceptions. Only the learned entries (at most `Settings.entries`) are broadcast.

Null and empty texts score the curve's value at zero. Labels that are null or stand for no document teach nothing;
without labels every score is 0. Repeated rows are scored each for itself; extra columns pass through `score`, whose
own columns replace any of that name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fold_of, logistic, read, stored

#: Cyrillic, Greek, full-width and accented letters, and signs, by the Latin letter they look like.
LOOKALIKES = {
    "a": "аαａàáâãåā@", "b": "вβｂ8", "c": "сϲｃ¢", "d": "ԁｄ", "e": "еεｅèêëē3", "g": "ɡｇ", "h": "һｈ", "i": "іιｉìîïīı1", "j": "јｊ", "k": "кκｋ", "l": "ⅼｌ", "m": "мｍ", "n": "пηｎ",
    "o": "оοｏòôõō0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ5$", "t": "тτｔ7", "u": "υｕùûū", "v": "ѵνｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ2",
}
_FOLD = str.maketrans({g: a for a, some in LOOKALIKES.items() for g in some} | {g: None for g in "​‌‍⁠﻿­"})
_WORD = re.compile(r"[^\W_]+")
#: Phrases in which a word of the lexicon is harmless; others are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "white noise")


@dataclass(frozen=True)
class Settings:
    #: About so many labelled documents teach, chosen by a hash of the id.
    sample: int = 20_000
    #: Entries of the lexicon at most, by weight times documents.
    entries: int = 20_000
    stems: tuple[int, ...] = (4, 5, 6, 7, 8)
    min_docs: int = 3
    #: Of the documents with an entry, so many must be toxic (counted with half a clean one).
    min_precision: float = 0.8
    threshold: float = 0.3
    folds: int = 4
    held_out: int = 2


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def _features(text: str, stems: tuple[int, ...]) -> set[str]:
    """The words of a folded text, and the beginnings of longer words marked by a star."""
    words = {w for w in _WORD.findall(fold(text)) if 2 < len(w) <= 40}
    return words | {f"{w[:n]}*" for w in words for n in stems if len(w) > n}


@dataclass
class Model:
    """weights: entry -> weight (a star: beginning of a word); curve: constant and factors of the two sums."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)


class Matcher:
    """An automaton over the entries and exceptions of a model."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.machine = model, ahocorasick.Automaton()
        for entry, w in model.weights.items():
            self.machine.add_word(entry.rstrip("*"), [])
        for phrase in model.exceptions:
            self.machine.add_word(fold(phrase), [])
        for entry, w in model.weights.items():
            self.machine.get(entry.rstrip("*")).append((len(entry.rstrip("*")), w, entry.endswith("*")))
        for phrase in model.exceptions:
            self.machine.get(fold(phrase)).append((len(fold(phrase)), 0.0, False))
        if len(self.machine):
            self.machine.make_automaton()

    def sums(self, text: str) -> tuple[float, float, list[tuple[int, int, str]]]:
        """The sum of the weights, the same by length, and the matches (start, end, folded text around)."""
        if not len(self.machine) or not text:
            return 0.0, 0.0, []
        folded = fold(text)
        hits: dict[int, tuple[int, float]] = {}
        shields = []
        for last, entries in self.machine.iter(folded):
            for size, w, begins in entries:
                a, b = last + 1 - size, last + 1
                if (a and folded[a - 1].isalnum()) or (not begins and b < len(folded) and folded[b].isalnum()):
                    continue
                if w == 0.0:
                    shields.append((a, b))
                elif w > hits.get(a, (0, 0.0))[1]:
                    hits[a] = (b, w)
        kept = [(a, b, w) for a, (b, w) in hits.items() if not any(x <= a and b <= y for x, y in shields)]
        total = sum(w for _, _, w in kept)
        return total, total / (20.0 + len(folded) / 6.0), [(a, b, folded) for a, b, _ in kept]


def _inputs(total: float, dense: float) -> tuple[float, float, float]:
    return 1.0, float(np.log1p(total)), float(np.log1p(20.0 * dense))


def _taught(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(text, toxic, part) of the sample; part 2 is for the curve. The bound is kept by a share of the hash's range."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold_of(F.col("doc_id"), s.folds) != s.held_out)
    share = min(1.0, s.sample / max(1, known.count()))
    h = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    known = known.filter(h < int(share * (1 << 20))).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)).cast("int"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "part").dropDuplicates(["text"])


def _lexicon(taught: DataFrame, s: Settings) -> dict[str, float]:
    """Entries with weights: counted per task, summed by Spark; the driver gets those that are toxic enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic > 0].update(_features(text, s.stems))
                counts[toxic > 0][""] += 1
        names = sorted(counts[0].keys() | counts[1].keys())
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[0][n] for n in some], pa.int64()), pa.array([counts[1][n] for n in some], pa.int64())], names=["entry", "clean", "toxic"])

    own = taught.filter("part < 2").mapInArrow(run, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean") + 0.5)
    gain = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    best = own.withColumn("gain", gain).filter((F.col("entry") == "") | ((F.col("toxic") >= s.min_docs) & (rate >= s.min_precision)))
    rows = [tuple(r) for r in best.orderBy((F.col("entry") != "").cast("int"), F.desc("gain"), "entry").drop("gain").limit(s.entries + 1).collect()]
    if not rows or rows[0][0] != "":
        return {}
    _, n0, n1 = rows[0]
    stems = {e[:-1] for e, _, _ in rows if e.endswith("*")}
    found = {}
    for entry, clean, toxic in rows[1:]:
        plain = entry.rstrip("*")
        if any(plain[:n] in stems for n in s.stems if n < len(plain)):  # a shorter beginning says it already
            continue
        found[entry] = float(np.log((toxic + 0.5) / (n1 + 1.0)) - np.log((clean + 0.5) / (n0 + 1.0)))
    return {e: w for e, w in found.items() if w > 0}


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    s = settings or Settings()
    taught = _taught(docs, labels, s)
    first = Model(_lexicon(taught, s))
    if not first.weights:
        return first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(first)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                total, dense, hits = matcher.sums(text)
                around = {p for a, b, f in hits for p in (_before(f, a) + f[a:b], f[a:b] + _after(f, b)) if p != f[a:b]}
                rows.append((total, dense, int(toxic > 0), sorted(around)))
            yield pa.RecordBatch.from_pylist([dict(zip(("total", "dense", "toxic", "around"), r, strict=True)) for r in rows], pa.schema([("total", pa.float64()), ("dense", pa.float64()), ("toxic", pa.int32()), ("around", pa.list_(pa.string()))]))

    judged = stored(taught.filter("part = 2").mapInArrow(run, "total double, dense double, toxic int, around array<string>"))  # a third of the sample
    phrases = judged.select(F.explode("around").alias("phrase"), "toxic").groupBy("phrase").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("bad"))
    learned = tuple(sorted(r.phrase for r in phrases.filter("clean >= 3 AND bad = 0").collect()))
    rows = judged.select("total", "dense", "toxic").collect()
    if not rows:
        return Model(first.weights, EXCEPTIONS + learned, (-2.0, 1.0, 1.0))
    x = np.array([_inputs(r.total, r.dense) for r in rows])
    curve = logistic(x, np.array([r.toxic for r in rows], float))
    return Model(first.weights, EXCEPTIONS + learned, tuple(curve.tolist()))


def _before(f: str, a: int) -> str:
    m = re.search(r"[^\W_]+ $", f[max(0, a - 30) : a])
    return m[0] if m else ""


def _after(f: str, b: int) -> str:
    m = re.match(r" [^\W_]+", f[b : b + 30])
    return m[0] if m else ""


def score(docs: DataFrame, model: Model, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """docs with score and predicted: one pass in Arrow batches without a shuffle."""
    s = settings or Settings()
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, curve = Matcher(sent.value), np.array(sent.value.curve)
        for part in chunks(batches, text):
            sums = [matcher.sums(t)[:2] for t in part.column(text).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array([_inputs(*x) for x in sums]) @ curve, -50, 50)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, read(spark, sf_dir, "labels"), s), settings=s)
    return found.select("doc_id", (fold_of(F.col("doc_id"), s.folds) == s.held_out).alias("held_out"), "score", "predicted")


#: A learned score has no SQL; tests hold its base against brute force and its accuracy against held-out labels.
QUERIES = {"op10_toxicity": op10_toxicity}
