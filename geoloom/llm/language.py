"""Language ID by interpolated Kneser-Ney character models, one per language, kept as sorted hash arrays.

A model gives each character of a word, and the word's end, a probability from the three characters before it; lower
orders count in how many contexts an n-gram stands. The language with the lowest cross-entropy per character wins.
A logistic curve over the margin to the second-best and the length, fitted to sampled training documents that made no
model, turns it into a score; `accepted` is false where the cross-entropy or the score is out of the range that
right answers had there.

Models come from a bounded sample: about `Settings.per_language` documents of each language, by a hash of the id.
Scoring is one pass in Arrow batches: a batch's distinct words, and of those the distinct 4-grams, are looked up once.

A null text, or one without a letter, is `und` with score 0 and not accepted. Documents with a null language teach
nothing; without any teaching document all are `und`. Repeated rows are judged each for itself; extra columns pass
through `identify`, whose own columns replace any of that name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, fold_of, logistic, mix, raw, read

ORDER = 4
_START, _END = "\x02", "\x03"
_DROP = re.compile(r"[^\w\n]+|_+")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Settings:
    per_language: int = 2500
    #: Of the sampled documents, one of so many is for the curve.
    curve_part: int = 4
    folds: int = 5
    held_out: int = 0


def _hash(columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points; rows of different widths differ."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns), np.uint64(columns.shape[1] + 1))
        for j in range(columns.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + columns[:, j].astype(np.uint64))
    return h


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of cleaned words, start signs before and an end sign after each: code points, and the word's number."""
    text = _START * (ORDER - 1) + (_END + _START * (ORDER - 1)).join(words) + _END
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    real = np.flatnonzero(points != ord(_START))
    word = np.cumsum(points == ord(_END))[real]
    word[points[real] == ord(_END)] -= 1
    return np.stack([points[real - k] for k in range(ORDER - 1, -1, -1)], axis=1), word


def _clean(words: list[str]) -> list[str]:
    """Lower-cased words without marks; digits are all 0. Words stay aligned, so they hold no line end."""
    return _DIGIT.sub("0", _DROP.sub("", "\n".join(words).lower())).split("\n") if words else []


@dataclass
class Table:
    """One order of one language: the discounted share of each n-gram, and the weight that each context leaves to lower orders."""

    gram: np.ndarray
    share: np.ndarray
    context: np.ndarray
    rest: np.ndarray


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _kneser_ney(points: np.ndarray, counts: np.ndarray) -> tuple[list[Table], int]:
    """Tables of orders 1 to ORDER from distinct 4-grams and their counts, and the number of distinct characters."""
    tables = []
    for order in range(ORDER, 0, -1):
        rows = points[:, -order:]
        _, context, sizes = np.unique(_hash(rows[:, :-1]), return_inverse=True, return_counts=True)
        total = np.bincount(context, weights=counts)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        share = np.maximum(counts - discount, 0) / total[context]
        gram = _hash(rows)
        by = np.argsort(gram)
        tables.append(Table(gram[by], share[by], np.unique(_hash(rows[:, :-1])), discount * sizes / total))
        # one order down: each distinct n-gram counts once for its suffix
        if order > 1:
            suffix = _hash(rows[:, 1:])
            _, first, counts = np.unique(suffix, return_index=True, return_counts=True)
            points, counts = points[first], counts.astype(float)
    return tables[::-1], len(points)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    tables: list[tuple[list[Table], int]] = field(default_factory=list)
    #: Constant, factor of the margin, factor of the margin times the log of the length.
    curve: tuple[float, float, float] = (0.0, 2.0, 2.0)
    #: The highest cross-entropy of each language that is accepted, and the lowest score.
    most: list[float] = field(default_factory=list)
    least: float = 0.5

    def log_probabilities(self, points: np.ndarray) -> np.ndarray:
        """A row per 4-gram, a column per language: the natural log of the last character's probability."""
        grams = [_hash(points[:, -k:]) for k in range(1, ORDER + 1)]
        contexts = [_hash(points[:, -k:-1]) for k in range(1, ORDER + 1)]
        out = np.empty((len(points), len(self.languages)))
        for j, (tables, size) in enumerate(self.tables):
            p = np.full(len(points), 1.0 / (size + 1))
            for table, gram, context in zip(tables, grams, contexts, strict=True):
                p = _find(table.gram, table.share, gram, 0.0) + _find(table.context, table.rest, context, 1.0) * p
            out[:, j] = np.log(p)
        return out

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text and language, and the characters of each text; none: no letter."""
        words = Words(texts)
        n, k = len(texts), len(self.languages)
        if not len(words.start):
            return np.zeros((n, k)), np.zeros(n)
        codes, found = pd.factorize(words.hashes())
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        data = words.buf.tobytes()
        distinct = _clean([data[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])
        letters = np.fromiter((any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
        points, word = _grams(distinct)
        at, unique = pd.factorize(_hash(points))
        one = np.empty(len(unique), np.int64)
        one[at[::-1]] = np.arange(len(at))[::-1]
        logs = self.log_probabilities(points[one])[at]
        size = np.bincount(word, minlength=len(distinct)) * letters
        chars = np.bincount(words.text, weights=size[codes], minlength=n)
        out = np.zeros((n, k))
        for j in range(k):
            per_word = np.bincount(word, weights=logs[:, j], minlength=len(distinct)) * letters
            out[:, j] = -np.bincount(words.text, weights=per_word[codes], minlength=n) / np.maximum(chars, 1)
        return out, chars

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language (-1: und), score, cross-entropy, accepted."""
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        entropy, chars = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        score = 1 / (1 + np.exp(-np.clip(_inputs(entropy, chars) @ np.array(self.curve), -50, 50)))
        none = chars == 0
        most = np.array(self.most or [np.inf] * len(self.languages))
        return np.where(none, -1, best), np.where(none, 0.0, score), low, ~none & (low <= most[best]) & (score >= self.least)


def _inputs(entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
    two = np.sort(entropy, axis=1)
    margin = two[:, 1] - two[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
    return np.stack([np.ones(len(margin)), margin, margin * np.log1p(chars)], axis=1)


def _sample(docs: DataFrame, s: Settings) -> DataFrame:
    """(text, lang, part): about per_language documents of each language outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), s.folds) != s.held_out))
    sizes = known.groupBy("lang").count().collect()  # a row per language
    h = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    upto = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, s.per_language / r["count"]) * (1 << 20)))]) if sizes else None
    taught = known.filter(h < upto[F.col("lang")]) if sizes else known.limit(0)
    return taught.select("text", "lang", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(s.curve_part)).alias("part"))


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    s = settings or Settings()
    taught = _sample(docs, s)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(text.split())
        for lang, words in found.items():
            total: Counter = Counter()
            names = list(words)
            for at in range(0, len(names), 100_000):
                some = names[at : at + 100_000]
                clean = _clean(some)
                n = np.array([words[w] for w in some]) * np.fromiter((any(map(str.isalpha, w)) for w in clean), bool, len(clean))
                points, word = _grams(clean)
                grams = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                for i, c in enumerate(n[word].tolist()):
                    if c:
                        total[grams[ORDER * i : ORDER * i + ORDER]] += c
            rows = list(total.items())
            for at in range(0, len(rows), 50_000):
                some = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([g for g, _ in some]), pa.array([c for _, c in some], pa.int64())], names=["lang", "gram", "n"])

    grams = taught.filter("part > 0").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    model = Model()
    for lang in sorted({r.lang for r in grams}):
        own = [r for r in grams if r.lang == lang]
        points = np.frombuffer("".join(r.gram for r in own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
        model.languages.append(lang)
        model.tables.append(_kneser_ney(points, np.array([r.n for r in own], float)))
    if not model.languages:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            entropy, chars = sent.value.entropies(raw(part.column("text")))
            x, best = _inputs(entropy, chars), entropy.argmin(axis=1)
            right = [sent.value.languages[b] == lang for b, lang in zip(best, part.column("lang").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array(best), pa.array(entropy.min(axis=1)), pa.array(right)], names=["margin", "long", "best", "low", "right"])

    rows = taught.filter("part = 0").mapInArrow(measure, "margin double, long double, best long, low double, right boolean").collect()
    if rows:
        x = np.array([(1.0, r.margin, r.long) for r in rows])
        y = np.array([r.right for r in rows], float)
        model.curve = tuple(logistic(x, y, 1.0).tolist())
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -50, 50)))
        model.least = float(np.quantile(score[y > 0], 0.001)) if y.any() else 0.5
        for j in range(len(model.languages)):
            own = np.array([r.low for r in rows if r.right and r.best == j])
            model.most.append(float(np.quantile(own, 0.999) * 1.05) if len(own) else np.inf)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and accepted."""
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("accepted", T.BooleanType())]
    docs = docs.drop(*[n for n, _ in new])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(*x) for x in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, "und"], object)
        for part in chunks(batches, text):
            best, score, low, accepted = sent.value.judge(raw(part.column(text)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(low), pa.array(accepted)], names=[*part.schema.names, *[n for n, _ in new]])

    return docs.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.drop("lang"), fit(docs, s))
    return found.select("doc_id", (fold_of(F.col("doc_id"), s.folds) == s.held_out).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


#: A learned model has no SQL; tests hold it against a plain Kneser-Ney and held-out languages.
QUERIES = {"op8_language": op8_language}
