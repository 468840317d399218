"""LM scoring with a hashed maximum-entropy model: n-gram and skip features, class-factored softmax, sparse numpy batches.

Counts. Documents are dealt into chunks of some 32 MB of text and written. Each chunk lists its distinct words once, as
64-bit hashes with their counts in training documents; a window over the hash sums them up for the whole corpus (a word
has a row per chunk at most), and the sums go back to the chunks that asked, where they meet the texts again. So the
vocabulary, which grows with the corpus, is never held in one place.

Model. Every word has a class. The commonest words, ranked by their full counts, and the end have places of their own
in the first classes, in order of frequency; all other words are in classes by the size of their count (a power of two
each), where their hash gives the place, and the share of a word inside its place is its smoothed count; a word that
training documents lack is one more class. P(class | history) and P(place | class, history) are softmaxes over hashed
features: the word before, the two before, the one before those (a skip), and the word before with the third (a
skip-gram), each from the words' own hashes, whatever their frequency. The number of classes and of hashed features grows
with the vocabulary (`sized`), within bounds that keep what is broadcast small. Without features the model says the
words' shares in the training documents; the weights of the features start at zero and are moved by `Settings.rounds` rounds of distributed gradient updates: each task adds up
observed less expected counts over its part of the positions of every training document (the rounds share all positions
out among them), Spark sums them by feature, and the driver moves the weights.

Null and empty texts are the end token alone. A null id is in the fold of the empty text. Repeated rows are scored each
for itself. Without training documents all counts are 0 and every token is rare. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, fold_of, mix, raw, read, stored

#: The hash of the end token, which no word has but by chance.
END = -0x6C6D5F656E640001
N_FEATURES = 4
#: The features that choose the word inside its class.
WORD_FEATURES = (0, 2)


@dataclass(frozen=True)
class Settings:
    #: Classes and bits of the feature hashes; 0: by the size of the vocabulary.
    classes: int = 0
    width: int = 32
    class_bits: int = 0
    word_bits: int = 0
    #: Least and most bits; at the most, the two weight tables have 100 MB.
    bits_from: int = 13
    bits_upto: int = 18
    rounds: int = 2
    #: Of the first round; the k-th takes a k-th of it.
    step: float = 1.0
    prior: float = 5.0
    chunk_bytes: int = 32 << 20
    folds: int = 5
    held_out: int = 1
    block: int = 1 << 15

    @property
    def head(self) -> int:
        """Words with a place of their own, the end among them."""
        return self.classes // 2 * self.width

    @property
    def unknown(self) -> int:
        """The place of words that training documents lack."""
        return (self.classes - 1) * self.width


def sized(s: Settings, words: int) -> Settings:
    """Settings with classes and bits for so many distinct words: both grow with the logarithm, the features with a power of the vocabulary."""
    bits = min(max(words.bit_length() - 8, s.bits_from), s.bits_upto)
    return replace(s, classes=s.classes or min(max(words.bit_length() + 10, 24), 48), class_bits=s.class_bits or bits, word_bits=s.word_bits or bits)


# ---- counts ----


def _dealt(docs: DataFrame, s: Settings) -> DataFrame:
    """(chunk, doc_id, text, training), written."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("training", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, size, k = TaskContext.get().partitionId() << 24, 0, 0
        for part in chunks(batches):
            if size > s.chunk_bytes:
                size, k = 0, k + 1
            size += part.column("text").nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, base + k)), *part.columns], names=schema.names)

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold_of(F.col("doc_id"), s.folds) != s.held_out).alias("training"))
    return stored(own.mapInArrow(run, schema), "zstd")


def _asked(dealt: DataFrame) -> DataFrame:
    """(chunk, word, n): each distinct word of a chunk and its count in training documents, 0 where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            codes, unique = pd.factorize(np.concatenate(words))
            n = np.bincount(codes, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
            for at in range(0, len(unique), 100_000):
                u = unique[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), now)), pa.array(u), pa.array(n[at : at + 100_000])], names=["chunk", "word", "n"])

        for part in chunks(batches):
            chunk = part.column("chunk").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if now is not None and chunk[a] != now:
                    yield from out()
                    words, counts = [], []
                now = chunk[a]
                piece = part.slice(a, b - a)
                training = piece.column("training").to_numpy(zero_copy_only=False).astype(bool)
                found = Words(raw(piece.column("text")), lower=True)
                codes, unique = pd.factorize(found.hashes().view(np.int64))
                words += [unique, np.array([END])]
                counts += [np.bincount(codes, weights=training[found.text], minlength=len(unique)), np.array([float(training.sum())])]
        if now is not None:
            yield from out()

    return dealt.select("chunk", "text", "training").mapInArrow(run, "chunk long, word long, n long")


def _totals(asked: DataFrame) -> DataFrame:
    """(chunk, word, c, first): what was asked with the count in all training documents; `first` in one row of each word. Written."""
    by_word = W.partitionBy("word")
    return stored(asked.select("chunk", "word", F.sum("n").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first")), "zstd")


def _places(word: np.ndarray, c: np.ndarray, common: np.ndarray, s: Settings) -> np.ndarray:
    """The place (class times width, and position) of each word. common: the words with places of their own, in order."""
    if not len(word):
        return np.zeros(0, np.int64)
    band = np.clip(np.frexp(np.maximum(c, 1).astype(float))[1] - 1, 0, s.classes - 2 - s.classes // 2)
    place = s.head + band * s.width + (word.view(np.uint64) % np.uint64(s.width)).astype(np.int64)
    place[c == 0] = s.unknown
    order = np.argsort(common)
    at = np.minimum(np.searchsorted(common[order], word), len(common) - 1)
    own = common[order][at] == word
    place[own] = order[at[own]]
    return place


@dataclass
class Vocabulary:
    """words: those with places of their own, the end first; mass: smoothed counts of the words of each place; n and v: training tokens and distinct ones."""

    words: np.ndarray
    mass: np.ndarray
    n: int
    v: int


def _vocabulary(totals: DataFrame, settings: Settings) -> tuple[Vocabulary, Settings]:
    once = totals.filter("first").select("word", "c")
    n, v = (int(x or 0) for x in once.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    s = sized(settings, v)
    best = once.filter((F.col("c") > 0) & (F.col("word") != END)).orderBy(F.desc("c"), "word").limit(s.head - 1)
    common = np.array([END, *[r.word for r in best.collect()]])
    size = s.classes * s.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(size)
        for batch in batches:
            word, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            there = c > 0
            mass += np.bincount(_places(word[there], c[there], common, s), weights=c[there] + 0.5, minlength=size)
        at = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[at])], names=["place", "mass"])

    mass = np.zeros(size)
    for r in once.mapInArrow(run, "place long, mass double").groupBy("place").agg(F.sum("mass").alias("mass")).collect():  # a row per place
        mass[r.place] = r.mass
    mass[s.unknown] = 0.5
    mass[0] = max(mass[0], 0.5)
    return Vocabulary(common, mass, n, v), s


#: A token is 32 bits: the place, and above it a part of the word's hash that stands for the word in features.
PLACE_BITS = 11


def _counted(dealt: DataFrame, totals: DataFrame, vocabulary: Vocabulary, s: Settings) -> DataFrame:
    """Per document its numbers and its tokens."""
    sent = dealt.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dealt.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("training boolean, tokens long, known long, logs double, leaf_logs double, ids binary").fields])

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        word, c = (counts.column(n).to_numpy() for n in ("word", "c"))
        by = np.argsort(word)
        word, c = word[by], c[by]
        place = _places(word, c, sent.value.words, s)
        code = ((word.view(np.uint64) >> np.uint64(32 + PLACE_BITS)).astype(np.uint32) << np.uint32(PLACE_BITS)) | place.astype(np.uint32)
        logs = np.log10(c + 0.5)
        leaf = np.where((place >= s.head) & (place != s.unknown), logs - np.log10(np.maximum(sent.value.mass[place], 0.5)), 0.0)
        rows: list[pa.Table] = []
        for part in chunks(iter(texts.to_batches())):
            found = Words(raw(part.column("text")), lower=True)
            n = part.num_rows
            codes, unique = pd.factorize(found.hashes().view(np.int64))
            at = np.searchsorted(word, unique)[codes]
            end = np.searchsorted(word, END)
            tokens = found.count + 1
            known = np.bincount(found.text, weights=c[at] > 0, minlength=n) + (c[end] > 0)
            total = np.bincount(found.text, weights=logs[at], minlength=n) + logs[end]
            last = np.cumsum(tokens)
            flat = np.empty(last[-1] if n else 0, np.uint32)
            inner = np.ones(len(flat), bool)
            inner[last - 1] = False
            flat[inner], flat[~inner] = code[at], code[end]
            data = flat.tobytes()
            pieces = [data[4 * (b - k) : 4 * b] for b, k in zip(last.tolist(), tokens.tolist(), strict=True)]
            leaves = np.bincount(found.text, weights=leaf[at], minlength=n).astype(float)
            columns = [part.column("doc_id"), part.column("training"), pa.array(tokens, pa.int64()), pa.array(known.astype(np.int64)), pa.array(total), pa.array(leaves), pa.array(pieces, pa.binary())]
            rows.append(pa.Table.from_arrays(columns, names=schema.names))
        if not rows:
            return pa.Table.from_arrays([texts.column("doc_id").slice(0, 0), *[pa.array([], t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]], names=schema.names)
        return pa.concat_tables(rows)

    found = dealt.groupBy("chunk").cogroup(totals.select("chunk", "word", "c").groupBy("chunk")).applyInArrow(run, schema)
    return stored(found, "zstd")


# ---- the model ----


@dataclass
class Model:
    classes: np.ndarray
    words: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray


class Batch:
    """Tokens of several documents with their features."""

    def __init__(self, ids: list[bytes], s: Settings):
        self.s = s
        token = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        self.doc = np.repeat(np.arange(len(ids)), size)
        self.place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        before = []
        for k in (1, 2, 3):
            x = np.full(len(token), 0xFFFFFFFF, np.uint64)
            x[k:] = np.where(self.place[k:] >= k, token[:-k], np.uint32(0xFFFFFFFF)) if len(x) > k else x[k:]
            before.append(x)
        a, b, d = before
        wide = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            self.feature = [mix(x * np.uint64(8) + np.uint64(k)) for k, x in enumerate((a, a * wide + b, b, a * wide + d))]
        own = (token & np.uint32((1 << PLACE_BITS) - 1)).astype(np.int64)
        self.cls, self.pos = own // s.width, own % s.width

    def class_buckets(self, at: slice | np.ndarray) -> list[np.ndarray]:
        return [(f[at] >> np.uint64(64 - self.s.class_bits)).astype(np.int64) for f in self.feature]

    def word_buckets(self, at: slice | np.ndarray) -> list[np.ndarray]:
        c = self.cls[at].astype(np.uint64)
        with np.errstate(over="ignore"):
            return [(mix(self.feature[k][at] + c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.s.word_bits)).astype(np.int64) for k in WORD_FEATURES]


def positions(b: Batch, k: int, s: Settings) -> np.ndarray:
    """The positions that round k trains on; over the rounds each position comes once."""
    return np.flatnonzero((b.place + b.doc + k) % s.rounds == 0)


#: Rows of a softmax that stay in the processor's cache.
_ROWS = 2048


def _softmax(weights: np.ndarray, bias: np.ndarray, own: np.ndarray | None, buckets: list[np.ndarray]) -> np.ndarray:
    """A row of probabilities per position; own: the row of the bias for each position, where it has several."""
    out = np.empty((len(buckets[0]), weights.shape[1]), weights.dtype)
    more = np.empty((min(_ROWS, len(out)), weights.shape[1]), weights.dtype)
    for a in range(0, len(out), _ROWS):
        x = out[a : a + _ROWS]
        y = more[: len(x)]
        np.take(weights, buckets[0][a : a + _ROWS], axis=0, out=x, mode="clip")  # a mode, as the default one copies
        x += bias if own is None else np.take(bias, own[a : a + _ROWS], axis=0, out=y, mode="clip")
        for b in buckets[1:]:
            x += np.take(weights, b[a : a + _ROWS], axis=0, out=y, mode="clip")
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
    return out


def _sum_tables(rows: DataFrame, shapes: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Tables added up by Spark from rows (name, bucket, values); the driver gets a row per bucket, by Arrow."""
    width = max(w for _, w in shapes.values())
    summed = rows.groupBy("name", "bucket").agg(*[F.sum(F.get("values", F.lit(i))).cast("float").alias(f"v{i}") for i in range(width)])
    found = summed.toArrow()  # as many rows as there are buckets
    name, bucket = (found.column(c).to_numpy() for c in ("name", "bucket"))
    values = np.stack([found.column(f"v{i}").fill_null(0).to_numpy() for i in range(width)], axis=1) if len(name) else np.zeros((0, width))
    out = {}
    for k, shape in shapes.items():
        out[k] = np.zeros(shape)
        out[k][bucket[name == k]] = values[name == k][:, : shape[1]]
    return out


def _table_rows(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, table in tables.items():
        there = np.flatnonzero(np.abs(table).sum(axis=1))
        for at in range(0, len(there), 4096):
            some = there[at : at + 4096]
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * table.shape[1], table.shape[1]), pa.int32()), pa.array(table[some].ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name, np.int32)), pa.array(some, pa.int32()), values], names=["name", "bucket", "values"])


#: Names of the tables that a round adds up.
CLASSES_SEEN, CLASSES_MEANT, WORDS_SEEN, WORDS_MEANT = range(4)
_TABLE = "name int, bucket int, values array<float>"


def fit(counted: DataFrame, mass: np.ndarray, s: Settings) -> Model:
    """mass: smoothed counts of the words of each place, whose shares are what the model says without features."""
    training = counted.filter("training").select("ids")
    by_place = np.maximum(mass.reshape(s.classes, s.width), 1e-6)
    shapes = {CLASSES_SEEN: (1 << s.class_bits, s.classes), CLASSES_MEANT: (1 << s.class_bits, s.classes), WORDS_SEEN: (1 << s.word_bits, s.width), WORDS_MEANT: (1 << s.word_bits, s.width)}
    model = Model(np.zeros(shapes[CLASSES_SEEN]), np.zeros(shapes[WORDS_SEEN]), np.log(by_place.sum(axis=1) / by_place.sum()), np.log(by_place / by_place.sum(axis=1, keepdims=True)))
    model = _as_float32(model)
    for k in range(s.rounds):
        sent = counted.sparkSession.sparkContext.broadcast(model)

        def gradient(batches: Iterator[pa.RecordBatch], k: int = k, sent=sent) -> Iterator[pa.RecordBatch]:
            tables = {j: np.zeros(shape, np.float32) for j, shape in shapes.items()}
            for part in batches:
                for at in range(0, part.num_rows, 256):
                    b = Batch(part.column("ids").slice(at, 256).to_pylist(), s)
                    chosen = positions(b, k, s)
                    for a in range(0, len(chosen), s.block):
                        _add(sent.value, b, chosen[a : a + s.block], tables)
            yield from _table_rows(tables)

        g = _sum_tables(training.mapInArrow(gradient, _TABLE), shapes)
        for own, seen, meant in (("classes", CLASSES_SEEN, CLASSES_MEANT), ("words", WORDS_SEEN, WORDS_MEANT)):
            move = s.step / (k + 1) * (g[seen] - g[meant]) / (np.maximum(g[seen], g[meant]) + s.prior)
            setattr(model, own, getattr(model, own) + move)
        model = _as_float32(model)
    return model


def _as_float32(m: Model) -> Model:
    return Model(*[np.ascontiguousarray(x, np.float32) for x in (m.classes, m.words, m.class_bias, m.word_bias)])


def _add(m: Model, b: Batch, at: np.ndarray, tables: dict[int, np.ndarray]) -> None:
    """Adds the observed and the expected counts of the tokens at these places."""
    for p, seen, meant, own, buckets in (
        (_softmax(m.classes, m.class_bias, None, x := b.class_buckets(at)), CLASSES_SEEN, CLASSES_MEANT, b.cls[at], x),
        (_softmax(m.words, m.word_bias, b.cls[at], y := b.word_buckets(at)), WORDS_SEEN, WORDS_MEANT, b.pos[at], y),
    ):
        moved = np.empty_like(p)
        for bucket in buckets:
            short = bucket.astype(np.uint16) if len(tables[seen]) <= 1 << 16 else bucket  # sorted by radix
            order = np.argsort(short, kind="stable")
            sorted_bucket = bucket[order]
            begin = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]])
            tables[meant][sorted_bucket[begin]] += np.add.reduceat(np.take(p, order, axis=0, out=moved, mode="clip"), begin, axis=0)
            np.add.at(tables[seen].ravel(), bucket * p.shape[1] + own, np.float32(1))


def log10_of(m: Model, b: Batch, n_docs: int, s: Settings) -> np.ndarray:
    """Per document the log10 of the probabilities of its words' classes and places."""
    logs = np.empty(len(b.cls))
    for a in range(0, len(logs), s.block):
        at = np.arange(a, min(a + s.block, len(logs)))
        rows = np.arange(len(at))
        logs[at] = np.log10(_softmax(m.classes, m.class_bias, None, b.class_buckets(at))[rows, b.cls[at]])
        logs[at] += np.log10(_softmax(m.words, m.word_bias, b.cls[at], b.word_buckets(at))[rows, b.pos[at]])
    return np.bincount(b.doc, weights=logs, minlength=n_docs)


def score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    dealt = _dealt(docs, settings or Settings())
    totals = _totals(_asked(dealt))
    vocabulary, s = _vocabulary(totals, settings or Settings())
    counted = _counted(dealt, totals, vocabulary, s)
    sent = docs.sparkSession.sparkContext.broadcast(fit(counted, vocabulary.mass, s))
    n, unit = vocabulary.n, float(np.log10(vocabulary.n + 0.5 * (vocabulary.v + 1)))
    schema = T.StructType([dealt.schema["doc_id"], *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, base_score double, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                b = Batch(part.column("ids").to_pylist(), s)
                get = lambda name, part=part: part.column(name).to_numpy(zero_copy_only=False)
                model_logs = log10_of(sent.value, b, part.num_rows, s) + get("leaf_logs")
                held = pa.array(~get("training").astype(bool))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), held, part.column("tokens"), part.column("known"), pa.array(get("logs") - get("tokens") * unit), pa.array(model_logs)], names=schema.names)

    return counted.mapInArrow(run, schema).withColumn("train_tokens", F.lit(n).cast("long"))


def op3_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The base could be SQL, the trained score could not; tests hold the base against brute force and the score against it.
QUERIES = {"op3_maxent_scoring": op3_maxent_scoring}
