"""Helpers shared by the corpus operators: shared-folder tables, Arrow batches and byte-level words."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; a longer document is handled alone.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again: lineage is cut and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text each, but one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: every power of it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the step and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for name, step in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                table = np.full(size, np.uint64(step))
                table[0] = 1
                _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = _power(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[buf] * up[: len(buf)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts as arrays: start and end in .buf, text number, and a 64-bit hash."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        self.n_texts = len(texts)
        self.text_start = np.cumsum(sizes + 1) - sizes - 1
        self.text_size = sizes
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = ~SPACE[self.buf]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.n_texts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)

    def words(self) -> list[bytes]:
        data = self.buf.tobytes()
        return [data[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def windows(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of k words of one text begin, and a hash of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            total = total * np.uint64(_STEP) + h[at + j]
    return at, mix(total)


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's steps for logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
