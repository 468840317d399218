"""Best-fit packing by patterns: a few lengths that fill a sequence form a pattern; non-negative least squares fits how
often each is repeated to the histogram of lengths; counts are rounded down and the rest is packed best-fit.

Documents are tokenised in one pass; what follows works on five numbers per piece. The driver sees only the histogram
(at most one row per length up to the capacity) and makes a plan whose rows are (length, range of ranks) -> (range of
sequences, offset). Ranks within a length are dealt by salted windows, so that a hot length is no single task.

A null text is empty: it has the closing id alone. Repeated rows are packed each for itself; rows that are equal in
all columns may swap places. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, chunks, parts, raw, read, span_hashes, stored

CAPACITY = 2048
#: Pieces of text whose ids a worker keeps.
CACHE_ENTRIES = 800_000


_PLAIN = re.compile(rb" ?[^\x00-\x20]+\Z")
#: White space beyond ASCII, and separators that not every library takes for white space: such texts are encoded whole.
_RARE_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_RARE_LEAD = np.zeros(256, bool)
_RARE_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Encoder:
    """Ids of a byte-level BPE file, equal to those of its own library.

    Texts are cut where a new pre-token always begins: at a space before a non-space, around line ends, and at a full
    stop or comma after an ASCII letter. Each distinct piece of a chunk is encoded once, and a worker keeps a bounded
    number of pieces. Texts with a special token's string go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        byte_of, names = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in names}
        self.bpe = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]
        self.kept: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        if len(self.kept) + len(pieces) > CACHE_ENTRIES:
            self.kept.clear()
        plain = [p for p in pieces if _PLAIN.match(p)]
        if plain:
            ids = np.array(self.bpe.encode_ordinary(b"\n".join(plain).decode()), "<u4")
            cuts = np.flatnonzero(ids == self.line_end).tolist()
            if len(cuts) == len(plain) - 1:  # else a line end went into a longer token: each piece for itself, below
                data = ids.tobytes()
                for p, a, b in zip(plain, [-1, *cuts], [*cuts, len(ids)], strict=True):
                    self.kept[p] = data[4 * a + 4 : 4 * b]
        for p in pieces:
            if p not in self.kept:
                self.kept[p] = np.array(self.bpe.encode_ordinary(p.decode()), "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        joined = b"\n".join(texts)
        odd, buf = set(), np.frombuffer(joined, np.uint8)
        if (_RARE_LEAD[buf].any() and _RARE_SPACE.search(joined)) or any(s in joined for s in self.special):
            odd = {i for i, t in enumerate(texts) if _RARE_SPACE.search(t) or any(s in t for s in self.special)}
            rest = [b"" if i in odd else t for i, t in enumerate(texts)]  # what is encoded whole is never cut into pieces
            joined = b"\n".join(rest)
            buf = np.frombuffer(joined, np.uint8)
        else:
            rest = texts
        out = self._pieces(rest, joined, buf) if len(buf) else [b""] * len(texts)
        for i in odd:
            out[i] = np.array(self.whole.encode(texts[i].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _pieces(self, texts: list[bytes], joined: bytes, buf: np.ndarray) -> list[bytes]:
        """The ids of texts, joined by line ends, that hold neither rare white space nor special tokens."""
        sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        n = len(buf)
        space = SPACE[buf]
        cut = np.zeros(n + 1, bool)
        cut[:-2] = (buf[:-1] == 32) & ~space[1:]
        line, after = buf == 10, ~space
        cut[2:-1] |= line[1:-1] & after[:-2] & after[2:]
        cut[1:-1] |= (line[1:] & after[:-1]) | (((buf[1:] == 46) | (buf[1:] == 44)) & _ASCII_LETTER[buf[:-1]])
        cut[begin] = True
        cut[(begin + sizes)] = True
        start = np.flatnonzero(cut)
        start = start[start < n]
        end = np.append(start[1:], n)
        codes, found = pd.factorize(span_hashes(buf, start, end))
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        pieces = [joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if missing := [p for p in pieces if p not in self.kept]:
            self._learn(missing)
            if len(self.kept) < len(pieces):  # emptied meanwhile
                self._learn([p for p in pieces if p not in self.kept])
        ids = [self.kept[p] for p in pieces]
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        where = np.cumsum(size) - size
        each = size[codes]
        ends = np.cumsum(each)
        data = flat[np.repeat(where[codes] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        upto = np.concatenate([[0], ends])
        a, b = upto[np.searchsorted(start, begin)], upto[np.searchsorted(start, begin + sizes)]
        return [data[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


#: The pre-token pattern of byte-level BPE files.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a file: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, close: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece of each document: its ids, then the closing id, cut only where longer than the capacity."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(_PIECE + (", ids binary" if keep_ids else "")).fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.uint32(close).tobytes()
        for part in chunks(batches):
            rows: list[tuple] = []
            for i, ids in enumerate(enc.encode(raw(part.column("text")))):
                ids += end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                at = k = 0
                while at < n:
                    to = first if k == 0 else at + capacity
                    data = ids[4 * at : 4 * to]
                    rows.append((i, k, at, to - at, zlib.crc32(data), *([data] if keep_ids else [])))
                    at, k = to, k + 1
            columns = list(zip(*rows, strict=True))
            names = [f.name for f in schema]
            kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [part.column("doc_id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], kinds[1:], strict=False)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---- the plan, on the histogram ----


def patterns(lengths: list[int], counts: dict[int, int], capacity: int, often: int = 8) -> list[tuple[int, ...]]:
    """Fillings of a sequence by one to four of the lengths; threes and fours take all but two lengths from the most frequent."""
    have, found = set(lengths), set()
    top = sorted(lengths, key=lambda x: -counts[x])[:often]
    if capacity in have:
        found.add((capacity,))
    for a in lengths:
        if capacity - a in have:
            found.add(tuple(sorted((a, capacity - a))))
        for i, b in enumerate(top):
            if capacity - a - b in have:
                found.add(tuple(sorted((a, b, capacity - a - b))))
            for c in top[i:]:
                if capacity - a - b - c in have:
                    found.add(tuple(sorted((a, b, c, capacity - a - b - c))))
    return sorted(found, key=lambda p: (len(p), p))


def fit(found: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 40) -> list[float]:
    """Non-negative least squares of the patterns' repeat counts to the histogram, by coordinate descent."""
    columns = []
    for p in found:
        column: dict[int, int] = defaultdict(int)
        for x in p:
            column[x] += 1
        columns.append((list(column.items()), sum(v * v for v in column.values())))
    rest, x = {k: float(v) for k, v in counts.items()}, [0.0] * len(found)
    for _ in range(sweeps):
        moved = 0.0
        for j, (column, norm) in enumerate(columns):
            step = max(-x[j], sum(v * rest[k] for k, v in column) / norm)
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, v in column:
                    rest[k] -= v * step
        if moved < 0.25:
            break
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks, first sequence, offset) that give each piece its place, and the number of sequences."""
    left, used, rows, sequences = dict(counts), defaultdict(int), [], 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    found = patterns(sorted(counts), counts, capacity)
    for p, x in zip(found, fit(found, counts), strict=True):
        n = min([int(x + 1e-9), *[left[k] // p.count(k) for k in p]])
        if n > 0:
            offset = 0
            for length in p:
                put(length, n, sequences, offset)
                offset += length
            sequences += n
    # the rest: best-fit by falling length; bins with the same room are one group [(first sequence, how many)]
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        while left[length]:
            fits = [r for r, groups in room.items() if r >= length and groups]
            if fits:
                r = min(fits)
                first, n = room[r].pop()
                take = min(n, left[length])
                if take < n:
                    room[r].append((first + take, n - take))
            else:
                r, first, take = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += take
            put(length, take, first, capacity - r)
            room[r - length].append((first, take))
    return rows, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length and any other columns) with sequence_id and offset. pieces should be cheap to read twice."""
    spark = pieces.sparkSession
    names = pieces.columns
    salts = parts(spark)
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    per_salt = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = plan(counts, capacity)
    before = per_salt.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    own = W.partitionBy("length", "_salt").orderBy(*names)
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_salt"]).select(*names, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias("_rank"))
    table = np.array(sorted(placed) or [(0, 0, 0, 0, 0)], np.int64)
    sent = spark.sparkContext.broadcast((table[:, 0] * (1 << 44) + table[:, 1], table))
    schema = T.StructType([*[pieces.schema[n] for n in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = sent.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch.column("length").to_numpy(zero_copy_only=False) * (1 << 44) + rank, "right") - 1
            row = table[at]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(token_pieces(docs, path or default_tokenizer(), capacity)), capacity)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op4_pattern_packing": op4_pattern_packing}
