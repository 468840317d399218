"""SimHash near-dedup with fuzzy keys from the Golay code.

A fingerprint has 64 bits; each is the majority of that bit over the hashes of all word shingles. Fingerprints link
if at most four bits differ. The bits are cut into three segments (22, 21, 21). Four errors in three segments leave
either a segment without an error, or two segments with at most one error each:

* a segment without an error: its value is a key;
* one error: a segment, padded to 23 bits, decodes to the index of its nearest word of the perfect Golay code. Two
  segments one bit apart need not decode alike, but the index of the one is always among the indices of the other and
  of its single-bit neighbours (six at most). So each fingerprint stores the pair of its own indices under one key per
  pair of segments, and looks under all pairs of its neighbours' indices.

The join on the keys runs on distinct fingerprints. Inside a key, stored and looking fingerprints are compared in numpy
blocks, and a task returns only edges to the least member of what it linked: never all pairs of a group. Keys that
very many fingerprints store are dealt over several tasks (the stored side in chunks, the looking side copied to each),
so no link is lost. Components come from rounds of star contraction, each written to the shared folder.

`near_dedup` has settings of its own: sets of five-word shingles with a similarity of 0.8 or more. Such pairs differ in some
ten bits of 64, out of reach of the Golay keys; several fingerprints are cut into many exact segments instead, and a pair
that shares one links only if the Jaccard similarity of its shingle sets, counted in full, is high enough. A set is written
with two partners at most. Sets with more are written with one, and their other pairs never as rows: those that candidates
connect are a cluster, and pairs are verified inside blocks of a cluster, to each of which its sets bring their shingles once;
a block returns only edges that connect what was apart. Larger clusters first meet in parts; then only sets outside the
largest component found so far meet all others.

Fingerprints reach nearly all pairs, not all. The rest is found by prefixes, which leave out none: shingles have one order,
rare ones first, and two sets of that similarity share one of the first `n - ceil(least * n) + 1` shingles of each. Sets of
different components that share one, with sizes and places there that allow the similarity, are verified as pairs; where a
shingle has more than SETS_UPTO sets, in blocks as above. How often a shingle occurs sets the order, and so the cost, alone.

Null and empty texts have fingerprint zero, linked like any other. Texts shorter than a shingle are one shingle.
Repeated rows are ties; of rows with one id and text, `near_dedup` keeps one. A null id counts only where a component
has no other. Extra columns pass through `near_dedup`, whose own columns begin with `_`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, mix, raw, read, stored, windows

SHINGLE = 4
SEED = 42
MOST_BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, bits
#: Stored fingerprints of one key that a task compares with; of keys with more, each task takes a chunk.
STORED_UPTO = 8192
#: Pairs that are compared at once.
BLOCK = 1 << 21
#: Sets of shingles, and bytes of them, of which all pairs are verified in one block.
SETS_UPTO, BYTES_UPTO = 256, 1 << 22
#: Partners of a set that are verified as pairs; sets with more are crowded.
PARTNERS_UPTO = 2
#: Shingles that are counted at once; and from which count on a shingle comes late in prefixes, for as many shingles at most. All three change the cost of prefixes only, not what they find.
COUNTED_AT_ONCE, FREQUENT, FREQUENT_UPTO = 1 << 22, 32, 1 << 16


@dataclass(frozen=True)
class Similar:
    """near_dedup: words of a shingle, least Jaccard similarity, fingerprints of a text, share of the pairs at that similarity
    that the keys should reach (prefixes find the rest), and the bits in which the first two fingerprints of a pair may differ (at 0.8: 19.4 of 128, deviation 4.1)."""

    shingle: int = 5
    least: float = 0.8
    fingerprints: int = 8
    recall: float = 0.99
    most_bits: int = 36


# ---- fingerprints ----


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    from xxhash import xxh64_intdigest

    words = Words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if not len(words.start):
        return out
    # words of each text, a space after each: every run of words is then one slice
    buf = np.append(words.buf, np.uint8(0x20))
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end + 1, -1)
    buf[words.end] = 0x20
    kept = np.cumsum(inside[:-1]) > 0
    data = buf[kept].tobytes()
    size = words.end - words.start
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    n = len(start)
    first = np.concatenate([[0], np.cumsum(words.count)[:-1]])
    whole = np.arange(n) + shingle - 1 < (first + words.count)[words.text]
    short = (words.count > 0) & (words.count < shingle)
    at = np.flatnonzero(whole | (short[words.text] & (np.arange(n) == first[words.text])))
    to = np.minimum(at + shingle, (first + words.count)[words.text[at]]) - 1
    h = np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in zip(start[at].tolist(), end[to].tolist(), strict=True)), np.uint64, len(at))
    owner = words.text[at]
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = np.diff(np.r_[begin, len(owner)])
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    major = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()
    out[owner[begin]] = major
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """docs with `_fp`, in Arrow batches of a few MB and without a shuffle."""
    docs = docs.drop("_fp")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            fp = pa.array(fingerprints(raw(part.column(text)), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], fp], names=[*[f.name for f in kept], "_fp"])

    return docs.mapInArrow(run, schema)


# ---- keys ----


@lru_cache(1)
def golay() -> np.ndarray:
    """The index (0 to 4095) of the nearest codeword of every 23-bit word."""
    generator = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1
    words = np.zeros(4096, np.int64)
    data = np.arange(4096)
    for i in range(12):
        words ^= np.where(data >> i & 1, generator << i, 0)
    table = np.full(1 << 23, -1, np.int16)
    for weight in range(4):
        for places in combinations(range(23), weight):
            table[words ^ sum(1 << p for p in places)] = data
    assert (table >= 0).all()
    return table


def _indices(value: np.ndarray, bits: int) -> np.ndarray:
    """A row of distinct indices of each segment value and of its neighbours; -1 where there are fewer."""
    table = golay()
    near = np.stack([table[value], *[table[value ^ (1 << b)] for b in range(bits)]], axis=1)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, axis=1)
    return near[:, : max(1, int((near >= 0).sum(axis=1).max(initial=1)))].astype(np.int64)


def keys(fp: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) of what fingerprints store, and of where they look. The highest bits of a key tell its kind."""
    v = fp.view(np.uint64)
    parts = [((v >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    rows = np.arange(len(v))
    exact = [part | (k << 24) for k, part in enumerate(parts)]
    own = [golay()[part].astype(np.int64) for part in parts]
    near = [_indices(part, b) for part, (_, b) in zip(parts, SEGMENTS, strict=True)]
    kept, looked, looking = list(exact), list(exact), [rows] * 3
    for k, (a, b) in enumerate(combinations(range(3), 2)):
        kind = (3 + k) << 24
        kept.append(own[a] << 12 | own[b] | kind)
        both = (near[a][:, :, None] << 12 | near[b][:, None, :] | kind).reshape(len(v), -1)
        there = ((near[a] >= 0)[:, :, None] & (near[b] >= 0)[:, None, :]).reshape(len(v), -1)
        at, col = np.nonzero(there)
        looked.append(both[at, col])
        looking.append(at)
    return (np.tile(rows, len(kept)), np.concatenate(kept)), (np.concatenate(looking), np.concatenate(looked))


def _key_rows(classes: DataFrame, looking: bool) -> DataFrame:
    """(key, side, fp): side 0 stores, side 1 looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                store, look = keys(fp)
                for side, (row, key) in ((0, store), (1, look)) if looking else ((0, store),):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), side, np.int8)), pa.array(fp[row])], names=["key", "side", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, side byte, fp long")


# ---- links ----


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) for all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows (key, salt, side, fp) in this order. What a key stores is kept while its looking rows pass by."""
    held_key, held = None, np.zeros(0, np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        a, b = _roots(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False) * 65536 + batch.column("salt").to_numpy(zero_copy_only=False)
        side, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("side", "fp"))
        if len(held):
            key = np.concatenate([np.full(len(held), held_key), key])
            side = np.concatenate([np.zeros(len(held), side.dtype), side])
            fp = np.concatenate([held, fp])
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        n_stored = np.add.reduceat((side == 0).astype(np.int64), begin)
        looking = np.flatnonzero(side == 1)
        each = n_stored[group[looking]]
        looking, each = looking[each > 0], each[each > 0]
        ends = np.cumsum(each)
        at = 0
        while at < len(looking):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
            rows, n = looking[at:to], each[at:to]
            base = np.cumsum(n) - n
            other = np.repeat(begin[group[rows]] - base, n) + np.arange(n.sum())
            x, y = fp[np.repeat(rows, n)], fp[other]
            good = (np.bitwise_count((x ^ y).view(np.uint64)) <= MOST_BITS) & (x != y)
            if good.any():
                pair = (x[good], y[good])
                if len(pair[0]) > BLOCK // 8:
                    pair = _roots(*pair)
                edges.append(pair)
                count += len(pair[0])
            if count > BLOCK:
                yield out()
                edges, count = [], 0
            at = to
        last = begin[-1]
        held_key = key[-1]
        held = fp[last:][side[last:] == 0]
    if edges:
        yield out()


def links(classes: DataFrame, stored_upto: int = STORED_UPTO) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at MOST_BITS or fewer differing bits."""
    hot = _key_rows(classes, False).groupBy("key").count().filter(F.col("count") > stored_upto).select("key", F.ceil(F.col("count") / stored_upto).cast("int").alias("chunks"))
    rows = _key_rows(classes, True).join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    salts = F.when(F.col("chunks") == 1, F.array(F.lit(0))).when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.select("key", F.explode(salts).alias("salt"), "side", "fp")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "side").mapInArrow(link_sorted, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node that is not the least of its component, by alternating star contraction.

    The least neighbours are written before edges meet them: a join of its own, whose hot centres adaptive execution splits,
    where a join in the stage of the aggregate would have to take all edges of a centre in one task.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = stored(small)
        same = [x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first() for x in (now, new)]
        now = new
        if same[0] == same[1]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def component_of(classes: DataFrame) -> DataFrame:
    """classes (fp, first) with `component`: the least `first` of each fingerprint's component."""
    roots = components(links(classes))
    rooted = stored(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component")))
    return rooted.join(least, "root").select("fp", "component")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _fp, component_id) of every row."""
    own = stored(with_fingerprint(docs.select(doc_id, text), text, keep_text=False))
    classes = stored(own.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("first")))
    found = stored(component_of(classes))
    return own.join(found, own["_fp"] == found["fp"]).select(doc_id, "_fp", F.col("component").alias("component_id"))


# ---- copies by shingle similarity ----


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, text by text in order, and how many each text has. A shorter text is one shingle."""
    words = Words(texts, lower=True)
    h, n = words.hashes(), len(texts)
    at, whole = windows(h, words.text, shingle)
    first = np.cumsum(words.count) - words.count
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    rest = words.count[short].astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(shingle - 1):
            there = words.count[short] > j
            rest[there] = mix(rest[there] + h[first[short[there]] + j])
    owner, hashes = np.concatenate([words.text[at], short]), np.concatenate([whole, rest])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])][: len(owner)]
    return hashes[new], np.bincount(owner[new], minlength=n)


def _ones(h: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of hashes; bits are added up in bytes, 255 hashes at a time."""
    blocks = -(-count // 255)
    first = np.cumsum(blocks) - blocks
    start = np.repeat(begin, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    ones = np.empty((len(start), 8, 8), np.int32)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), start)
        ones[:, :, j] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(ones.reshape(-1, 64), first, axis=0)


def _with_sketches(docs: DataFrame, text: str, s: Similar) -> DataFrame:
    """docs with `_set` (a hash of the set of shingles) and `_fps` (fingerprints)."""
    docs = docs.drop("_set", "_fps")
    schema = T.StructType([*docs.schema.fields, T.StructField("_set", T.LongType()), T.StructField("_fps", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, 1 << 20):
            hashes, count = shingle_sets(raw(part.column(text)), s.shingle)
            own, fps = np.zeros(part.num_rows, np.uint64), np.zeros((part.num_rows, s.fingerprints), np.uint64)
            filled = count > 0
            if len(hashes):
                begin = (np.cumsum(count) - count)[filled]
                with np.errstate(over="ignore"):
                    own[filled] = mix(np.add.reduceat(mix(hashes), begin) + count[filled].astype(np.uint64))
                for k in range(s.fingerprints):
                    with np.errstate(over="ignore"):
                        h = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                    ones = _ones(h, begin, count[filled])
                    fps[filled, k] = np.packbits(2 * ones > count[filled][:, None], axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.view(np.int64)), pa.array([x.tobytes() for x in fps.astype("<u8")], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _with_shingles(texts: DataFrame, s: Similar) -> DataFrame:
    """(_set, _shingles) of rows (_set, text): the sorted upper halves of the shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            hashes, count = shingle_sets(raw(part.column("text")), s.shingle)
            low = (hashes >> np.uint64(32)).astype("<u4")  # in order, as the hashes are
            sets = [low[b - n : b].tobytes() for b, n in zip(np.cumsum(count).tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("_set"), pa.array(sets, pa.binary())], names=["_set", "_shingles"])

    return texts.select("_set", "text").mapInArrow(run, "_set long, _shingles binary")


def key_places(n: int, s: Similar) -> np.ndarray:
    """A row of bits per key. Keys widen with the number of sets, so that buckets stay small, and their number keeps the wanted recall."""
    bits = max(16, n.bit_length() - 6)
    differ = float(np.arccos(2 * s.least / (1 + s.least)) / np.pi)
    wanted = int(np.ceil(np.log(1 - s.recall) / np.log(1 - (1 - differ) ** bits)))
    rng, size = np.random.default_rng(SEED), 64 * s.fingerprints
    each = size // bits
    return np.concatenate([rng.permutation(size)[: each * bits].reshape(each, bits) for _ in range(-(-wanted // each))])


def _similar_rows(sketches: DataFrame, places: np.ndarray) -> DataFrame:
    """(key, set, fp, fp2): a row per key of each set; and root, if sketches have one."""
    roots = [c for c in sketches.columns if c == "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bits = places.shape
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = np.frombuffer(b"".join(part.column("_fps").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                flat = np.unpackbits(fps, axis=1, bitorder="little")
                wide = fps.view("<i8")
                own = part.column("_set").to_numpy(zero_copy_only=False)
                rest = [part.column(c) for c in roots]
                for k in range(n):
                    key = (flat[:, places[k]] * weights).sum(axis=1) * n + k
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, own, np.ascontiguousarray(wide[:, 0]), np.ascontiguousarray(wide[:, 1]))] + rest, names=["key", "set", "fp", "fp2", *roots])

    return sketches.select("_set", "_fps", *roots).mapInArrow(run, "key long, set long, fp long, fp2 long" + "".join(f", {c} long" for c in roots))


def similar_sorted(batches: Iterator[pa.RecordBatch], most: int, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, many) from rows (key, salt, side, set, fp, fp2, root) in this order. Side 0 stores, 1 looks, 2 does both.

    Of each looking row a all its partners b, or where they are more than PARTNERS_UPTO its least one, marked; with `whole`, edges (a, b) that connect all its partners of another root.
    """
    names = ("key", "salt", "side", "set", "fp", "fp2", "root")
    held: list[np.ndarray] | None = None
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    out = lambda *x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b", "many"][: len(x)])

    def found(now: list[np.ndarray], last: int) -> Iterator[pa.RecordBatch]:
        """Of the rows whose group is whole: those of side 1, and those of side 2 before the row `last`."""
        key, salt, side, own, fp, fp2, root = now
        edge = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
        begin, group = np.flatnonzero(edge), np.cumsum(edge) - 1
        each = np.add.reduceat((side != 1).astype(np.int64), begin)[group]
        looking = np.flatnonzero((side != 0) & (each > 0) & ((side == 1) | (np.arange(len(key)) < last)))
        each = each[looking]
        ends, at = np.cumsum(each), 0
        while at < len(looking):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + (BLOCK >> 2), "right")))
            rows, n = looking[at:to], each[at:to]
            at = to
            x = np.repeat(rows, n)
            y = np.repeat(begin[group[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            far = np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)).astype(np.int16) + np.bitwise_count((fp2[x] ^ fp2[y]).view(np.uint64))
            good = np.flatnonzero((far <= most) & (root[x] != root[y]))
            if not len(good):
                continue
            x, y = x[good], own[y[good]]
            if whole:
                edges.append(_roots(own[x], y))
                if sum(len(a) for a, _ in edges) > BLOCK >> 3:
                    edges[:] = [_roots(*(np.concatenate(e) for e in zip(*edges, strict=True)))]
                    if len(edges[0][0]) > BLOCK >> 4:
                        yield out(*edges.pop())
                continue
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])  # rows stand together
            count = np.diff(np.r_[first, len(x)])
            many, few = count > PARTNERS_UPTO, np.repeat(count <= PARTNERS_UPTO, count)
            a, b = np.r_[own[x[first[many]]], own[x[few]]], np.r_[np.minimum.reduceat(y, first)[many], y[few]]
            yield out(a, b, np.arange(len(a)) < many.sum())

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        before = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        last = int(before[-1]) + 1 if len(before) else 0  # the last group may go on in the next batch
        yield from found(now, last)
        held = [x[last:][now[2][last:] != 1] for x in now]
    if held is not None and len(held[0]):
        yield from found(held, len(held[0]))
    if edges:
        yield out(*_roots(*(np.concatenate(e) for e in zip(*edges, strict=True))))


def _similar_found(sketches: DataFrame, places: np.ndarray, s: Similar, stored_upto: int, whole: bool) -> DataFrame:
    """What similar_sorted returns for sets that share a key, each pair once: (a, b, many), or with `whole`, for which sketches have `root`, (u, v), u > v."""
    hot = _similar_rows(sketches, places).groupBy("key").count().filter(F.col("count") > stored_upto).select("key", F.ceil(F.col("count") / stored_upto).cast("int").alias("chunks"))
    rows = _similar_rows(sketches, places).join(F.broadcast(hot), "key", "left")
    deal = lambda salt, side: F.struct(salt.cast("int").alias("salt"), F.lit(side).cast("byte").alias("side"))
    store = F.array(deal(F.pmod(F.xxhash64("set"), F.col("chunks")), 0))
    look = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: deal(i, 1))
    dealt = F.explode(F.when(F.col("chunks").isNull(), F.array(deal(F.lit(0), 2))).otherwise(F.concat(store, look)))
    rows = rows.select("key", dealt.alias("d"), "set", "fp", "fp2", *(["root"] if whole else [])).select("key", "d.salt", "d.side", "set", "fp", "fp2", *(["root"] if whole else []))
    most = s.most_bits
    sorted_rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "side")
    found = sorted_rows.withColumn("root", F.col("root" if whole else "set")).mapInArrow(lambda batches: similar_sorted(batches, most, whole), "a long, b long" + ("" if whole else ", many boolean"))
    return _undirected(found) if whole else found.groupBy("a", "b").agg(F.max("many").alias("many"))


def _undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def similar_partners(sketches: DataFrame, places: np.ndarray, s: Similar, stored_upto: int = STORED_UPTO) -> DataFrame:
    """(_set, partners, crowded) of sets with a partner: those that share a key and whose first two fingerprints are near. A crowded set has one, its least of those that a key with many has shown."""
    first = F.row_number().over(W.partitionBy("a").orderBy(F.desc("many"), "b"))  # ranks above the limit are dropped before the shuffle, too
    few = _similar_found(sketches, places, s, stored_upto, False).withColumn("place", first).filter(F.col("place") <= PARTNERS_UPTO + 1)
    of = few.groupBy(F.col("a").alias("_set")).agg(F.collect_list("b").alias("partners"), (F.bool_or("many") | (F.count("*") > PARTNERS_UPTO)).alias("crowded"), F.min_by("b", "place").alias("least"))
    return of.select("_set", F.when(F.col("crowded"), F.array("least")).otherwise(F.col("partners")).alias("partners"), "crowded")


def _pairs_of(partners: DataFrame) -> DataFrame:
    return _undirected(partners.select(F.col("_set").alias("a"), F.explode("partners").alias("b")))


def similar_pairs(sketches: DataFrame, s: Similar, stored_upto: int = STORED_UPTO) -> DataFrame:
    """Distinct pairs (u, v), u > v, of sets with their partners; similarity is not yet verified."""
    return _pairs_of(similar_partners(sketches, key_places(sketches.count(), s), s, stored_upto))


def verified(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    with_x = pairs.join(shingles.select(F.col("_set").alias("u"), F.col("_shingles").alias("_x")), "u")
    return with_x.join(shingles.select(F.col("_set").alias("v"), F.col("_shingles").alias("_y")), "v").select("u", "v", "_x", "_y").mapInArrow(run, "u long, v long")


def block_links(side: np.ndarray, own: np.ndarray, root: np.ndarray, fps: np.ndarray, sets: list[bytes], s: Similar) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what similar pairs of a block connect and roots do not. Side 0 meets side 1, and rows of side 2 each other."""
    size = np.array([len(x) >> 2 for x in sets])
    _, code, times = np.unique(np.frombuffer(b"".join(sets), "<u4"), return_inverse=True, return_counts=True)
    there = times[code] > 1  # a shingle of one set is in no pair
    count = np.bincount(np.repeat(np.arange(len(size)), size)[there], minlength=len(size))
    code, begin = code[there], np.cumsum(count) - count
    label, marked = np.unique(root, return_inverse=True)[1], np.zeros(len(times), bool)
    a, b = [], []
    for x in np.flatnonzero(side != 1).tolist():
        near = (label != label[x]) & (side == 1 if side[x] == 0 else np.arange(len(size)) > x) & (np.minimum(size, size[x]) >= s.least * np.maximum(size, size[x]) - 1e-9)
        y = np.flatnonzero(near)
        y = y[np.bitwise_count(fps[y] ^ fps[x]).sum(axis=1, dtype=np.int64) <= s.most_bits]
        if not len(y):
            continue
        mine, n = code[begin[x] : begin[x] + count[x]], count[y]
        marked[mine] = True
        shared = np.r_[0, np.cumsum(marked[code[np.repeat(begin[y] - (np.cumsum(n) - n), n) + np.arange(n.sum())]])]
        marked[mine] = False
        both = shared[np.cumsum(n)] - shared[np.cumsum(n) - n]
        y = y[both >= s.least * (size[x] + size[y] - both) - 1e-9]
        if len(y):
            met, first = np.unique(label[y], return_index=True)
            a.append(np.full(len(first), own[x]))
            b.append(own[y[first]])
            label[np.isin(label, met)] = label[x]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def blocks_sorted(batches: Iterator[pa.RecordBatch], s: Similar) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of block_links from rows (cluster, i, j, side, _set, root, _fps, _shingles) that are sorted by the first three."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        side, own, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("side", "_set", "root"))
        fps = np.frombuffer(b"".join(rows.column("_fps").to_pylist()), "<u8").reshape(len(own), -1)[:, :2]
        a, b = block_links(side, own, root, fps, rows.column("_shingles").to_pylist(), s)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "i", "j")])
        begin = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("cluster", "i", "j")] != key[:, 0].tolist():
            yield run(pa.concat_batches(held))
            held = []
        for at, to in zip(begin, begin[1:], strict=False):
            yield run(pa.concat_batches([*held, batch.slice(at, to - at)]))
            held = []
        held.append(batch.slice(begin[-1]))
    if held:
        yield run(pa.concat_batches(held))


def _block_edges(rows: DataFrame, s: Similar) -> DataFrame:
    columns = ["cluster", "i", "j", "side", "_set", "root", "_fps", "_shingles"]
    dealt = rows.select(*columns).repartitionByRange("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(lambda batches: blocks_sorted(batches, s), "u long, v long")


def _chunks(sets_upto: int, where: Column) -> Column:
    """How many chunks the rows of a group take for which a condition holds."""
    return F.ceil(F.greatest(F.count_if(where) / sets_upto, F.coalesce(F.sum(F.when(where, F.length("_shingles"))), F.lit(0)) / BYTES_UPTO)).cast("int")


def cluster_links(clustered: DataFrame, roots: DataFrame, s: Similar, sets_upto: int = SETS_UPTO) -> DataFrame:
    """Edges (u, v) that connect all similar pairs inside clusters, from rows (cluster, _set, root, _fps, _shingles).

    Every row first meets those of its chunk, which is all of most clusters. Of larger ones, the rows that are not in the
    cluster's largest component then meet all rows, chunk by chunk; rows inside that component need no look at each other.
    """
    large = stored(clustered.groupBy("cluster").agg(_chunks(sets_upto, F.lit(True)).alias("parts")).filter("parts > 1"))
    chunk = lambda parts: F.pmod(F.xxhash64("_set"), parts).cast("int")
    first = clustered.join(F.broadcast(large), "cluster", "left").withColumn("i", chunk(F.coalesce("parts", F.lit(1)))).withColumns({"j": F.col("i"), "side": F.lit(2)})
    found = stored(_block_edges(first, s))
    if large.isEmpty():
        return found
    now = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found)).withColumnsRenamed({"node": "_set", "root": "now"})
    rows = clustered.join(F.broadcast(large.select("cluster")), "cluster", "left_semi").join(now, "_set", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
    most = rows.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    rows = stored(rows.join(F.broadcast(most), "cluster").withColumn("inner", F.col("root") == F.col("most")))
    sizes = rows.groupBy("cluster").agg(_chunks(sets_upto, ~F.col("inner")).alias("outer_parts"), _chunks(sets_upto, F.col("inner")).alias("inner_parts")).filter("outer_parts > 0")
    outer, inner = F.col("outer_parts"), F.col("inner_parts")
    rows = rows.join(F.broadcast(sizes), "cluster").withColumn("own", F.when(F.col("inner"), outer + chunk(inner)).otherwise(chunk(outer)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inner"), outer).otherwise(outer + inner) - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)})
    return found.unionAll(_block_edges(rows, s))


def similar_components(sketches: DataFrame, texts: DataFrame, s: Similar, sets_upto: int = SETS_UPTO) -> DataFrame:
    """(node, root) of sets that verified pairs connect; texts: (_row, text) of all rows, of which only those with partners are cut into shingles. Of crowded sets, pairs inside a component that others connect already need no look at their shingles."""
    places = key_places(sketches.count(), s)
    partners = stored(similar_partners(sketches, places, s))
    named = stored(sketches.select("_set", "_row").join(partners, "_set", "left_semi"))  # written: where they are few, texts are not shuffled
    shingles = stored(_with_shingles(texts.join(named, "_row"), s))
    roots = components(verified(_pairs_of(partners), shingles, s.least).toDF("a", "b"))
    # a set that is not crowded has brought all its pairs; what is left has two crowded sides: all pairs among these, but for those that are connected already
    crowded = partners.filter("crowded").select("_set")
    full = stored(sketches.join(crowded, "_set", "left_semi").join(roots, F.col("_set") == F.col("node"), "left").select("_set", "_fps", F.coalesce("root", "_set").alias("root")))
    clusters = components(_similar_found(full, places, s, STORED_UPTO, True).toDF("a", "b"))
    inside = clusters.select(F.col("node").alias("_set"), F.col("root").alias("cluster"))
    inside = inside.unionAll(inside.select(F.col("cluster").alias("_set"), "cluster").distinct())
    more = cluster_links(stored(full.join(inside, "_set").join(shingles, "_set")), roots, s, sets_upto)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))


def frequent_shingles(texts: DataFrame, s: Similar) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many rows (text) hold, in order, and the rank of each, from 1 on and higher for commoner ones. A shingle counts where a run of texts holds it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "n"])

        for part in chunks(batches, "text", 1 << 20):
            held.append(shingle_sets(raw(part.column("text")), s.shingle)[0])
            if sum(map(len, held)) > COUNTED_AT_ONCE:
                yield out()
        if held:
            yield out()

    counts = texts.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    found = np.array([r.shingle for r in counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT_UPTO).collect()], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], len(found) - order


def _prefix_rows(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], s: Similar) -> DataFrame:
    """(shingle, set, at) of rows (_set, text): the shingles of each text's prefix; at holds the size of the set in its upper half and the place of the shingle in the lower one."""
    late, ranks = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            hashes, count = shingle_sets(raw(part.column("text")), s.shingle)
            owner = np.repeat(np.arange(len(count)), count)
            if len(late):
                found = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
                rank = np.where(late[found] == hashes, ranks[found], 0)
                hashes = hashes[np.argsort(owner * (len(late) + 1) + rank, kind="stable")]
            place = np.arange(len(hashes)) - (np.cumsum(count) - count)[owner]
            length = count - np.ceil(s.least * count - 1e-9).astype(np.int64) + 1
            taken = place < length[owner]
            own = part.column("_set").to_numpy(zero_copy_only=False)
            columns = (hashes[taken].view(np.int64), own[owner[taken]], count[owner[taken]] << 32 | place[taken])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "set", "at"])

    return texts.select("_set", "text").mapInArrow(run, "shingle long, set long, at long")


def shared_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shingle, set, at) in this order, those whose shingle has several sets, each once."""
    names = ["shingle", "set", "at"]

    def found(now: list[np.ndarray]) -> pa.RecordBatch:
        shingle = now[0]
        begin = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        n = np.diff(np.r_[begin, len(shingle)])
        return pa.RecordBatch.from_arrays([pa.array(x[np.repeat(n > 1, n)]) for x in now], names=names)

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        once = np.r_[True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])]
        now = [x[once] for x in now]
        last = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on in the next batch
        if last:
            yield found([x[:last] for x in now])
        held = [x[last:] for x in now]
    if held is not None:
        yield found(held)


def rest_links(texts: DataFrame, sketches: DataFrame, roots: DataFrame, s: Similar, sets_upto: int = SETS_UPTO) -> DataFrame:
    """Edges (u, v) that connect all similar sets which roots (node, root) do not; texts: (_row, _set, text) of all rows."""
    rows = _prefix_rows(texts, frequent_shingles(texts, s), s).repartition("shingle").sortWithinPartitions("shingle", "set").mapInArrow(shared_sorted, "shingle long, set long, at long")
    rows = stored(stored(rows).join(roots, F.col("set") == F.col("node"), "left").select("shingle", "set", F.coalesce("root", "set").alias("root"), F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND((1 << 32) - 1).alias("place")))
    groups = stored(rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("set").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high"))
    # a shingle of few sets: pairs, if it can be the first that both share, with as many after it as the similarity takes
    few = rows.join(groups.filter(F.col("n") <= sets_upto), "shingle", "left_semi")
    x, y = (few.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("set", "root", "size", "place")]) for k in "xy")
    left = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    fits = (F.col("set_x") > F.col("set_y")) & (F.col("root_x") != F.col("root_y")) & (left * (1 + s.least) >= s.least * (F.col("size_x") + F.col("size_y")) - 1e-6)
    pairs = stored(x.join(y, "shingle").filter(fits).select(F.col("set_x").alias("u"), F.col("set_y").alias("v")).distinct())
    # a shingle of many: all its sets are in one cluster
    many = stored(rows.join(groups.filter(F.col("n") > sets_upto).select("shingle", "least"), "shingle").select("set", "least").distinct())
    own = pairs.select(F.explode(F.array("u", "v")).alias("_set")).unionAll(many.select("set")).distinct()
    named = stored(sketches.select("_set", "_row").join(own, "_set", "left_semi"))  # written: where they are few, texts are not shuffled
    shingles = stored(_with_shingles(texts.select("_row", "text").join(named, "_row"), s))
    found = verified(pairs, shingles, s.least)
    if many.isEmpty():
        return found
    inside = components(many.toDF("a", "b"))
    inside = inside.select(F.col("node").alias("_set"), F.col("root").alias("cluster"))
    inside = inside.unionAll(inside.select(F.col("cluster").alias("_set"), "cluster").distinct())
    full = sketches.select("_set", "_fps").join(inside, "_set").join(roots, F.col("_set") == F.col("node"), "left").select("cluster", "_set", F.coalesce("root", "_set").alias("root"), "_fps")
    every = replace(s, most_bits=128)  # of the two fingerprints that blocks compare
    return found.unionAll(cluster_links(stored(full.join(shingles, "_set")), roots, every, sets_upto))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Similar | None = None) -> DataFrame:
    """docs with one row, that with the least id, of each component of texts whose shingle sets are similar. Which rows go is settled on row numbers, without texts."""
    s = settings or Similar()
    rows = stored(_with_sketches(docs, text, s).withColumn("_row", F.monotonically_increasing_id()), "zstd")
    least = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_row").alias("row")))
    classes = stored(rows.groupBy("_set").agg(least.alias("first")))
    sketches = stored(rows.select("_row", "_set", "_fps").join(classes.select(F.col("first.row").alias("_row")), "_row", "left_semi"))
    texts = rows.select("_row", "_set", F.col(text).alias("text"))
    roots = similar_components(sketches, texts.drop("_set"), s)
    more = stored(rest_links(texts, sketches, roots, s))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    rooted = classes.join(roots, classes["_set"] == roots["node"], "left").select("first", F.coalesce("root", "_set").alias("root"))
    kept = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row")))
    return rows.join(kept, "_row", "left_semi").drop("_row", "_set", "_fps")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


#: DuckDB has no XXH64 with a seed; tests compare with brute force.
QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
