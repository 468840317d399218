"""Secret scans over a segmented trigram index.

Each rule's regex is turned into a Boolean trigram query. Every segment (a few MB of documents inside a task) gets an
inverted index from the queried trigrams to postings; a query intersects and unites postings, and the regex verifies
the candidates only. Rules without mandatory trigrams scan the segment. Trigrams are over bytes with A-Z folded, so
the index may only propose too much, never too little.

Null and empty texts have no spans. Repeated rows and tied spans are kept, each for itself. Positions count code
points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import _LOWER, chunks, raw, read


@dataclass(frozen=True)
class Rule:
    """kind, regex (ASCII only) and a check that a match must pass; failing matches are dropped."""

    kind: str
    regex: str
    check: Callable[[re.Match], bool] | None = None


def _long(n: int, group: int = 0) -> Callable[[re.Match], bool]:
    return lambda m: len(m.group(group)) >= n


def _varied(n: int) -> Callable[[re.Match], bool]:
    return lambda m: len(set(m.group(1))) >= n


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long(6, 2)),
    Rule("access", r"AKIA[A-Z0-9]+", _long(20)),
    Rule("hex", r"[0-9a-f]+", _long(24)),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=~-]{20,})", _varied(8)),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/@]{3,64})@"),
    Rule("credential", r"""(?i:pwd|passphrase|client_secret|access_?key|private_?key|auth_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", _varied(5)),
)

#: A Boolean query over trigrams: None is true; a set of alternatives, each a set of trigrams that all must occur.
Query = frozenset | None
MOST_ALTERNATIVES = 256


def _pieces(tokens: list) -> list[list[str]]:
    """Alternatives of literal runs: each alternative is a list of folded strings that must all occur; '' cuts a run."""
    found: list[list[str]] = [[""]]

    def both(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
        out = [a[:-1] + [a[-1] + b[0]] + b[1:] for a in left for b in right]
        return out if len(out) <= MOST_ALTERNATIVES else [a + [""] for a in left]

    for op, value in tokens:
        if op is C.LITERAL:
            part = [[chr(value).lower()]] if value < 128 else [["", ""]]
        elif op is C.SUBPATTERN:
            part = _pieces(list(value[-1]))
        elif op is C.BRANCH:
            part = [x for branch in value[1] for x in _pieces(list(branch))]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _pieces(list(inner))
            if (low, high) == (0, 1):
                part = [[""], *once]
            elif low == 0:
                part = [["", ""]]
            else:
                part = [["", *a, ""] if high != 1 else a for a in once] if high != 1 else once
                if high != 1:  # the first copy joins what stands before it
                    part = [a + [""] for a in once]
        elif op is C.AT:
            part = [[""]]
        else:
            part = [["", ""]]
        found = both(found, part)
    return found


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query that every text with a match satisfies; None if the regex has no mandatory trigram."""
    alternatives = set()
    for runs in _pieces(list(_parser.parse(regex))):
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not grams:
            return None
        alternatives.add(grams)
    least = {a for a in alternatives if not any(b < a for b in alternatives)}
    return frozenset(least)


@lru_cache(1)
def _slots(wanted: tuple[str, ...]) -> np.ndarray:
    """The number of each wanted trigram, by its three bytes; -1 for all others. Kept by a worker for all its segments."""
    slot = np.full(1 << 24, -1, np.int16)
    for i, g in enumerate(wanted):
        slot[int.from_bytes(g.encode(), "big")] = i
    return slot


class Segment:
    """Postings of the queried trigrams over a few texts."""

    def __init__(self, texts: list[bytes], wanted: list[str]):
        self.n = len(texts)
        self.number = {g: i for i, g in enumerate(wanted)}
        slot = _slots(tuple(wanted))
        data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)].astype(np.uint32)
        starts = np.cumsum([0, *[len(x) + 1 for x in texts[:-1]]])
        got = slot[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]] if len(data) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(got >= 0)
        pairs = np.unique(got[at].astype(np.int64) * self.n + np.searchsorted(starts, at, "right") - 1)
        self.postings = pairs % max(self.n, 1)
        self.bounds = np.searchsorted(pairs, np.arange(len(wanted) + 1) * self.n)

    def of(self, gram: str) -> np.ndarray:
        i = self.number[gram]
        return self.postings[self.bounds[i] : self.bounds[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        hits = []
        for grams in query:
            lists = sorted((self.of(g) for g in grams), key=len)
            left = lists[0]
            for other in lists[1:]:
                if not len(left):
                    break
                left = np.intersect1d(left, other, assume_unique=True)
            hits.append(left)
        return np.unique(np.concatenate(hits))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with the array of spans of all rules, by start and then by the order of the rules.

    No shuffle: a task indexes and verifies a few MB of text at a time. An input column named like the output is replaced.
    """
    docs = docs.drop(out)
    queries = [trigram_query(r.regex) for r in rules]
    wanted = sorted({g for q in queries if q for grams in q for g in grams})
    #: hex runs that are too short are most of what the plain pattern would meet: the least length goes into the scan
    scans = [re.compile(r.regex.encode().replace(b"[0-9a-f]+", b"[0-9a-f]{24,}") if r.kind == "hex" else r.regex.encode(), re.ASCII) for r in rules]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            texts = raw(part.column(text))
            segment = Segment(texts, wanted)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query, scan) in enumerate(zip(rules, queries, scans, strict=True)):
                for i in segment.candidates(query).tolist():
                    spans[i] += [(m.start(), k, m.end()) for m in scan.finditer(texts[i]) if rule.check is None or rule.check(m)]
            rows = []
            for data, found in zip(texts, spans, strict=True):
                if found and not data.isascii():  # bytes that do not continue a character, before each place
                    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                    found = [(int(before[a]), k, int(before[b])) for a, k, b in found]
                rows.append([{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _ARROW_SPAN)], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: the counts and the digest of the base kinds, and the spans of all kinds as text."""
    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    base = "('assign', 'access', 'hex')"
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(secrets, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in ("assign", "access", "hex")],
        f"sha2({joined.format(f'filter(secrets, s -> s.kind IN {base})')}, 256) AS base_sha256",
        f"{joined.format('secrets')} AS spans",
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
