"""URL filters: a broadcast trie over reversed host labels and then path segments; the longest matching entry wins.

A null url, or one without `://`, has an empty host and path and matches no entry. Repeated rows are judged each for
itself; of two entries with the same host and path the block wins. An input column named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, stored

#: More entries than this are not broadcast as a trie but joined (`judge_by_join`).
MOST_BROADCAST = 200_000


class Entry(NamedTuple):
    host: str
    path: str
    verdict: str


ENTRIES = (Entry("net", "/", "block"), Entry("example.net", "/en/", "allow"), Entry("example.com", "/de/", "block"), Entry("org", "/fr/", "allow"))


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path, by JVM expressions."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + F.lit(3), F.length(u))).otherwise(F.lit(""))
    cut = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    return df.withColumns({
        "host": F.translate(F.coalesce(cut, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2), F.lit("")),
    })


def build_trie(entries: tuple[Entry, ...]) -> dict:
    """Nodes are dicts: labels from the top level down lead to a path trie under "/", whose edges are path segments.

    The last segment of an entry may be open: it fits every segment that begins with it.
    """
    root: dict = {}
    for host, path, verdict in entries:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault((label,), {})
        node = node.setdefault("/", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault((segment,), {})
        ends = node.setdefault("ends", {})
        if ends.get(last, ("", ""))[1] != "block":
            ends[last] = (f"{host}{path}", verdict)
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The entry with the most host labels, and among those with the longest path, that fits."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get((label,))
        if node is None:
            break
        inner = node.get("/")
        for segment in segments:
            if inner is None:
                break
            open_ends = [e for e in inner.get("ends", ()) if segment.startswith(e)]
            if open_ends:
                best = inner["ends"][max(open_ends, key=len)]
            inner = inner.get((segment,))
    return best


def judge_urls(df: DataFrame, entries: tuple[Entry, ...] = ENTRIES, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict. Few entries: a broadcast trie, no shuffle; more: a join."""
    df = host_and_path(df.drop("host", "path", "rule", "verdict"), url)
    if len(entries) > MOST_BROADCAST:
        return judge_by_join(df, df.sparkSession.createDataFrame(entries, "host string, path string, verdict string"), otherwise)
    sent = df.sparkSession.sparkContext.broadcast(build_trie(entries))
    schema = T.StructType([*df.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for batch in batches:
            got = [match(trie, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule, verdict = pa.array([g and g[0] for g in got], pa.string()), pa.array([g[1] if g else otherwise for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return df.mapInArrow(run, schema)


def judge_by_join(df: DataFrame, entries: DataFrame, otherwise: str = "allow") -> DataFrame:
    """The same for any number of entries: every host suffix is looked up by a shuffle join, then the path prefix decides.

    df has host and path; it is written once with row numbers, which tell repeated rows apart and stay the same on retries.
    """
    names = df.columns
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id())).withColumn("_labels", F.split("host", r"\."))
    suffix = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))
    rules = entries.select(F.lower("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"), F.concat("host", "path").alias("_rule"))
    # the suffixes of one host meet few rules each, so the salted join sends popular suffixes to several tasks by AQE
    found = rows.select("_row", "path", F.explode(suffix).alias("_host")).join(rules, "_host").filter(F.col("path").startswith(F.col("_path")))
    best = found.groupBy("_row").agg(F.max(F.struct(F.size(F.split("_host", r"\.")), F.length("_path"), F.col("_verdict") == "block", "_rule", "_verdict")).alias("_best"))
    return rows.join(best, "_row", "left").select(*names, F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(otherwise)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

QUERIES = {"op2_url_filter": op2_url_filter}
SQL = {"op2_url_filter": _SQL}
