"""A corpus pipeline in five stages, each a thin call of an operator; every stage is written as Parquet and read again.

Quality rules drop documents and failing lines, SimHash keeps one document of each near-duplicate component, benchmark
decontamination drops documents that hold a benchmark item, personal data is replaced by its kind in brackets, and what
is left is packed into sequences. All but the last stage return the columns of `documents`; where a stage changes the
text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontamination, packing, pii, quality, simhash
from geoloom.llm.common import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame, text: str = "text") -> DataFrame:
    named = docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long"))
    return named.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(quality.clean(docs).filter("quality_kept"), "quality_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(pii.redact(pii.find_pii(docs)), "redacted")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]
#: Fuzzy keys, token windows and byte-pair ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
