"""Structured Streaming over change files: every micro-batch is merged into the table of versions.

The table is a folder of Parquet generations under the shared root; the last one that was written whole counts, so a
run that dies leaves the one before. A repeated batch changes nothing, as versions are merged by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, KEY
from ..operators.history import versions
from ..sources.osm import read_changes


def merge(history: DataFrame | None, changes: DataFrame) -> DataFrame:
    """History with changes: late versions find their place by number, older times than their predecessor's are dropped."""
    own = [*COLUMNS, "deleted"]
    rows = changes.select(*own) if history is None else history.select(*own).unionByName(changes.select(*own))
    return versions(rows)


class Versions:
    """A table of versions under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _generation(self) -> int | None:
        """The last generation that was written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.root}/generations")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        whole = [int(x.getPath().getName()) for x in fs.listStatus(at) if fs.exists(path(x.getPath(), "_SUCCESS"))]
        return max(whole, default=None)

    def read(self) -> DataFrame | None:
        n = self._generation()
        return None if n is None else self.spark.read.parquet(f"{self.root}/generations/{n}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        if (self._generation() or 0) <= batch:  # else this batch was merged before
            merge(self.read(), changes).write.mode("overwrite").parquet(f"{self.root}/generations/{batch + 1}")


def stream_changes(spark: SparkSession, folder: str, table: Versions, checkpoint: str):
    """A query that merges new change files of a folder as they come; each batch is the files that arrived."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.osc").load(folder).select("path")

    def take(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]  # names of the batch's files
        if paths:
            table.apply(read_changes(spark, paths), number)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and type with a watermark, batch or streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def distinct_changes(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Changed keys once, in a stream: state is dropped behind the watermark."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(KEY)
