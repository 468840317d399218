"""Time: versions with the moments from which and until which they hold, snapshots, and differences of two moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEY

#: What two states of an element are compared by, besides their existence.
COMPARED = ("lat_e7", "lon_e7", "nds", "members", "tags", "ts")


def moment(at: str) -> Column:
    return F.to_timestamp(F.lit(at))


def versions(changes: DataFrame) -> DataFrame:
    """Changes (elements with version, ts and `deleted`) as versions with valid_to.

    Of equal versions of an element the last in time counts; a version that is no earlier than the next one is dropped.
    """
    last = W.partitionBy(*KEY, "version").orderBy(F.desc("ts"))
    later = W.partitionBy(*KEY).orderBy("version")
    rows = changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    # a higher version overwrites all lower ones that are not before it
    least_after = F.min("ts").over(later.rowsBetween(1, W.unboundedFollowing))
    kept = rows.withColumn("_after", least_after).filter("_after IS NULL OR ts < _after").drop("_after")
    return kept.withColumn("valid_to", F.lead("ts").over(later))


def snapshot(history: DataFrame, at: str | Column) -> DataFrame:
    """The elements as they were: versions that hold at the moment and are no deletions."""
    t = moment(at) if isinstance(at, str) else at
    return history.filter((F.col("ts") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)) & ~F.col("deleted"))


def current(history: DataFrame) -> DataFrame:
    return history.filter(F.col("valid_to").isNull() & ~F.col("deleted"))


def changelog(history: DataFrame, since: str, until: str) -> DataFrame:
    """Distinct (etype, id) with a version that begins or ends in (since, until]."""
    low, high = moment(since), moment(until)
    within = lambda c: (F.col(c) > low) & (F.col(c) <= high)
    return history.filter(within("ts") | within("valid_to")).select(*KEY).distinct()


def _state(df: DataFrame, name: str, compared: tuple[str, ...]) -> DataFrame:
    return df.select(*KEY, F.struct(*compared).alias(name))


def difference(old: DataFrame, new: DataFrame, everything: DataFrame | None = None, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """(etype, id, action, old, new) of elements that differ between two results of one query.

    create: only in the new; modify: in both and different; erase: only in the old. With `everything`, all elements of
    the new moment, an element that still exists but has left the result is push_away, and one that existed before
    without being in the result is still create.
    """
    both = _state(old, "old", compared).join(_state(new, "new", compared), KEY, "full_outer")
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "erase").otherwise("modify")
    found = both.withColumn("action", action).filter("old IS NULL OR new IS NULL OR old <> new")
    if everything is not None:
        there = everything.select(*KEY).distinct().withColumn("_there", F.lit(True))
        found = found.join(there, KEY, "left").withColumn("action", F.when((F.col("action") == "erase") & F.col("_there"), "push_away").otherwise(F.col("action"))).drop("_there")
    return found.select(*KEY, "action", "old", "new")


def compare(old: DataFrame, new: DataFrame, expression: Column) -> DataFrame:
    """(etype, id, old_value, new_value) where an expression differs; the value of a missing side is empty."""
    a, b = (df.select(*KEY, expression.alias(n)) for df, n in ((old, "old_value"), (new, "new_value")))
    filled = a.join(b, KEY, "full_outer").withColumns({c: F.coalesce(c, F.lit("")) for c in ("old_value", "new_value")})
    return filled.filter("old_value <> new_value")
