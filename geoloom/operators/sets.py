"""Set algebra and control flow over sets of elements: everything is lazy, and only fixpoints and branches run jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..model import KEY, both
from ..shared import stored


def union(*sets: DataFrame) -> DataFrame:
    """Each element once."""
    return both(*sets).dropDuplicates(KEY)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), KEY, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), KEY, "left_semi")


def grouped(df: DataFrame, key: Column, container: bool = False) -> DataFrame:
    """df with `val`, the group of each element; a list puts an element into several groups. Loops over groups become groupBy("val")."""
    return df.withColumn("val", F.explode(key) if container else key)


def for_each(df: DataFrame, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A loop over single elements whose body works on rows: one job on `loop`, the key of the round, instead of a driver's loop."""
    return body(df.withColumn("loop", F.struct(*KEY)))


def complete(start: DataFrame, body: Callable[[DataFrame], DataFrame], most: int = 4096) -> DataFrame:
    """Adds what the body finds until nothing new appears or so many rounds have passed."""
    if not 1 <= most <= 1_048_576:
        raise ValueError("rounds must be from 1 to 1048576")
    seen = frontier = stored(start.dropDuplicates(KEY), "complete")
    for _ in range(most):
        new = stored(difference(body(frontier).dropDuplicates(KEY), seen), "complete")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def when(test: DataFrame, expression: Column, yes: Callable[[], DataFrame], no: Callable[[], DataFrame]) -> DataFrame:
    """A branch on the driver: expression is an aggregate over the set `test`."""
    return yes() if test.agg(truthy(expression).alias("t")).first().t else no()


def with_property(df: DataFrame, name: str, other: DataFrame, aggregate: Column) -> DataFrame:
    """df with a value over another set as a column: a scalar subquery of one aggregate."""
    return df.withColumn(name, other.agg(aggregate.alias("v")).scalar())
