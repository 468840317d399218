"""Aggregates over a set: text in, text out, all as plain Spark aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import num_text, try_double, try_int


def unique(e: Column) -> Column:
    """The one value that is not empty; empty if there is none; a remark if there are several."""
    v = F.when(e != "", e)
    return F.when(F.min(v).isNull(), "").when(F.min(v) == F.max(v), F.min(v)).otherwise("< multiple values found >")


def value_set(e: Column) -> Column:
    """The distinct values that are not empty, sorted, joined by semicolons."""
    return F.array_join(F.array_sort(F.collect_set(F.when(e != "", e))), ";")


def _typed(e: Column, pick) -> Column:
    i, d = try_int(e), try_double(e)
    all_of = lambda x: F.coalesce(F.every(x.isNotNull()), F.lit(False))
    return F.when(F.count(e) == 0, "").when(all_of(i), pick(i).cast("string")).when(all_of(d), num_text(pick(d))).otherwise(F.coalesce(pick(F.when(e != "", e)), F.lit("")))


def smallest(e: Column) -> Column:
    """By integers if all values are, else by doubles if all are, else by text without empty ones."""
    return _typed(e, F.min)


def largest(e: Column) -> Column:
    return _typed(e, F.max)


def total(e: Column) -> Column:
    """Sum of integers or doubles; NaN if any value is no number; 0 of an empty set."""
    i, d = try_int(e), try_double(e)
    bad = F.coalesce(F.bool_or(d.isNull()), F.lit(False))
    ints = F.coalesce(F.every(i.isNotNull()), F.lit(True))
    return F.when(bad, "NaN").when(ints, F.coalesce(F.sum(i), F.lit(0)).cast("string")).otherwise(num_text(F.sum(d)))


def count(*etypes: str) -> Column:
    """How many elements of the types; `derived` counts what is no node, way or relation."""
    kind = F.col("etype")
    fits = kind.isin([t for t in etypes if t != "derived"])
    if "derived" in etypes:
        fits = fits | ~kind.isin("node", "way", "relation")
    return F.count_if(fits).cast("string")


def gather(parts: Column) -> Column:
    """All parts of all geometries; one row holds them all, so this is for small sets."""
    return F.flatten(F.collect_list(parts))
