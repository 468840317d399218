"""Texts as lists: entries between semicolons, trimmed, sorted and distinct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import flag, num_text, try_double, try_int


def _trim(x: Column) -> Column:
    """Without blanks at both ends; a blank entry is one blank."""
    return F.when(x.rlike(r"^\s*$"), " ").otherwise(F.regexp_replace(x, r"^\s+|\s+$", ""))


def entries(s: Column) -> Column:
    """Sorted and distinct; an empty text has none."""
    return F.when(s == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.array_sort(F.array_distinct(F.transform(F.split(s, ";"), _trim))))


def joined(a: Column) -> Column:
    return F.array_join(a, ";")


def contains(value: Column, s: Column) -> Column:
    return flag(F.array_contains(entries(s), _trim(value)))


def intersection(a: Column, b: Column) -> Column:
    return joined(F.array_sort(F.array_intersect(entries(a), entries(b))))


def union(a: Column, b: Column) -> Column:
    return joined(F.array_sort(F.array_union(entries(a), entries(b))))


def _extreme(s: Column, pick) -> Column:
    """By integers if all are, else by doubles if all are, else by text; an empty list is empty."""
    e = F.filter(entries(s), lambda x: x != " ")
    ints, doubles = F.transform(e, try_int), F.transform(e, try_double)
    best = F.when(F.forall(ints, lambda x: x.isNotNull()), pick(ints).cast("string")).when(F.forall(doubles, lambda x: x.isNotNull()), num_text(pick(doubles))).otherwise(pick(e))
    return F.when(F.size(e) == 0, "").otherwise(best)


def largest(s: Column) -> Column:
    return _extreme(s, F.array_max)


def smallest(s: Column) -> Column:
    return _extreme(s, F.array_min)
