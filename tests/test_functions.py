"""Text as numbers, lists and geometry, against plain Python."""

import math

import pytest
from geoloom.functions import geometry as g
from geoloom.functions import lists, text
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def values(spark, rows, *columns):
    """The columns over rows of texts a and b."""
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()]


def test_numbers(spark):
    a = F.col("a")
    rows = [("010", ""), ("0x1f", ""), (" 5", ""), ("5 m", ""), ("1e3", ""), ("NaN", ""), ("", ""), ("-7", ""), ("08", ""), ("3.50m", ""), ("x", ""), ("+3", ""), (".5", "")]
    got = values(spark, rows, text.try_int(a), text.try_double(a), text.number(a), text.is_number(a), text.suffix(a))
    assert [r[0] for r in got] == [8, 31, 5, None, None, None, None, -7, None, None, None, 3, None]
    assert [r[2] for r in got] == ["8", "31", "5", "5", "1000", "nan", "NaN", "-7", "8", "3.5", "NaN", "3", "0.5"]
    assert [r[3] for r in got] == ["1", "1", "1", "1", "1", "1", "0", "1", "1", "1", "0", "1", "1"]
    assert [r[4] for r in got][3] == "m" and got[9][4] == "m" and got[10][4] == ""


def test_ladder(spark):
    a, b = F.col("a"), F.col("b")
    rows = [("1", "2"), ("1.5", "2"), ("x", "2"), ("10", "9"), ("010", "8"), ("", "0"), ("a", "b")]
    got = values(spark, rows, text.plus(a, b), text.minus(a, b), text.times(a, b), text.divide(a, b), text.lt(a, b), text.eq(a, b))
    assert got == [
        ("3", "-1", "2", "0.5", "1", "0"), ("3.5", "-0.5", "3", "0.75", "1", "0"), ("x2", "NaN", "NaN", "NaN", "0", "0"), ("19", "1", "90", "1.1111111111111", "0", "0"),
        ("16", "0", "64", "1.25", "0", "1"), ("0", "NaN", "NaN", "NaN", "1", "0"), ("ab", "NaN", "NaN", "NaN", "1", "0"),
    ]


def test_truth_and_dates(spark):
    a, b = F.col("a"), F.col("b")
    got = values(spark, [("", "2013-07-01"), ("0", "999"), ("0.0", "2013-13-01"), ("no", "2001-01-01T00:00:11Z"), ("0x0", "2013-01-01T24:00:00Z")], text.flag(text.truthy(a)), text.date(b), text.is_date(b))
    assert [r[0] for r in got] == ["0", "0", "0", "1", "0"]
    assert [r[2] for r in got] == ["1", "0", "0", "1", "0"]
    assert float(got[0][1]) == pytest.approx(2013 + 7 / 16 + 1 / 512) and got[1][1] == "NaD"


def test_num_text_like_c(spark):
    xs = [0.0, 1.0, -2.5, 1 / 3, 1e13, 1e14, 123456789012344.0, 1e-4, 1e-5, 1.5e300, -1e-300, 0.1 + 0.2, 99999999999999.9]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(text.num_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [format(x, ".14g") for x in xs]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=20, max_size=60))
def test_num_text_random(xs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(text.num_text(F.col("x")).alias("t")).collect()
    for x, r in zip(xs, rows, strict=True):
        assert math.isclose(float(r.t), x, rel_tol=1e-13, abs_tol=1e-300) and len(r.t.lstrip("-").split("e")[0].replace(".", "").lstrip("0")) <= 14


def test_lists(spark):
    a, b = F.col("a"), F.col("b")
    got = values(spark, [("b; a;b", "a"), ("", ""), ("10;9", "9"), ("x;9", "1.5;2")], lists.contains(b, a), lists.intersection(a, b), lists.union(a, b), lists.largest(a), lists.smallest(b))
    assert got == [("1", "a", "a;b", "b", "a"), ("0", "", "", "", ""), ("1", "9", "10;9", "10", "9"), ("0", "", "1.5;2;9;x", "x", "1.5")]


def test_geometry(spark):
    p = lambda lat, lon: F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    square = F.array(p(0, 0), p(0, 2), p(2, 2), p(2, 0), p(0, 0))
    row = spark.range(1).select(
        g.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("quarter"), g.length(square).alias("around"), g.in_ring(F.lit(1.0), F.lit(1.0), g.pairs(square)).alias("inside"),
        g.in_ring(F.lit(3.0), F.lit(1.0), g.pairs(square)).alias("outside"), g.in_ring(F.lit(0.0), F.lit(1.0), g.pairs(square)).alias("border"), g.in_ring(F.lit(0.0), F.lit(1.0), g.pairs(square), False).alias("strict"),
        g.center(g.bounds(square)).alias("center"), g.hull(F.array(p(0, 0), p(1, 1), p(0, 2), p(2, 2), p(2, 0), p(1, 0.5))).alias("hull"), F.size(g.trace(F.array(square, square))).alias("sides"),
        g.angle(p(0, 0), p(0, 1), p(1, 1)).alias("left"), g.angle(p(0, 0), p(0, 1), p(0, 1)).alias("none"), F.size(F.get(g.polygon(g.line(g.point(F.lit(0), F.lit(0)), g.point(F.lit(1), F.lit(0)), g.point(F.lit(1), F.lit(1)))), F.lit(0))).alias("ring"),
    ).first()
    assert row.quarter == pytest.approx(1e7) and row.around == pytest.approx(8 * 1e7 / 90, rel=1e-3)
    assert row.inside and not row.outside and row.border and not row.strict
    assert tuple(row.center) == (1.0, 1.0) and row.sides == 4 and row.ring == 4
    assert {tuple(x) for x in row.hull} == {(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)} and row.hull[0] == row.hull[-1]
    assert abs(row.left) == pytest.approx(90, abs=0.1) and row.none is None


def test_numbers_reach_the_end_of_a_text(spark):
    """Blanks may lead, nothing may follow; hexadecimal prefixes count, and a prefix out of range is none."""
    a = F.col("a")
    rows = [("inf ",), ("nan ",), ("5\n",), (" 5",), ("0x1f m",), ("1e400",), ("1e400 m",), ("-0x10",), (" inf",)]
    got = values(spark, [(x, "") for (x,) in rows], text.try_double(a), text.try_int(a), text.number(a))
    assert [r[0] for r in got] == [None, None, None, 5.0, None, float("inf"), None, -16.0, float("inf")]
    assert [r[1] for r in got] == [None, None, None, 5, None, None, None, -16, None]
    assert got[4][2] == "31" and got[6][2] == "NaN"


def test_blank_entries(spark):
    """A blank entry is an entry of its own."""
    a, b = F.col("a"), F.col("b")
    got = values(spark, [("x; ", "y"), ("x;;y", " ;x"), ("", "a")], lists.union(a, b), lists.intersection(a, b), lists.contains(F.lit(""), a))
    assert [tuple(r) for r in got] == [(" ;x;y", "", "1"), (" ;x;y", " ;x", "1"), ("a", "", "0")]
