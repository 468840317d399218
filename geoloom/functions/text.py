"""Text values as numbers: every value of an expression is text, and operators try integers, then doubles, then text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"^\s*([+-]?)(?:0[xX]([0-9a-fA-F]+)|0([0-7]+)|([0-9]+))\z"
_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def text(x: Column | str | float) -> Column:
    """A column as it is, a Python value as text."""
    return x if isinstance(x, Column) else F.lit(str(x))


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """f of values that are evaluated once each: without this, nested expressions would repeat their parts again and again."""
    one = F.array(F.struct(*[v.alias(f"x{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(one, lambda s: f(*[s[f"x{i}"] for i in range(len(values))])), F.lit(0))


def try_int(s: Column) -> Column:
    """The integer that a whole text spells: decimal, octal after 0, hexadecimal after 0x; blanks may lead. Else null."""
    part = lambda i: F.regexp_extract(s, _INT, i)
    size = F.when(part(2) != "", F.conv(part(2), 16, 10)).when(part(3) != "", F.conv(part(3), 8, 10)).otherwise(part(4))
    decimal = s.rlike(_INT) & ~(s.rlike(r"^\s*[+-]?0[0-9]") & ~s.rlike(r"^\s*[+-]?0[0-7]+$"))
    rest = F.when(decimal, F.concat(F.when(part(1) == "-", "-").otherwise(""), size).try_cast("bigint"))
    return F.when(_plain(s), s.try_cast("bigint")).otherwise(rest)


def _plain(s: Column) -> Column:
    """Whether a text is an integer as it is shown: most are, and need no pattern."""
    return F.coalesce(s.try_cast("bigint").cast("string") == s, F.lit(False))


def try_double(s: Column) -> Column:
    """The double that a whole text spells, `inf`, `nan` and hexadecimal integers included; blanks may lead, nothing may follow. Else null."""
    plain = F.when(s.rlike(_NUMBER + r"\z"), F.trim(s).try_cast("double"))
    low = F.lower(s)
    other = F.when(low.rlike(r"^\s*[+]?inf(?:inity)?\z"), float("inf")).when(low.rlike(r"^\s*-inf(?:inity)?\z"), float("-inf")).when(low.rlike(r"^\s*[+-]?nan\z"), float("nan"))
    return F.when(_plain(s), s.try_cast("bigint").cast("double")).otherwise(F.coalesce(_hexadecimal(s, r"\z"), plain, other, try_int(s).cast("double")))


def _hexadecimal(s: Column, end: str) -> Column:
    """The double of a hexadecimal integer."""
    pattern = rf"^\s*([+-]?)0[xX]([0-9a-fA-F]{{1,15}}){end}"
    digits = F.conv(F.regexp_extract(s, pattern, 2), 16, 10).try_cast("double")
    return F.when(s.rlike(pattern), F.when(F.regexp_extract(s, pattern, 1) == "-", -digits).otherwise(digits))


def prefix_double(s: Column) -> Column:
    """The double that a text begins with; null if it begins with none, or with one that is out of range."""
    found = F.regexp_extract(s, _NUMBER, 0)
    value = F.when(found != "", F.trim(found).try_cast("double"))
    return F.coalesce(_hexadecimal(s, "(?![0-9a-fA-F])"), F.when(F.abs(value) != float("inf"), value))


def suffix(s: Column) -> Column:
    """What follows the number at the beginning, without leading blanks; empty if there is no number."""
    return F.when(s.rlike(_NUMBER), F.regexp_replace(F.regexp_replace(s, _NUMBER, ""), r"^\s+", "")).otherwise("")


def num_text(d: Column) -> Column:
    """A double with 14 significant digits, plain or with an exponent as C's %.14g has it (but for exact ties, which round up)."""

    def point(whole: Column, rest: Column) -> Column:
        return F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))

    def shown(d: Column, digits: Column, e: Column) -> Column:
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        middle = F.when(n <= e + 1, F.rpad(digits, e + 1, F.lit("0"))).otherwise(point(F.substring(digits, F.lit(1), e + 1), F.substring(digits, e + 2, n)))
        exponent = F.concat(point(F.substring(digits, 1, 1), F.substring(digits, F.lit(2), n)), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(e)))
        body = F.when(d == 0, "0").when((e < -4) | (e >= 14), exponent).when(e < 0, small).otherwise(middle)
        return F.concat(F.when(d < 0, "-").otherwise(""), body)

    def cut(d: Column, parts: Column) -> Column:
        digits = F.regexp_replace(F.replace(parts[0], F.lit("."), F.lit("")), "(?<=.)0+$", "")
        finite = bound(shown, d, digits, parts[1].cast("int"))
        return F.when(F.isnan(d), "nan").when(F.abs(d) == float("inf"), F.when(d > 0, "inf").otherwise("-inf")).when(d.isNotNull(), finite)

    return bound(lambda d: bound(cut, d, F.split(F.format_string("%.13e", F.abs(d)), "e")), d)


def truthy(s: Column) -> Column:
    """False for an empty text and for numbers that are zero."""
    return bound(lambda v: (v != "") & (F.coalesce(try_double(v), F.lit(1.0)) != 0), s)


def flag(b: Column) -> Column:
    return F.when(b, "1").otherwise("0")


def _ladder(a: Column, b: Column, ints: Callable, doubles: Callable, texts: Callable) -> Column:
    def typed(a: Column, b: Column) -> Column:
        def choose(a: Column, b: Column, i: Column, j: Column, x: Column, y: Column) -> Column:
            return F.when(i.isNotNull() & j.isNotNull(), ints(i, j)).when(x.isNotNull() & y.isNotNull(), doubles(x, y)).otherwise(texts(a, b))

        return bound(choose, a, b, try_int(a), try_int(b), try_double(a), try_double(b))

    return bound(typed, a, b)


def _compare(test: Callable) -> Callable[..., Column]:
    def run(a: Column | str, b: Column | str) -> Column:
        a, b = text(a), text(b)
        return flag(_ladder(a, b, test, test, test))

    return run


eq = _compare(lambda a, b: a == b)
ne = _compare(lambda a, b: a != b)
lt = _compare(lambda a, b: a < b)
le = _compare(lambda a, b: a <= b)
gt = _compare(lambda a, b: a > b)
ge = _compare(lambda a, b: a >= b)


def both(a: Column, b: Column) -> Column:
    return flag(truthy(text(a)) & truthy(text(b)))


def either(a: Column, b: Column) -> Column:
    return flag(truthy(text(a)) | truthy(text(b)))


def negate(a: Column) -> Column:
    return flag(~truthy(text(a)))


def choose(test: Column, a: Column, b: Column) -> Column:
    return F.when(truthy(text(test)), text(a)).otherwise(text(b))


def _arithmetic(op: Callable, other: Callable) -> Callable[..., Column]:
    def run(a: Column | str, b: Column | str) -> Column:
        a, b = text(a), text(b)
        return _ladder(a, b, lambda i, j: op(i, j).cast("string"), lambda x, y: num_text(op(x, y)), other)

    return run


_nan = lambda a, b: F.lit("NaN")
plus = _arithmetic(lambda a, b: a + b, lambda a, b: F.concat(a, b))
minus = _arithmetic(lambda a, b: a - b, _nan)
times = _arithmetic(lambda a, b: a * b, _nan)


def divide(a: Column | str, b: Column | str) -> Column:
    """Always a double; by zero inf, -inf or nan; NaN where a side is no number."""

    def quotient(x: Column, y: Column) -> Column:
        by_zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return F.when(x.isNull() | y.isNull(), "NaN").otherwise(num_text(F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))))

    return bound(lambda a, b: bound(quotient, try_double(a), try_double(b)), text(a), text(b))


def minus_sign(a: Column | str) -> Column:
    return bound(lambda a: bound(lambda i, x: F.when(i.isNotNull(), (-i).cast("string")).when(x.isNotNull(), num_text(-x)).otherwise("NaN"), try_int(a), try_double(a)), text(a))


def number(s: Column) -> Column:
    shown = lambda i, x: F.coalesce(i.cast("string"), num_text(x), F.lit("NaN"))
    return bound(lambda v: bound(shown, try_int(v), F.coalesce(try_double(v), prefix_double(v))), s)


def is_number(s: Column) -> Column:
    return bound(lambda v: flag(try_double(v).isNotNull() | prefix_double(v).isNotNull()), s)


def absolute(s: Column) -> Column:
    shown = lambda i, x: F.when(i.isNotNull(), F.abs(i).cast("string")).when(x.isNotNull(), num_text(F.abs(x))).otherwise("NaN")
    return bound(lambda v: bound(shown, try_int(v), try_double(v)), s)


def _date_parts(s: Column) -> list[Column]:
    groups = F.regexp_extract_all(s, F.lit("([0-9]+)"), F.lit(1))
    return [F.coalesce(F.get(groups, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(6)]


def _date_ok(p: list[Column]) -> Column:
    return (p[0] >= 1000) & (p[1] <= 12) & (p[2] <= 31) & (p[3] <= 23) & (p[4] <= 59) & (p[5] <= 60)


def date(s: Column) -> Column:
    """A date as a number that keeps its order: year, then fractions of month, day, hour, minute and second; else NaD."""
    p = _date_parts(s)
    value = p[0] + p[1] / F.lit(16.0) + p[2] / F.lit(512.0) + p[3] / F.lit(16384.0) + p[4] / F.lit(1048576.0) + p[5] / F.lit(67108864.0)
    return F.when(_date_ok(p), num_text(value.cast("double"))).otherwise("NaD")


def is_date(s: Column) -> Column:
    return flag(_date_ok(_date_parts(s)))
