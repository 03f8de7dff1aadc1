"""Scalar building blocks. All are null-safe column expressions that stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value. Fixed values.
MISSING_TOKENS = ("", "NA", "N/A", "NULL", "null", "None", "none", "nan", "NaN")

DAY = 86400.0


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6) / F.lit(DAY)


def normalize_missing(c: Column, strict: bool = False) -> Column:
    """A missing token becomes an empty text. strict: after trimming."""
    seen = F.trim(c) if strict else c
    return F.when(seen.isNull() | seen.isin(*MISSING_TOKENS), F.lit("")).otherwise(c)


def is_missing(c: Column) -> Column:
    return c.isNull() | c.cast("string").isin(*MISSING_TOKENS)


def session_key(pid: Column, index: Column) -> Column:
    """pid, '_s' and the index with four digits, or more where it has more."""
    text = index.cast("string")
    return F.concat(pid, F.lit("_s"), F.lpad(text, F.greatest(F.length(text), F.lit(4)), F.lit("0")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """A null stays null, and a null bound is no bound."""
    low, high = (x if isinstance(x, Column) or x is None else F.lit(float(x)) for x in (low, high))
    out = c
    if high is not None:
        out = F.when(c > high, high).otherwise(out)
    if low is not None:
        out = F.when(c < low, low).otherwise(out)
    return out


def right_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of (edges[i], edges[i + 1]]; null outside. The outer edges may be infinite."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        inside = F.lit(True)
        if lo != float("-inf"):
            inside = inside & (c > F.lit(float(lo)))
        if hi != float("inf"):
            inside = inside & (c <= F.lit(float(hi)))
        out = F.when(c.isNotNull() & inside, label).otherwise(out)
    return out


def quantile_edges(c: Column, bins: int) -> Column:
    """Aggregate: distinct quantiles of linear interpolation, ascending."""
    return F.array_distinct(F.percentile(c, F.array(*[F.lit(k / bins) for k in range(bins + 1)])))


def quantile_bin(c: Column, edges: Column) -> Column:
    """The number of the right-closed bin; the first holds the least value too."""
    upper = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 1, F.lit(0)))
    return F.aggregate(upper, F.lit(1), lambda n, e: n + F.when(c > e, 1).otherwise(0))


def entropy_bits(counts: Sequence[Column], n: Column) -> Column:
    total = F.lit(0.0)
    for c in counts:
        p = c / n
        total = total - F.when(c > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(n > 0, total)


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Restricted cubic spline without a common scale: the linear term and a term for each inner knot but the last; linear beyond the outer knots."""
    cube = lambda k: F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), 3)
    last, before = knots[-1], knots[-2]
    terms = [
        cube(k) - cube(before) * F.lit((last - k) / (last - before)) + cube(last) * F.lit((before - k) / (last - before))
        for k in knots[:-2]
    ]
    return [x.cast("double"), *terms]


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` places, timestamps to microseconds, small integers to long: what is compared across engines."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
