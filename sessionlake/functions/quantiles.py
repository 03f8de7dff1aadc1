"""Exact quantiles in bounded memory, of whole columns and within groups.

The built-in exact percentile gathers a group's distinct values in one task. For whole columns, approximate percentiles bracket
each order statistic, one pass counts what lies below the bracket, and only the values inside it come together; a bracket that
still holds too many is bracketed again, which divides it by thousands each time. All columns share the passes.

Within groups (`quantiles_by`), a lazy plan counts distinct values, cuts each group's values into ranges at approximate
percentiles, and sorts only the ranges that hold a wanted place.

`values_at` reads places from a table of distinct values and their counts, which other figures of the same columns can share.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MAX_VALUES = 100_000
RANGES = 256


def order_statistics(df: DataFrame, wanted: dict[str, Iterable[int]], max_values: int = MAX_VALUES) -> dict[str, dict[int, float]]:
    """Of each column the values at the wanted places of its ascending non-null values, from 0. Places beyond them are left out."""
    wanted = {c: sorted(set(at)) for c, at in wanted.items()}
    max_values = max(max_values, 32)  # a bracket has some values at any size
    if not wanted:
        return {}
    x = {c: F.col(c).cast("double") for c in wanted}
    counts = df.agg(*[F.count(x[c]).alias(c) for c in wanted]).first()
    n = {c: counts[c] for c in wanted}
    wanted = {c: [k for k in at if 0 <= k < n[c]] for c, at in wanted.items()}
    asked = {c: at for c, at in wanted.items() if at}
    if not asked:
        return {c: {} for c in wanted}

    def shares(c: str) -> list[float]:
        slack = 2 * n[c] / ACCURACY + 1
        return [min(1.0, max(0.0, (k + side * slack) / n[c])) for k in asked[c] for side in (-1, 1)]

    near = df.agg(*[F.percentile_approx(x[c], [float(p) for p in shares(c)], ACCURACY).alias(f"q{i}") for i, c in enumerate(asked)], *[F.min(x[c]).alias(f"lo{i}") for i, c in enumerate(asked)], *[F.max(x[c]).alias(f"hi{i}") for i, c in enumerate(asked)]).first()
    keys = [(c, k, near[f"q{i}"][2 * j], near[f"q{i}"][2 * j + 1], near[f"lo{i}"], near[f"hi{i}"]) for i, c in enumerate(asked) for j, k in enumerate(asked[c])]
    sides = df.agg(*[f for i, (c, _, lo, hi, *_r) in enumerate(keys) for f in (F.count_if(x[c] < lo).alias(f"b{i}"), F.count_if(x[c] <= hi).alias(f"u{i}"))]).first()
    out: dict[str, dict[int, float]] = {c: {} for c in wanted}
    open_: list[tuple[str, int, float, float, int]] = []
    for i, (c, k, lo, hi, least, most) in enumerate(keys):
        below = sides[f"b{i}"]
        if not below <= k < sides[f"u{i}"]:  # the approximation missed: take the whole column
            lo, hi, below = least, most, 0
        if lo == hi:
            out[c][k] = lo
        else:
            open_.append((c, k, lo, hi, below))
    if open_:
        brackets = sorted({(c, lo, hi) for c, _, lo, hi, _ in open_})
        inside = F.array(*[F.when((x[c] >= lo) & (x[c] <= hi), F.struct(F.lit(i).alias("i"), x[c].alias("v"))) for i, (c, lo, hi) in enumerate(brackets)])
        counted = df.select(F.inline(F.filter(inside, lambda s: s.isNotNull()))).groupBy("i", "v").agg(F.count("*").alias("n"))
        got = counted.limit(max_values + 1).collect()
        if len(got) <= max_values:
            for c, k, lo, hi, below in open_:
                i = brackets.index((c, lo, hi))
                for v, m in sorted((r.v, r.n) for r in got if r.i == i):
                    below += m
                    if k < below:
                        out[c][k] = v
                        break
        else:
            for c, k, lo, hi, below in open_:
                part = df.select(F.col(c)).filter((x[c] >= lo) & (x[c] <= hi))
                out[c][k] = order_statistics(part, {c: [k - below]}, max_values)[c][k - below]
    return out


def exact_quantiles(df: DataFrame, probabilities: dict[str, Sequence[float]], max_values: int = MAX_VALUES, persist: bool = True) -> dict[str, list[float | None]]:
    """Of each column its quantiles by linear interpolation over non-null values; None where there are none.

    The columns are persisted between the passes, on disk where memory is short, unless the caller has done so.
    """
    if persist and probabilities:
        kept = df.select(*probabilities).persist()
        try:
            return exact_quantiles(kept, probabilities, max_values, False)
        finally:
            kept.unpersist()
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in probabilities]).first() if probabilities else None
    places = {c: [p * (counts[c] - 1) for p in ps] for c, ps in probabilities.items()}
    found = order_statistics(df, {c: [f(at) for at in ats for f in (math.floor, math.ceil)] for c, ats in places.items()}, max_values)

    def at(c: str, place: float) -> float | None:
        lo, hi = found[c].get(math.floor(place)), found[c].get(math.ceil(place))
        return None if lo is None or hi is None else lo + (hi - lo) * (place - math.floor(place))

    return {c: [at(c, place) for place in ats] for c, ats in places.items()}


def _beside(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by key in which nulls are equal; the right side's other columns are added."""
    right = right.withColumnsRenamed({c: f"right {c}" for c in key})
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`right {c}`")) for c in key])
    return left.join(right, same, how).drop(*[f"right {c}" for c in key])


def quantiles_by(df: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[str, float]], ranges: int = RANGES) -> DataFrame:
    """groups, and for each name the quantile of its (column, probability) within the group, by linear interpolation over non-null values.

    A lazy plan; null groups are groups. A column without values in a group is null there; a group without any values has no row,
    and without groups there is one row always. A task sorts the distinct values of a range, some 1/256 of those of a group's column.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    key = [*groups, "q column"]
    values = [F.struct(F.lit(i).alias("q column"), F.col(c).cast("double").alias("q value")) for i, c in enumerate(columns)]
    rows = df.select(*groups, F.inline(F.array(*values))).filter(F.col("q value").isNotNull())
    counted = rows.groupBy(*key, "q value").agg(F.count("*").alias("q rows"))
    edges = counted.groupBy(*key).agg(F.percentile_approx("q value", [k / ranges for k in range(1, ranges)], 4 * ranges).alias("q edges"))
    placed = _beside(counted, edges, key).withColumn("q range", F.size(F.filter("q edges", lambda e: e < F.col("q value")))).drop("q edges")

    whole = Window.partitionBy(*key)  # at most a row for each range
    sums = placed.groupBy(*key, "q range").agg(F.sum("q rows").alias("q inside"))
    sums = sums.withColumns({"q total": F.sum("q inside").over(whole), "q before": F.sum("q inside").over(whole.orderBy("q range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q inside")})
    shares = F.array(*[F.array(*[F.lit(float(p)) for p in sorted({p for of, p in wanted.values() if of == c})]) for c in columns])[F.col("q column")]
    around = F.flatten(F.transform(shares, lambda p: F.array(F.floor(p * (F.col("q total") - 1)), F.ceil(p * (F.col("q total") - 1)))))
    here = F.filter(F.array_distinct(around), lambda k: (k >= F.col("q before")) & (k < F.col("q before") + F.col("q inside")))
    needed = sums.withColumn("q places", here).filter(F.size("q places") > 0).drop("q inside")

    in_order = Window.partitionBy(*key, "q range").orderBy("q value").rowsBetween(Window.unboundedPreceding, 0)
    upto = _beside(placed, needed, [*key, "q range"]).withColumn("q upto", F.col("q before") + F.sum("q rows").over(in_order))
    hit = F.filter("q places", lambda k: (k >= F.col("q upto") - F.col("q rows")) & (k < F.col("q upto")))
    found = upto.select(*key, "q value", "q total", F.explode(hit).alias("q place"))

    out = []
    for name, (c, p) in wanted.items():
        mine, at = F.col("q column") == columns.index(c), F.lit(float(p)) * (F.col("q total") - 1)
        value = lambda k: F.max(F.when(mine & (F.col("q place") == k), F.col("q value")))  # noqa: B023, E731
        lo, hi = value(F.floor(at)), value(F.ceil(at))
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.max(F.when(mine, at - F.floor(at)))).alias(name))
    return found.groupBy(*groups).agg(*out)


def around(p: float, n: int) -> tuple[int, int, float]:
    """The places that the quantile p of n values lies between, and how far it is from the first to the second."""
    at = p * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def between(low: float, high: float, part: float) -> float:
    return low if low == high else low + (high - low) * part


def values_at(counted: DataFrame, key: Sequence[str], places: dict[tuple, Iterable[int]], ranges: int = RANGES) -> dict[tuple, dict[int, float]]:
    """For each key the values at places of its ascending values, from 0. counted: key, value (double, not null), n: each distinct value once, with its count.

    The table is read twice. A task sorts the distinct values of the ranges that hold a place, each some 1/256 of a key's. What comes to the
    driver is a row for each place; keys and places are few.
    """
    out: dict[tuple, dict[int, float]] = {k: {} for k in places}
    wanted = [(*k, int(at)) for k, ats in places.items() for at in sorted(set(ats))]
    if not wanted:
        return out
    kinds = ", ".join(f"`{c}` {t}" for c, t in counted.select(*key).dtypes)
    asked = counted.sparkSession.createDataFrame(wanted, f"{kinds}, place long")
    edges = counted.groupBy(*key).agg(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 4 * ranges).alias("edges"))
    placed = counted.join(F.broadcast(edges), list(key)).select(*key, "value", "n", F.size(F.filter("edges", lambda e: e < F.col("value"))).alias("range"))  # a row for each key
    earlier = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range
    sums = placed.groupBy(*key, "range").agg(F.sum("n").alias("inside")).withColumn("before", F.coalesce(F.sum("inside").over(earlier), F.lit(0)))
    needed = sums.join(F.broadcast(asked), list(key)).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("inside")))
    needed = needed.groupBy(*key, "range", "before").agg(F.collect_list("place").alias("places"))
    upto = Window.partitionBy(*key, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hit = placed.join(F.broadcast(needed), [*key, "range"]).withColumn("upto", F.col("before") + F.sum("n").over(upto))  # at most a row for each place
    hit = hit.select(*key, "value", F.explode(F.filter("places", lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))).alias("place"))
    for r in hit.collect():
        out[tuple(r[c] for c in key)][r.place] = r.value
    return out


def with_quantiles(summary: DataFrame, df: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A summary with a row for each group of df, and its quantiles beside it."""
    q = quantiles_by(df, groups, wanted)
    return _beside(summary, q, groups, "left") if groups else summary.crossJoin(q)  # one row each
