"""Distributions, correlations, extremes and concentration of features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.columns import clip, ratio
from sessionlake.functions.quantiles import ACCURACY, around, between, exact_quantiles, values_at
from sessionlake.session import ship, written

QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
#: A value is frequent where it has more than the 512th part of a ranking's rows.
HEAVY = 512
SUMMARY = "feature string, non_null long, missing_pct double, zero_pct double, negative_count long, mean double, std double, min double, " + ", ".join(f"{k} double" for k in QUANTILES) + ", max double, top_share_of_sum double, unique_values long"


def numeric_summary(df: DataFrame, columns: Sequence[str], top: float = 0.01) -> DataFrame:
    """A row for each column: counts, moments, exact quantiles, and the share of the sum that its largest `top` of all rows hold.

    One pass over the rows counts each column's distinct values; this table is written, and everything else is read from it: counts and
    sums, the values at the wanted places (`values_at`), and what lies above the value that the top begins at. What comes to the
    driver is some numbers a column.
    """
    columns = list(columns)
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    counted = written(df.select(F.inline(cells)).groupBy("feature", "value").agg(F.count("*").alias("n")))
    v, n = F.col("value"), F.col("n")
    number = lambda where: F.coalesce(F.sum(F.when(where, n)), F.lit(0).cast("long"))
    known = F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0).cast("long"))
    stats = counted.groupBy("feature").agg(
        F.sum("n").alias("rows"), known.alias("non_null"), number(v.isNull()).alias("missing"), number(v == 0).alias("zero"), number(v < 0).alias("negative"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum(v * n).alias("total"), F.count("value").alias("unique_values"),
    )
    stats = {r.feature: r for r in stats.collect()}
    if not stats:  # no rows at all
        return df.sparkSession.createDataFrame([(c, 0, None, None, 0, *[None] * (len(QUANTILES) + 5), 0) for c in columns], SUMMARY)
    limit = {i: max(1, math.ceil(r.rows * top)) for i, r in stats.items()}
    ends = {i: [around(p, r.non_null) for p in QUANTILES.values()] for i, r in stats.items() if r.non_null}
    begin = {i: max(0, stats[i].non_null - limit[i]) for i in ends}
    at = values_at(counted.filter("value is not null"), ["feature"], {(i,): [*(k for lo, hi, _ in of for k in (lo, hi)), begin[i]] for i, of in ends.items()})
    marks = [(i, stats[i].total / stats[i].non_null, at[i,][begin[i]]) for i in ends]
    marks = df.sparkSession.createDataFrame(marks, "feature int, mean double, begins double")
    above = v > F.col("begins")
    more = counted.filter("value is not null").join(F.broadcast(marks), "feature").groupBy("feature").agg(  # a row for each column
        F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("squares"), number(above).alias("above"), F.sum(F.when(above, v * n)).alias("above_sum")
    )
    more = {r.feature: r for r in more.collect()} if ends else {}
    rows = []
    for i, c in enumerate(columns):
        r, m = stats[i], more.get(i)
        quantiles = [between(at[i,][lo], at[i,][hi], part) for lo, hi, part in ends[i]] if m else [None] * len(QUANTILES)
        mean, share = (r.total / r.non_null if m else None), None
        std = math.sqrt(m.squares / (r.non_null - 1)) if m and r.non_null > 1 else None
        if m and r.total > 0:
            rest = min(limit[i], r.non_null) - m.above
            share = ((m.above_sum or 0.0) + rest * at[i,][begin[i]]) / r.total
        rows.append((c, r.non_null, r.missing * 100.0 / r.rows, r.zero * 100.0 / r.rows, r.negative, mean, std, r.min, *quantiles, r.max, share, r.unique_values))
    return df.sparkSession.createDataFrame(rows, SUMMARY)


def category_share(df: DataFrame, column: str, blank: str = "(missing)") -> DataFrame:
    value = F.when(F.coalesce(column, F.lit("")) == "", blank).otherwise(F.col(column)).alias(column)
    counts = df.groupBy(value).agg(F.count("*").alias("sessions"))
    return counts.withColumn("pct", F.col("sessions") * 100.0 / F.sum("sessions").over(Window.partitionBy()))  # a row for each category


def sessions_per_player(df: DataFrame) -> DataFrame:
    return df.groupBy("pid").agg(F.count("*").alias("sessions"))


def player_influence(df: DataFrame, shares: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """One row: players, and the share of sessions that the most active of them have.

    Counts of players by number of sessions, not players, are ranked: few rows at any scale.
    """
    by_count = sessions_per_player(df).groupBy("sessions").agg(F.count("*").alias("players"))
    totals = sessions_per_player(df).agg(
        F.count("*").alias("players"),
        F.sum("sessions").alias("sessions"),
        F.max("sessions").alias("max_sessions_per_player"),
        F.percentile("sessions", F.lit(0.95)).alias("p95_sessions_per_player"),
    )
    w = Window.orderBy(F.col("sessions").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_count.withColumn("before", F.coalesce(F.sum("players").over(w), F.lit(0)))
    joined = ranked.crossJoin(F.broadcast(totals.select(F.col("players").alias("all_players"))))  # one row
    take = lambda s: F.greatest(F.lit(0), F.least(F.col("players"), F.greatest(F.lit(1), F.ceil(F.col("all_players") * s)) - F.col("before")))
    tops = joined.agg(*[F.sum(take(s) * F.col("sessions")).alias(f"top{k}") for k, s in enumerate(shares)])
    out = totals.crossJoin(tops)  # one row each
    return out.select(*totals.columns, *[(F.col(f"top{k}") / F.col("sessions")).alias(f"top_{s * 100:g}pct_players_session_share") for k, s in enumerate(shares)])


def top_players(df: DataFrame, n: int = 50) -> DataFrame:
    return sessions_per_player(df).orderBy(F.col("sessions").desc(), "pid").limit(n)


def extreme_rows(df: DataFrame, metrics: dict[str, bool], keep: Sequence[str], n: int = 25) -> DataFrame:
    """The n most extreme rows by each metric, nulls last, ties by session; a top-n for each, without a sort of the table. metrics: column to ascending."""
    parts = []
    for metric, ascending in metrics.items():
        order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
        top = df.orderBy(order, "session_id").limit(n)
        parts.append(top.select(F.lit(metric).alias("metric"), *keep, F.col(metric).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spearman_pairs(df: DataFrame, columns: Sequence[str], id_col: str = "session_id", buckets: int = 256) -> DataFrame:
    """Rank correlation of each pair over the rows that have both, ties at their mean rank, by size of the correlation.

    id_col tells rows apart; a table where it doesn't is refused, by the pairs' numbers of rows. A column is ranked among all its rows, and, from the same table of its values,
    among those that have another column which has nulls. Its distinct values are dealt to ranges by approximate quantiles, so a rank is what earlier ranges hold and
    a running count within one; any ranges give the same ranks. A row's ranks come together by id, and each task adds up the products of all pairs.
    Ranks are a written table of distinct values. Those of frequent values (at most HEAVY a ranking) are broadcast, so no value that a
    column is full of, such as zero, is a join key of very many rows; rows of the other values are joined by key.
    The columns are persisted between the passes; what comes to the driver is a row for each pair and some numbers a column.
    """
    kept = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).persist()
    try:
        sums, common = _spearman(kept, list(columns), id_col, buckets)
        rows = sums.collect()
    finally:
        kept.unpersist()
    if any(r.rows != common[frozenset((r.feature_a, r.feature_b))] for r in rows):
        raise ValueError(f"{id_col} is null or repeated in some rows")
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, rows long, spearman double, abs_spearman double")


def with_ranks(long: DataFrame, ranks: DataFrame, least: dict[int, float]) -> DataFrame:
    """long (key, value and others) with the rank of each row's value. ranks: key, value, n, rank; least: of each key, the count above which a value is frequent.

    Each key has at most its rows by `least` such values. Their rows meet a broadcast table, the rest a join by key.
    """
    bounds = ranks.sparkSession.createDataFrame([(i, float(n)) for i, n in least.items()], "key int, least double")
    parted = ranks.join(F.broadcast(bounds), "key").withColumn("frequent", F.col("n") > F.col("least"))  # a row for each key
    frequent = parted.filter("frequent").select("key", "value", F.col("rank").alias("frequent_rank"))
    rest = parted.filter("not frequent").select("key", "value", "rank")
    known = long.join(F.broadcast(frequent), ["key", "value"], "left")  # fewer than HEAVY rows for each ranking
    there = known.filter("frequent_rank is not null").withColumnRenamed("frequent_rank", "rank")
    return there.unionByName(known.filter("frequent_rank is null").drop("frequent_rank").join(rest, ["key", "value"]))


def _spearman(df: DataFrame, columns: Sequence[str], id_col: str, buckets: int) -> tuple[DataFrame, dict[frozenset, int]]:
    """The pairs' rows, and how many rows of df have both of a pair."""
    x = {c: F.col(c) for c in columns}
    pairs = list(combinations(columns, 2))
    both = {frozenset(p): F.count_if(x[p[0]].isNotNull() & x[p[1]].isNotNull()) for p in pairs}
    shares = [k / buckets for k in range(1, buckets)]
    stats = df.agg(F.count("*").alias("rows"), *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)], *[n.alias(f"both{i}") for i, n in enumerate(both.values())], *[F.percentile_approx(x[c], shares, ACCURACY).alias(f"edges{i}") for i, c in enumerate(columns)]).first()
    count = {c: stats[f"n{i}"] for i, c in enumerate(columns)}
    common = {p: stats[f"both{i}"] for i, p in enumerate(both)}
    edges = {c: sorted(set(stats[f"edges{i}"] or [])) for i, c in enumerate(columns)}

    def ranking(c: str, other: str) -> tuple[str, str | None]:
        return c, None if common[frozenset((c, other))] == count[c] else other

    # Rows are counted by value once for each column; how many of them have another column that has nulls is counted beside, and ranks are made for each such part.
    parts = [None, *[c for c in columns if count[c] < stats["rows"]]]
    long = df.select(id_col, F.inline(F.array(*[F.struct(F.lit(i).alias("key"), x[c].alias("value")) for i, c in enumerate(columns)])), *[x[c].isNotNull().alias(f"has{j}") for j, c in enumerate(parts) if c]).filter("value is not null")
    numbers = [f"n{j}" for j in range(len(parts))]
    ranges = df.sparkSession.createDataFrame([(i, edges[c]) for i, c in enumerate(columns)], "key int, edges array<double>")
    cells = long.groupBy("key", "value").agg(F.count("*").alias("n0"), *[F.count_if(f"has{j}").alias(f"n{j}") for j, c in enumerate(parts) if c]).join(F.broadcast(ranges), "key")  # a row for each column
    cells = cells.select("key", "value", *numbers, F.size(F.filter("edges", lambda e: e < F.col("value"))).alias("range"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy("key", "range").agg(*[F.sum(n).alias(n) for n in numbers]).select("key", "range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in numbers])
    in_order = Window.partitionBy("key", "range").orderBy("value")
    ranks = cells.select("key", "range", "value", *numbers, *[(F.sum(n).over(in_order) - (F.col(n) - 1) / 2).alias(f"rank_{n}") for n in numbers]).join(F.broadcast(before), ["key", "range"])  # at most `buckets` rows for each column
    ranks = written(ranks.select("key", "value", F.col("n0").alias("n"), F.array(*[F.col(f"before_{n}") + F.col(f"rank_{n}") for n in numbers]).alias("rank")))
    ranked = with_ranks(long.select(id_col, "key", "value"), ranks, {i: count[c] / HEAVY for i, c in enumerate(columns)})
    keys = {k: i for i, k in enumerate(sorted({ranking(*p) for a, b in pairs for p in ((a, b), (b, a))}, key=str))}
    # A ranking's mean is known, so ranks are centred before they are multiplied.
    mean = {k: ((count[k[0]] if k[1] is None else common[frozenset(k)]) + 1) / 2 for k in keys}
    wide = ranked.groupBy(id_col).agg(*[F.max(F.when(F.col("key") == columns.index(c), F.col("rank")[parts.index(other)])).alias(f"rank{i}") for (c, other), i in keys.items()])
    wide = wide.select(*[(F.col(f"rank{i}") - F.lit(mean[k])).alias(f"rank{i}") for k, i in keys.items()])
    at = [(keys[ranking(a, b)], keys[ranking(b, a)]) for a, b in pairs]
    names = df.sparkSession.createDataFrame([(p, a, b) for p, (a, b) in enumerate(pairs)], "pair int, feature_a string, feature_b string")
    ship(df.sparkSession)
    sums = wide.mapInArrow(partial(_products, at=at), "pair int, rows long, sxx double, syy double, sxy double")
    sums = sums.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("rows", "sxx", "syy", "sxy")]).filter("rows > 0").join(F.broadcast(names), "pair")  # a row for each pair
    rho = ratio(F.col("sxy"), F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy")))
    return sums.select("feature_a", "feature_b", "rows", rho.alias("spearman"), F.abs(rho).alias("abs_spearman")), common


def _products(batches: Iterator[pa.RecordBatch], at: Sequence[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """For each pair of columns of centred ranks the number of rows that have both, and their sums of squares and of products."""
    i, j = np.array(at).T
    total = np.zeros((4, len(at)))
    for b in batches:
        ranks = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
        has = (~np.isnan(ranks)).astype(float)
        ranks = np.nan_to_num(ranks)
        squares = (ranks * ranks) @ has.T
        total += (has @ has.T)[i, j], squares[i, j], squares[j, i], (ranks @ ranks.T)[i, j]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array(total[0].astype(np.int64)), *[pa.array(v) for v in total[1:]]], names=["pair", "rows", "sxx", "syy", "sxy"])


def scatter_sample(df: DataFrame, id_col: str, x: str, y: str, n: int | None = 20_000, seed: int = 42, clip_at: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """Points for a chart: the n rows with the least hashes, or all rows without n, clipped to quantiles of all rows."""
    limits = exact_quantiles(df, {x: clip_at, y: clip_at})
    rows = df.select(id_col, x, y)
    return (rows if n is None else hash_sample(rows, id_col, n, seed)).select(id_col, *[clip(F.col(c), *limits[c]).alias(c) for c in (x, y)])


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same ids and seed: those with the least hashes, by a distributed top-n."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def key_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on one alone, and repeated ones. What positions would silently mix up shows here.

    Keys are counted on each side before they meet, so no key joins many rows.
    """
    side = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = side(left, "l").join(side(right, "r"), key, "full")
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"),
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"),
    ).withColumn("aligned", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("repeated") == 0))
