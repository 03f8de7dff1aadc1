"""Ordered work within keys of any size: windows by key, or a segmented scan for keys that hold too many rows for one task.

A hot key's rows are cut into ranges of time. Each range is a window of its own, and what earlier or later ranges hold
is carried into it: sums so far, the last known value, the next one, and the few rows at its edges. The carried table has a row for
each range of each hot key, whose number is bounded, so it is broadcast. Other keys have one range, and nothing is carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.session import written

#: The range of a row within its key, kept between scans so that they share an exchange; `without_ranges` drops it.
RANGE = "range of key"
TASK_ROWS, MOST_HOT = 5_000_000, 4096


@dataclass(frozen=True)
class Scan:
    """One value that a scan gives, from a column's rows in order: see the functions below."""

    kind: str
    value: Column
    n: int = 1


def before(value: Column) -> Scan:
    """The sum over all rows before."""
    return Scan("before", value)


def last(value: Column) -> Scan:
    """The last non-null value up to the row, itself included."""
    return Scan("last", value)


def coming(value: Column) -> Scan:
    """The next non-null value after the row."""
    return Scan("coming", value)


def lag(value: Column, n: int = 1) -> Scan:
    return Scan("lag", value, n)


def lead(value: Column, n: int = 1) -> Scan:
    return Scan("lead", value, n)


def total(value: Column) -> Scan:
    """The sum over all rows of the key."""
    return Scan("total", value)


def least(value: Column) -> Scan:
    """The least value of the key."""
    return Scan("least", value)


def hot_keys(rows: DataFrame, key: str, time: str, task_rows: int = TASK_ROWS, most: int = MOST_HOT) -> DataFrame | None:
    """key and cuts, a range's first times, of keys with more rows than a task should read; None where there are none.

    That is `task_rows`, or the `most`-th part of all rows where that is more, so at most so many keys come to the driver. A
    table of fewer rows is only counted. Rows of one time stay together.
    """
    n = rows.count()
    limit = max(task_rows, -(-n // most))
    if n <= limit:
        return None
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    found = {r[key]: r.n for r in sizes.collect() if r[key] is not None}
    if not found:
        return None
    parts = -(-max(found.values()) // limit)
    schema = f"`{key}` {dict(rows.dtypes)[key]}"
    some = rows.select(key, time).join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in found], schema)), key)
    cuts = some.groupBy(key).agg(F.array_distinct(F.percentile_approx(time, [k / parts for k in range(1, parts)], 10_000)).alias("cuts"))
    return rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def with_ranges(df: DataFrame, key: str, time: str, hot: DataFrame) -> DataFrame:
    if RANGE in df.columns:
        return df
    cuts = hot.withColumnRenamed("cuts", "cuts of key")
    place = F.when(F.col("cuts of key").isNull(), 0).otherwise(F.size(F.filter("cuts of key", lambda c: c <= F.col(time))))
    return df.join(F.broadcast(cuts), key, "left").select(*[F.col(f"`{c}`") for c in df.columns], place.alias(RANGE))  # a row for each hot key


def without_ranges(df: DataFrame) -> DataFrame:
    return df.drop(RANGE)


def _local(s: Scan, keys: Sequence[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    ahead = w.orderBy(*order)
    if s.kind == "before":
        return F.coalesce(F.sum(s.value).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    if s.kind == "last":
        return F.last(s.value, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    if s.kind == "coming":  # backwards, so that the frame grows with the rows
        return F.last(s.value, ignorenulls=True).over(w.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1))
    if s.kind == "lag":
        return F.lag(s.value, s.n).over(ahead)
    if s.kind == "lead":
        return F.lead(s.value, s.n).over(ahead)
    return (F.sum if s.kind == "total" else F.min)(s.value).over(w)


def scan(df: DataFrame, key: str, time: str, order: Sequence[str], values: dict[str, Scan], hot: DataFrame | None = None) -> DataFrame:
    """df with the values, each over the key's rows in ascending order. `time` never falls along the order, and cuts hot keys.

    hot: as `hot_keys` gives it, for times of the same clock; without it these are plain windows by key.
    """
    if hot is None:
        return df.withColumns({name: _local(s, [key], order) for name, s in values.items()})
    df = with_ranges(df, key, time, hot)
    keys, names = [key, RANGE], list(values)
    put = F.struct(*[F.col(c) for c in order])
    edge = {"lag": max((s.n for s in values.values() if s.kind == "lag"), default=0), "lead": max((s.n for s in values.values() if s.kind == "lead"), default=0)}
    rank = {side: F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if side == "lag" else F.col(c) for c in order])) for side in edge}

    # What each range of a hot key holds.
    sums = df.join(F.broadcast(hot.select(key)), key, "left_semi").withColumns({f"edge {side}": rank[side] for side, n in edge.items() if n})
    held = []
    for k, s in enumerate(values.values()):
        if s.kind in ("before", "total"):
            held.append(F.sum(s.value).alias(f"c{k}"))
        elif s.kind == "least":
            held.append(F.min(s.value).alias(f"c{k}"))
        elif s.kind in ("last", "coming"):
            pick = F.max_by if s.kind == "last" else F.min_by
            held.append(pick(s.value, F.when(s.value.isNotNull(), put)).alias(f"c{k}"))
        else:
            near = F.collect_list(F.when(F.col(f"edge {s.kind}") <= s.n, F.struct(put.alias("put"), s.value.alias("v"))))
            held.append(F.transform(F.sort_array(near), lambda x: F.struct(x.v.alias("v"))).alias(f"c{k}"))
    ranges = sums.groupBy(*keys).agg(*held)

    # What comes into each range from the others of its key. There are some ranges for each hot key.
    whole = Window.partitionBy(key)
    up, down = whole.orderBy(RANGE), whole.orderBy(F.col(RANGE).desc())
    past = (Window.unboundedPreceding, -1)
    carried = []
    for k, s in enumerate(values.values()):
        c = F.col(f"c{k}")
        if s.kind == "before":
            c = F.sum(c).over(up.rowsBetween(*past))
        elif s.kind in ("total", "least"):
            c = (F.sum if s.kind == "total" else F.min)(c).over(whole)
        elif s.kind in ("last", "coming"):
            c = F.last(c, ignorenulls=True).over((up if s.kind == "last" else down).rowsBetween(*past))
        elif s.kind == "lag":
            c = F.flatten(F.collect_list(c).over(up.rowsBetween(-s.n, -1)))
        else:
            c = F.flatten(F.collect_list(c).over(up.rowsBetween(1, s.n)))
        carried.append(c.alias(f"c{k}"))
    carried = ranges.select(*keys, *carried)

    at = {side: F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c) if side == "lag" else F.col(c).desc() for c in order])) for side in edge}
    places = {f"edge {side}": at[side] for side, n in edge.items() if n}
    own = {f"own {name}": _local(s, keys, order) for name, s in values.items()}
    rest = [c for c in df.columns if c not in names]
    out = df.withColumns(places | own).join(F.broadcast(carried), keys, "left")
    made = []
    for k, (name, s) in enumerate(values.items()):
        mine, c = F.col(f"own {name}"), F.col(f"c{k}")
        if s.kind == "before":
            v = mine + F.coalesce(c, F.lit(0))
        elif s.kind in ("last", "coming"):
            v = F.coalesce(mine, c)
        elif s.kind in ("total", "least"):
            v = F.coalesce(c, mine)
        else:
            place = F.col(f"edge {s.kind}")
            far = F.try_element_at(c, place - (s.n + 1) if s.kind == "lag" else F.lit(s.n + 1) - place)
            v = F.when(place > s.n, mine).otherwise(far.v)
        made.append(v.alias(name))
    return out.select(*[F.col(f"`{c}`") for c in rest], *made)


#: Whether a row is a copy that `with_edges` gave a range from the ranges before it.
COPY = "copy of key"


def with_edges(df: DataFrame, key: str, time: str, order: Sequence[str], back: int, hot: DataFrame | None) -> DataFrame:
    """df for windows by `range_keys` that look at most `back` rows back: each range of a hot key also has copies of the `back` rows before it.

    `without_edges` drops the copies when the windows are done; what a window gave them is not the key's. Without hot keys df is as it is. Copies
    are made of `back` rows a range, so their number is bounded as the ranges' is.
    """
    if hot is None:
        return df
    df = with_ranges(df, key, time, hot)
    rows = df.join(F.broadcast(hot.select(key)), key, "left_semi")
    sizes = rows.groupBy(key, RANGE).agg(F.count("*").alias("rows of range"))
    by_range = Window.partitionBy(key).orderBy(RANGE)  # a row for each range
    sizes = sizes.withColumns({"number": F.row_number().over(by_range), "rows before": F.sum("rows of range").over(by_range) - F.col("rows of range")})
    from_end = F.row_number().over(Window.partitionBy(key, RANGE).orderBy(*[F.col(c).desc() for c in order]))
    ends = rows.withColumn("from end", from_end).filter(F.col("from end") <= back).join(F.broadcast(sizes), [key, RANGE])
    place = F.col("rows before") + F.col("rows of range") - F.col("from end")
    # Each range has a row at least, so none beyond the next `back` ranges looks at this one.
    ends = ends.withColumns({"place": place, "number": F.explode(F.sequence(F.col("number") + 1, F.col("number") + back))})
    into = sizes.select(key, "number", F.col(RANGE).alias("into"), F.col("rows before").alias("into before"))
    copies = ends.join(F.broadcast(into), [key, "number"]).filter(F.col("into before") - F.col("place") <= back)
    copies = copies.select(*[F.col(f"`{c}`") for c in df.columns if c != RANGE], F.col("into").alias(RANGE), F.lit(True).alias(COPY))
    return df.withColumn(COPY, F.lit(False)).unionByName(copies)


def without_edges(df: DataFrame) -> DataFrame:
    return without_ranges(df.filter(~F.col(COPY)).drop(COPY)) if COPY in df.columns else df


def range_keys(df: DataFrame, key: str) -> list[str]:
    """What windows over df are by: the key, and the range where df has ranges."""
    return [key, RANGE] if RANGE in df.columns else [key]


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of its group, whatever the groups' sizes: a written table, sorted as a whole.

    A row's number in the whole order is that in its task and the rows of the tasks before, a row for each task; its group's first number is
    taken off. Equal rows may have their places either way.
    """
    rows = written(df.orderBy(*groups, *order).withColumn("row id", F.monotonically_increasing_id()))
    task = F.shiftright("row id", 33)
    tasks = rows.groupBy(task.alias("task")).agg(F.count("*").alias("rows"))
    before_task = tasks.select("task", (F.sum("rows").over(Window.orderBy("task")) - F.col("rows")).alias("before task"))  # a row for each task
    rows = rows.withColumn("task", task).join(F.broadcast(before_task), "task").withColumn("at", F.col("before task") + F.col("row id").bitwiseAND(F.lit((1 << 33) - 1)))
    first = rows.groupBy(*groups).agg(F.min("at").alias("first at"))
    return rows.join(first, list(groups)).select(*df.columns, (F.col("at") - F.col("first at")).alias(name))
