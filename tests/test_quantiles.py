from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.functions.quantiles import around, between, exact_quantiles, order_statistics, quantiles_by, values_at, with_quantiles


@pytest.mark.parametrize("max_values", [100_000, 32])
def test_quantiles_are_numpys(spark, max_values):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=5000), rng.integers(0, 5, 5000).astype(float)
    df = spark.createDataFrame([(float(x), float(y) if k % 3 else None, None) for k, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, c double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = exact_quantiles(df, {"a": ps, "b": ps, "c": [0.5]}, max_values)
    assert got["a"] == pytest.approx(np.quantile(a, ps))
    assert got["b"] == pytest.approx(np.quantile(b[np.arange(5000) % 3 > 0], ps))
    assert got["c"] == [None]


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(k % 7),) for k in range(70)], "v double")
    got = order_statistics(df, {"v": [0, 9, 10, 69, 70]})
    assert got == {"v": {0: 0.0, 9: 0.0, 10: 1.0, 69: 6.0}}
    assert order_statistics(df.limit(0), {"v": [0]}) == {"v": {}}
    assert order_statistics(df, {}) == {}


@pytest.mark.parametrize("ranges", [256, 3])
def test_quantiles_within_groups(spark, ranges):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(k % 5) if g else None) for g, n in (("a", 3000), (None, 41), ("one", 1)) for k, x in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    wanted = {f"x{p}": ("x", p) for p in (0.0, 0.1, 0.5, 0.95, 1.0)} | {"y50": ("y", 0.5)}
    got = {r.g: r for r in quantiles_by(df, ["g"], wanted, ranges).collect()}
    assert set(got) == {"a", None, "one"}
    for g, r in got.items():
        for name, (c, p) in wanted.items():
            values = [x if c == "x" else y for h, x, y in rows if h == g and (c == "x" or y is not None)]
            assert r[name] == (pytest.approx(np.quantile(values, p)) if values else None), (g, name)
    whole = quantiles_by(df, [], wanted, ranges).collect()
    assert len(whole) == 1 and whole[0]["x0.95"] == pytest.approx(np.quantile([x for _, x, _ in rows], 0.95))
    summary = with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], {"m": ("y", 0.5)})
    assert {r.g: (r.n, r.m) for r in summary.collect()} == {"a": (3000, 2.0), None: (41, None), "one": (1, 0.0)}
    assert quantiles_by(df.limit(0), ["g"], wanted).count() == 0
    assert quantiles_by(df.limit(0), [], wanted).first()["y50"] is None


def test_no_task_sorts_a_whole_group(spark):
    """Values are sorted within a range of a group's values, and no built-in percentile gathers them."""
    df = spark.range(1000).selectExpr("id % 2 AS g", "id * 1.0 AS x")
    plan = quantiles_by(df, ["g"], {"m": ("x", 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "q range" in plan and " percentile(" not in plan


@pytest.mark.parametrize("ranges", [256, 3])
def test_values_at_places(spark, ranges):
    """Places of values of several keys, from counts; a place beyond the last is left out."""
    rng = np.random.default_rng(2)
    rows = {("a", 1): rng.integers(0, 40, 900).astype(float), ("a", 2): rng.normal(size=500), ("b", 1): np.zeros(7)}
    df = spark.createDataFrame([(*k, float(x)) for k, v in rows.items() for x in v], "g string, h int, value double")
    counted = df.groupBy("g", "h", "value").agg(F.count("*").alias("n"))
    places = {k: [0, 3, len(v) // 2, len(v) - 1, len(v)] for k, v in rows.items()}
    got = values_at(counted, ["g", "h"], places, ranges)
    assert got == {k: {p: float(np.sort(v)[p]) for p in places[k] if p < len(v)} for k, v in rows.items()}
    assert values_at(counted, ["g", "h"], {}) == {}
    assert values_at(counted.limit(0), ["g", "h"], {("a", 1): [0]}) == {("a", 1): {}}
    for p in (0.0, 0.3, 0.5, 1.0):
        lo, hi, part = around(p, 500)
        x = np.sort(rows["a", 2])
        assert between(x[lo], x[hi], part) == pytest.approx(np.quantile(x, p))
