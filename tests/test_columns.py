"""Column functions against pandas and hand-made cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sessionlake.functions import columns as c


def values(spark, data, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*exprs).collect()]


def test_right_closed_is_pandas_cut(spark):
    edges, labels = [0, 5, 10, 20], ["a", "b", "c"]
    x = [0.0, 4.0, 5.0, 6.0, 10.0, 11.0, 20.0, 21.0, None]
    got = [r[0] for r in values(spark, [(v,) for v in x], "x double", c.right_closed(F.col("x"), edges, labels))]
    want = [None if pd.isna(v) else v for v in pd.cut(pd.Series(x), edges, labels=labels).astype(object)]
    assert got == want


def test_quantile_bins_are_pandas_qcut(spark):
    rng = np.random.default_rng(5)
    for data, q in (([0.0] * 7 + [1.0, 2.0, 3.0], 6), (rng.normal(size=50).tolist(), 8), (rng.integers(0, 4, 40).astype(float).tolist(), 8)):
        df = spark.createDataFrame([(v,) for v in data], "x double")
        edges = df.agg(c.quantile_edges(F.col("x"), q)).first()[0]
        lit = F.array(*map(F.lit, edges))
        got = [r[0] for r in df.select(c.quantile_bin(F.col("x"), lit)).collect()]
        want = (pd.qcut(pd.Series(data), q, duplicates="drop").cat.codes + 1).tolist()
        assert got == want
    assert len(spark.createDataFrame([(v,) for v in [0.0] * 7 + [1.0, 2.0, 3.0]], "x double").agg(c.quantile_edges(F.col("x"), 6)).first()[0]) == 3


def test_ratio_clip_and_keys(spark):
    assert values(spark, [(3, 0), (3, 2), (None, 2)], "a int, b int", c.ratio(F.col("a"), F.col("b"))) == [(None,), (1.5,), (None,)]
    assert values(spark, [(-1.0,), (0.5,), (2.0,), (None,)], "x double", c.clip(F.col("x"), 0, 1)) == [(0.0,), (0.5,), (1.0,), (None,)]
    assert values(spark, [("p", 7), ("p", 12345)], "p string, i int", c.session_key(F.col("p"), F.col("i"))) == [("p_s0007",), ("p_s12345",)]


def test_missing_tokens(spark):
    got = values(spark, [("NA",), (" NA",), ("x",), (None,), ("",)], "x string", c.normalize_missing(F.col("x")), c.normalize_missing(F.col("x"), strict=True))
    assert got == [("", ""), (" NA", ""), ("x", "x"), ("", ""), ("", "")]


def test_entropy_and_spline(spark):
    got = values(spark, [(2, 1, 3), (3, 0, 3), (0, 0, 0)], "a int, b int, n int", c.entropy_bits([F.col("a"), F.col("b")], F.col("n")))
    assert math.isclose(got[0][0], 0.9182958340544896)
    assert got[1:] == [(0.0,), (None,)]
    knots = [0.0, 0.2, 0.5, 1.0]
    got = values(spark, [(0.0,), (0.7,), (3.0,), (4.0,), (5.0,)], "x double", *c.spline_basis(F.col("x"), knots))
    assert got[0] == (0.0, 0.0, 0.0)
    for k in (1, 2):  # linear behind the last knot
        assert math.isclose(got[3][k] - got[2][k], got[4][k] - got[3][k], rel_tol=1e-9)


def test_rounded(spark):
    row = c.rounded(spark.sql("SELECT 1.23456789D AS a, 3 AS b, timestamp '2024-01-01 00:00:01' AS t, 'x' AS s")).first()
    assert tuple(row) == (1.234568, 3, 1704067201000000, "x")
