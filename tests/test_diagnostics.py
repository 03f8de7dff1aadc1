from __future__ import annotations

from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlake.catalog import ORACLES, QUERIES
from sessionlake.operators import diagnostics
from sessionlake.operators.diagnostics import HEAVY, QUANTILES, numeric_summary, scatter_sample, spearman_pairs, with_ranks
from sessionlake.session import written

COLUMNS = ["a", "b", "c", "d", "same"]


@pytest.fixture(scope="module")
def rows():
    # Ties, negative numbers, a column with one value, and nulls in two columns that don't coincide.
    return [(k, (k * 37 % 101) / 4, float(k % 5) if k % 3 else None, float(-k * k % 89), float(k // 60) if k % 7 else None, 2.0, "x") for k in range(300)]


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_spearman_is_pandas_rank_correlation(spark, rows, buckets):
    df = spark.createDataFrame(rows, "session_id long, a double, b double, c double, d double, same double, key string")
    got = {(r.feature_a, r.feature_b): r for r in spearman_pairs(df, COLUMNS, buckets=buckets).collect()}
    table = pd.DataFrame(rows, columns=["session_id", *COLUMNS, "key"])
    assert set(got) == set(combinations(COLUMNS, 2))
    for (a, b), r in got.items():
        part = table[[a, b]].dropna()
        assert r.rows == len(part)
        if "same" in (a, b):
            assert r.spearman is None and r.abs_spearman is None
        else:
            want = part[a].rank().corr(part[b].rank())
            assert r.spearman == pytest.approx(want) and r.abs_spearman == pytest.approx(abs(want))


def test_spearman_of_columns_full_of_one_value(spark):
    """Zeros of 90 % of rows are ranked by a broadcast table: the join by key has no key of many rows, nor a task of many."""
    rng = np.random.default_rng(8)
    n = 20_000
    table = pd.DataFrame({"session_id": range(n), "z": np.where(rng.random(n) < 0.9, 0.0, rng.random(n)), "w": np.where(rng.random(n) < 0.9, 0.0, rng.integers(0, 50, n).astype(float)), "u": rng.random(n)})
    df = spark.createDataFrame(table)
    got = {(r.feature_a, r.feature_b): r.spearman for r in spearman_pairs(df, ["z", "w", "u"]).collect()}
    for a, b in combinations(["z", "w", "u"], 2):
        assert got[a, b] == pytest.approx(table[a].rank().corr(table[b].rank()))

    long = df.selectExpr("session_id", "0 AS key", "z AS value")
    ranks = long.groupBy("key", "value").agg(F.count("*").alias("n")).withColumn("rank", F.col("value") * 2)
    ranked = with_ranks(long, ranks, {0: n / HEAVY})
    assert ranked.count() == n and ranked.filter("rank <> value * 2").count() == 0
    # The rows that the join by key deals out, in 64 parts: all but the zeros, evenly.
    frequent = [r.value for r in ranks.filter(F.col("n") > n / HEAVY).collect()]
    dealt = long.filter(~F.col("value").isin(frequent)).repartition(64, "key", "value").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert frequent == [0.0] and dealt.max() <= 2 * dealt.median()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_spearman_of_nothing(spark, rows):
    df = spark.createDataFrame(rows, "session_id long, a double, b double, c double, d double, same double, key string")
    assert spearman_pairs(df.limit(0), COLUMNS).collect() == []
    assert spearman_pairs(df.filter("session_id = 1"), ["a", "c"]).collect()[0].spearman is None


def test_spearman_refuses_ids_that_repeat(spark, rows):
    df = spark.createDataFrame(rows, "session_id long, a double, b double, c double, d double, same double, key string")
    with pytest.raises(ValueError, match="repeated"):
        spearman_pairs(df.union(df), ["a", "c"])


def test_numeric_summary_is_numpys(spark):
    """Nulls, ties across the top's border, one value, no value, negative sums; a written table of counted values answers all."""
    rng = np.random.default_rng(6)
    rows = [(float(x) if k % 5 else None, float(k % 3), 7.0, None, -float(k)) for k, x in enumerate(rng.exponential(size=777))]
    df = spark.createDataFrame(rows, "a double, b double, same double, none double, minus double")
    got = {r.feature: r for r in numeric_summary(df, df.columns).collect()}
    for i, c in enumerate(df.columns):
        r, x = got[c], np.array([row[i] for row in rows if row[i] is not None])
        assert (r.non_null, r.unique_values, r.negative_count) == (len(x), len(set(x)), int((x < 0).sum()))
        assert r.missing_pct == pytest.approx(100 - 100 * len(x) / 777)
        assert r.zero_pct == pytest.approx(100 * (x == 0).sum() / 777)
        if not len(x):
            assert (r.mean, r.std, r.min, r.p50, r.max, r.top_share_of_sum) == (None,) * 6
            continue
        assert (r.mean, r.std, r.min, r.max) == pytest.approx((x.mean(), x.std(ddof=1), x.min(), x.max()))
        assert [r[k] for k in QUANTILES] == pytest.approx(list(np.quantile(x, list(QUANTILES.values()))))
        assert r.top_share_of_sum == (pytest.approx(np.sort(x)[-8:].sum() / x.sum()) if x.sum() > 0 else None)
    assert [r.non_null for r in numeric_summary(df.limit(0), ["a", "b"]).collect()] == [0, 0]
    one = numeric_summary(df.limit(2).select("b"), ["b"]).first()
    assert (one.p50, one.std) == (0.5, pytest.approx(0.5**0.5))


def test_scatter_sample_has_every_session(spark, tmp_path):
    """More sessions than a chart's sample holds: the query's rows are its SQL's."""
    n = 20_500
    at = "timestamp_seconds(1700000000 + (id div 2) * 977 + (id % 2) * (1 + (id div 2) % 5003))"
    events = spark.range(2 * n).selectExpr("id AS event_id", f"{at} AS ts", "(id div 2) % 6007 AS user_id", "if(id % 2 = 0, 'view', 'error') AS event_type", "1.5D AS value", """'{"k": 7}' AS props""")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.session_id, round(r.duration_minutes, 5), round(r.player_lifetime_days, 5)) for r in QUERIES["scatter_sample"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rel = con.sql(ORACLES["scatter_sample"]).select("session_id, duration_minutes, player_lifetime_days")
    assert len(got) == n and got == sorted((s, round(x, 5), round(y, 5)) for s, x, y in rel.fetchall())
    assert scatter_sample(spark.range(50).selectExpr("id", "id AS x", "id AS y"), "id", "x", "y", n=20).count() == 20


def test_spearman_counts_rows_by_value_once_a_column(spark, rows, monkeypatch):
    """Ranks among the rows of a pair come from the column's one table of values: no value is there again for each partner with nulls."""
    tables = []
    monkeypatch.setattr(diagnostics, "written", lambda df: tables.append(df) or written(df))
    df = spark.createDataFrame(rows, "session_id long, a double, b double, c double, d double, same double, key string")
    assert len(spearman_pairs(df, COLUMNS).collect()) == 10
    assert len(tables) == 1 and tables[0].count() == sum(df.filter(F.col(c).isNotNull()).select(c).distinct().count() for c in COLUMNS)
