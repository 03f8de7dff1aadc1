"""Scans over hot keys against windows, and the session operators with a player who owns half of all events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions import segments
from sessionlake.functions.columns import rounded
from sessionlake.functions.segments import hot_keys, scan, without_ranges
from sessionlake.operators import censoring, clusters, features, recovery, sequences, sessions, transitions

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for k in range(900):
        pid = "hot" if rng.random() < 0.5 else "warm" if rng.random() < 0.4 else f"p{rng.randrange(40)}"
        out.append((pid, T0 + timedelta(minutes=rng.randrange(300)), k, rng.randrange(9) if rng.random() < 0.6 else None))
    return spark.createDataFrame(out, "pid string, t timestamp, id long, v long")


def values():
    return {"before": segments.before(F.col("v")), "last": segments.last(F.col("v")), "coming": segments.coming(F.col("v")), "lag": segments.lag(F.col("v")), "lag5": segments.lag(F.col("id"), 5), "lead": segments.lead(F.col("id")), "lead3": segments.lead(F.col("v"), 3), "total": segments.total(F.col("v")), "least": segments.least(F.col("t"))}


@pytest.mark.parametrize("task_rows", [3, 40, 100, 10**6])
def test_scan_is_windows(spark, rows, task_rows):
    hot = hot_keys(rows, "pid", "t", task_rows)
    assert (hot is None) == (task_rows > 900)
    if task_rows == 100:
        assert {r.pid for r in hot.collect()} == {"hot", "warm"}
    want = sorted(map(tuple, scan(rows, "pid", "t", ["t", "id"], values()).collect()))
    got = without_ranges(scan(rows, "pid", "t", ["t", "id"], values(), hot))
    assert got.columns == [*rows.columns, *values()]
    assert sorted(map(tuple, got.collect())) == want


def test_ranges_bound_a_task(spark, rows):
    """No window has more than a tenth of the rows, though a key has half of them."""
    hot = hot_keys(rows, "pid", "t", 45)
    sizes = [r["count"] for r in segments.with_ranges(rows, "pid", "t", hot).groupBy("pid", segments.RANGE).count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 90
    assert hot_keys(rows.limit(0), "pid", "t", 0) is None
    assert hot_keys(rows.withColumn("pid", F.lit(None).cast("string")), "pid", "t", 5) is None


@pytest.fixture(scope="module")
def tele(spark):
    """Half of all events are one player's; equal times, marks in odd orders, events outside of sessions."""
    rng = random.Random(9)
    tables = ["player_logged_in"] * 3 + ["exited_game"] * 3 + ["job_started", "job_completed", "task_completed", "item_purchased"]
    out = []
    for k in range(1600):
        pid = "hot" if rng.random() < 0.5 else f"p{rng.randrange(30)}"
        out.append((k, pid, T0 + timedelta(minutes=rng.randrange(60 * 24 * 20) if rng.random() < 0.9 else 500), rng.choice(tables), rng.choice(["", "Career", "Special"]), rng.random(), rng.random()))
    return spark.createDataFrame(out, "event_id long, pid string, event_time timestamp, event_table string, game_mode string, level_progress double, campaign_progress double")


def same(a, b):
    assert a.columns == b.columns
    key = lambda r: tuple(str(x) for x in r)
    x, y = sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)
    assert len(x) > 20
    assert x == y


def test_session_operators_with_a_hot_player(spark, tele):
    hot = hot_keys(tele, "pid", "event_time", 80)
    assert [r.pid for r in hot.collect()] == ["hot"] and len(hot.first().cuts) >= 8
    same(sessions.login_exit_stream(tele, hot), sessions.login_exit_stream(tele))
    paired = sessions.pair_sessions(tele)
    same(sessions.pair_sessions(tele, hot=hot), paired)
    same(sessions.assign_events(tele, paired, hot), sessions.assign_events(tele, paired))
    same(sessions.session_stream(tele, hot), sessions.session_stream(tele))
    same(sessions.pairing_by_player(tele, hot), sessions.pairing_by_player(tele))
    found = features.session_features(tele)
    same(features.session_features(tele, hot), found)
    conf = Config()
    states = sequences.state_assignments(sequences.with_rule_states(found), None, conf)
    same(sequences.state_assignments(sequences.with_rule_states(found), None, conf, hot=hot), states)
    same(sequences.prior_exposure(states, conf, hot), sequences.prior_exposure(states, conf))
    same(sequences.with_streak(states, 4, "streak", hot), sequences.with_streak(states, 4, "streak"))


@pytest.mark.parametrize("task_rows", [7, 80])
def test_windows_over_edges_with_a_hot_player(spark, tele, task_rows):
    """Rolling measures, slopes, edges and states ahead, in ranges that are shorter than what a window looks back at, too."""
    conf, hot = Config(), hot_keys(tele, "pid", "event_time", task_rows)
    states = sequences.state_assignments(sequences.with_rule_states(features.session_features(tele)), None, conf).cache()
    rolling = sequences.rolling_metrics(states, conf)
    same(sequences.rolling_metrics(states, conf, hot), rolling)
    same(rounded(sequences.rolling_slopes(rolling, conf, hot=hot), 9), rounded(sequences.rolling_slopes(rolling, conf), 9))
    same(transitions.edges(states, hot), transitions.edges(states))
    labels = censoring.disengagement_labels(states, conf)
    found = sequences.with_rule_states(features.session_features(tele)).withColumn("cluster", F.col("state_id"))
    same(clusters.with_neighbours(found, hot=hot), clusters.with_neighbours(found))
    same(recovery.focal_origins(labels, conf, hot), recovery.focal_origins(labels, conf))
    same(sequences.trajectory_positions(states, 4, hot), sequences.trajectory_positions(states, 4))
    relapses = recovery.time_to_relapse(labels, conf)
    assert sorted(map(repr, recovery.time_to_relapse(labels, conf, hot).collect())) == sorted(map(repr, relapses.collect()))
    edged = segments.with_edges(states, "pid", "login_time", ["session_index"], 10, hot)
    copies = edged.filter(F.col(segments.COPY)).groupBy("pid", segments.RANGE).count().collect()
    assert copies and max(r["count"] for r in copies) == 10
    assert segments.without_edges(edged).columns == states.columns and segments.without_edges(edged).count() == states.count()
    states.unpersist()


def test_tasks_of_a_hot_player(spark, tele):
    """After the exchange of the segmented scan no task reads more than a tenth of the events."""
    hot = hot_keys(tele, "pid", "event_time", 80)
    marks = sessions.login_exit_stream(tele, hot)
    assert segments.RANGE not in marks.columns
    ranged = segments.with_ranges(tele, "pid", "event_time", hot)
    tasks = ranged.repartition(64, "pid", segments.RANGE).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) <= 160
    assert "Window" in marks._jdf.queryExecution().optimizedPlan().toString()
