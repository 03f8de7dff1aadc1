"""Pairing, assignment and sequences on hand-made marks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.operators import censoring, sequences, sessions, transitions
from sessionlake.streaming.pairing import step

T0 = datetime(2024, 1, 1)
TELE = "event_id long, pid string, event_time timestamp, event_table string, game_mode string, level_progress double, campaign_progress double"


def telemetry(spark, marks, pid="p"):
    """marks: (time, table)."""
    rows = [(k, pid, T0 + timedelta(hours=t), table, "", None, None) for k, (t, table) in enumerate(marks)]
    return spark.createDataFrame(rows, TELE)


def marks(text):
    return [(int(w[1:]), "player_logged_in" if w[0] == "L" else "exited_game") for w in text.split()]


def pairs(spark, text):
    return [((r.login_time - T0).seconds // 3600, (r.exit_time - T0).seconds // 3600) for r in sessions.pair_sessions(telemetry(spark, marks(text))).orderBy("session_index").collect()]


@pytest.mark.parametrize(
    ("text", "want", "overlap", "left_logins", "left_exits"),
    [
        ("L1 E3", [(1, 3)], 0, 0, 0),
        ("L1 L2 E5", [(2, 5)], 1, 1, 0),
        ("E1 L2 E3", [(2, 3)], 0, 0, 1),
        ("L1 E2 L3", [(1, 2)], 0, 1, 0),
        ("L5 E5", [(5, 5)], 0, 0, 0),
        ("L1 L5 E5", [(5, 5)], 1, 1, 0),
        ("L1 E2 E3", [(1, 2)], 0, 0, 1),
        ("L1 L2", [], 0, 2, 0),
        ("E1 E2", [], 0, 0, 2),
    ],
)
def test_pairing(spark, text, want, overlap, left_logins, left_exits):
    assert pairs(spark, text) == want
    r = sessions.pairing_by_player(telemetry(spark, marks(text))).first()
    assert (r.overlapping_logins, r.unmatched_logins, r.unmatched_exits) == (overlap, left_logins, left_exits)
    assert r.logins == r.paired_sessions + r.unmatched_logins
    assert r.exits == r.paired_sessions + r.unmatched_exits


def greedy(marks):
    """Two pointers over sorted logins and exits."""
    logins, exits = sorted(t for t, k in marks if k == 0), sorted(t for t, k in marks if k == 1)
    i = j = 0
    out = []
    while i < len(logins) and j < len(exits):
        if exits[j] < logins[i]:
            j += 1
        elif i + 1 < len(logins) and logins[i + 1] <= exits[j]:
            i += 1
        else:
            out.append((logins[i], exits[j]))
            i, j = i + 1, j + 1
    return out


def test_pairing_is_greedy_pairing(spark):
    rng = random.Random(3)
    cases = [[(rng.randrange(12), rng.randrange(2)) for _ in range(rng.randrange(1, 10))] for _ in range(120)]
    rows = [(k * 100 + n, str(k), T0 + timedelta(hours=t), ("player_logged_in", "exited_game")[kind], "", None, None) for k, case in enumerate(cases) for n, (t, kind) in enumerate(case)]
    got: dict[int, list] = {}
    for r in sessions.pair_sessions(spark.createDataFrame(rows, TELE)).orderBy("session_index").collect():
        got.setdefault(int(r.pid), []).append((int((r.login_time - T0).total_seconds() // 3600), int((r.exit_time - T0).total_seconds() // 3600)))
    for k, case in enumerate(cases):
        assert got.get(k, []) == greedy(case)
        assert step(None, [(t, kind, n) for n, (t, kind) in enumerate(case)])[1] == greedy(case)


def test_assignment_bounds(spark):
    tele = telemetry(spark, [(10, "player_logged_in"), (20, "exited_game"), *[(t, "task_completed") for t in (9, 10, 20, 21)]])
    got = sessions.assign_events(tele, sessions.pair_sessions(tele)).filter("event_table = 'task_completed'").orderBy("event_time").collect()
    assert [r.session_id is not None for r in got] == [False, True, True, False]


def sequence(spark, states, gaps_days=1, pid="p"):
    rows = [(f"{pid}{k}", pid, k + 1, T0 + timedelta(days=k * gaps_days), T0 + timedelta(days=k * gaps_days, hours=1), 60.0, s, 0.0, 0.0) for k, s in enumerate(states)]
    df = spark.createDataFrame(rows, "session_id string, pid string, session_index int, login_time timestamp, exit_time timestamp, duration_minutes double, state_id int, days_since_previous_session double, player_lifetime_days double")
    return df


def assigned(spark, states, conf=Config(), **kw):  # noqa: B008
    return sequences.state_assignments(sequence(spark, states, **kw), None, conf, carry=("days_since_previous_session", "player_lifetime_days"))


def test_density_and_streak(spark):
    df = sequences.prior_exposure(assigned(spark, [4, 4, 1, 4, 4, 4, 1]), Config())
    got = [r.density_prev5 for r in df.orderBy("session_index").collect()]
    assert got == pytest.approx([0, 1 / 2, 2 / 3, 2 / 4, 3 / 5, 4 / 5, 4 / 5])
    s = sequences.with_streak(assigned(spark, [4, 4, 1, 4]), 4, "streak").orderBy("session_index").collect()
    assert [r.streak for r in s] == [1, 2, 0, 1]


def test_rolling(spark):
    got = sequences.rolling_metrics(assigned(spark, [1, 1, 2]), Config()).orderBy("session_index").collect()
    assert [r.state_entropy_w3 for r in got] == pytest.approx([0, 0, 0.9182958])
    assert [r.self_transition_ratio_w3 for r in got] == [None, 1.0, 0.5]


def test_censoring(spark):
    conf = Config(horizons=(30,))
    rows = [("a", 40), ("b", 10)]
    for pid, left in rows:
        df = sequence(spark, [1], pid=pid)
        end = sequence(spark, [1], pid="z").withColumn("exit_time", F.lit(T0 + timedelta(days=left, hours=1)))
        labels = censoring.disengagement_labels(sequences.state_assignments(df.unionByName(end), None, conf, carry=()), conf)
        r = labels.filter(F.col("pid") == pid).first()
        assert (r.evaluable_30d, r.censored_30d, r.disengaged_30d) == ((True, False, True) if left == 40 else (False, True, False))
    r = censoring.disengagement_labels(assigned(spark, [1, 1], conf, gaps_days=5), conf).orderBy("session_index").first()
    assert (r.evaluable_30d, r.disengaged_30d) == (True, False)


def test_window_is_bridged_and_matrix_balanced(spark):
    conf = Config(window_start="2024-01-02", window_end="2024-01-02")
    df = assigned(spark, [1, 4, 2], conf)
    e = transitions.edges(df.filter(~F.col("is_window"))).collect()
    assert [(r.from_state, r.to_state) for r in e] == [(1, 2)]
    both = assigned(spark, [1, 1, 1, 2], pid="a").unionByName(assigned(spark, [1, 2], pid="b"))
    m = {(r.from_state, r.to_state): r.probability for r in transitions.balanced_matrix(transitions.edges(both), 5).collect()}
    assert m[1, 1] == pytest.approx(1 / 3)
    assert m[1, 2] == pytest.approx(2 / 3)
    assert m[0, 0] is None
