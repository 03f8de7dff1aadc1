"""The horizons for telemetry of months, against plain pandas on the sessions' times."""

from __future__ import annotations

import pandas as pd

from sessionlake.config import MONTHS
from sessionlake.operators import censoring
from sessionlake.plans.frames import Frames
from tests.conftest import SMALL


def test_month_horizons(spark):
    f = Frames(spark, SMALL, MONTHS)
    got = {r.horizon_days: r for r in censoring.horizon_summary(f.labels, MONTHS).collect()}
    t = f.assignments.select("pid", "session_index", "login_time", "exit_time").toPandas().sort_values(["pid", "session_index"])
    day = pd.Timedelta(days=1)
    gap = (t.groupby("pid").login_time.shift(-1) - t.exit_time) / day
    left = (t.exit_time.max() - t.exit_time) / day
    assert set(got) == {7, 14, 30}
    for d, r in got.items():
        back = gap <= d  # false where there is no next session
        evaluable = back | (left >= d)
        assert (r.sessions, r.evaluable_sessions, r.censored_sessions) == (len(t), evaluable.sum(), (~evaluable).sum())
        assert (r.returned_sessions, r.disengaged_sessions) == (back.sum(), (evaluable & ~back).sum())
