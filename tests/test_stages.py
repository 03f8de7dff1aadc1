from __future__ import annotations

import pytest

from sessionlake.operators import censoring
from sessionlake.plans.stages import FUNCTIONS, VIEWS, Stages
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def lake(spark):
    return Stages(spark, SMALL)


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_names_are_defined_when_a_text_names_them(spark):
    lake = Stages(spark, SMALL, prefix="once_")
    lake.sql("SELECT * FROM once_returns_within(2)").schema  # noqa: B018
    assert lake.defined == {"returns_within", "disengagement_labels"}
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("once_")} == {"once_disengagement_labels"}


def test_every_name_gives_rows(lake):
    calls = {"risk": "lake_risk()", "returns_within": "lake_returns_within(3)", "player": "lake_player('1')"}
    assert set(calls) == set(FUNCTIONS)
    for source in (*(f"lake_{v}" for v in VIEWS), *calls.values()):
        assert lake.sql(f"SELECT * FROM {source} LIMIT 1").count() == 1, source


def test_risk_is_the_operators(lake):
    f = lake.frames
    assert rows(lake.sql("SELECT * FROM LAKE_RISK('streak')")) == rows(censoring.risk_by_streak(f.labels, f.conf))
    by_state = censoring.risk_by_group(f.labels.withColumn("state_id", f.labels.state_id.cast("string")), ["state_id"], f.conf)
    assert rows(lake.sql("SELECT * FROM lake_risk(by => 'state')")) == rows(by_state)
    assert rows(lake.sql("SELECT * FROM lake_risk('state', 10)")) == [r for r in rows(by_state) if r[2] >= 10]
    with pytest.raises(Exception, match="no grouping is named colour"):
        lake.sql("SELECT * FROM lake_risk('colour')").collect()


def test_parameters(lake):
    labels = lake.frames.labels
    for d in lake.frames.conf.horizons:
        want = labels.groupBy("state_id").agg({"*": "count"}).count()
        got = lake.sql("SELECT state_id, evaluable_sessions, disengaged_sessions FROM lake_returns_within(:days)", days=d)
        assert got.count() == want
        kept = labels.groupBy("state_id").agg(*[censoring.F.count_if(f"{c}_{d}d") for c in ("evaluable", "disengaged")])
        assert rows(got) == rows(kept)
    pid = labels.first().pid
    assert [r.session_index for r in lake.sql("SELECT * FROM lake_player(:p) ORDER BY session_index", p=pid).collect()] == list(range(1, labels.filter(labels.pid == pid).count() + 1))


def test_a_players_filter_reaches_the_scan(lake):
    """The player's own rows are filtered below the windows, which are by player; only the end of all data, one row, is read from everyone's."""
    plan = lake.sql("SELECT * FROM lake_player('1')")._jdf.queryExecution().optimizedPlan().toString()
    of_player, *_ = plan.split("Relation")
    assert "(cast(user_id" in of_player[of_player.rindex("Filter") :] and " = 1)" in of_player[of_player.rindex("Filter") :]
