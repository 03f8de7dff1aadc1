"""The engine's stages under `spark.sql`: views of its frames, and table functions for stages that have parameters.

    lake = Stages(spark, "/root/testdata/sf0.1")
    lake.sql("SELECT * FROM lake_risk('streak', 30) WHERE horizon_days = 7 ORDER BY lift DESC")

Views are plans, not tables, and table functions are SQL over views: Catalyst plans a text as a whole, so filters and columns go
down to the scan of `events` where the operators in between allow it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionlake.config import Config
from sessionlake.operators import censoring, transitions
from sessionlake.plans.frames import Frames

#: Views and the frames behind them.
VIEWS: dict[str, Callable[[Frames], DataFrame]] = {
    "telemetry": lambda f: f.tele,
    "sessions": lambda f: f.sessions,
    "event_assignment": lambda f: f.assigned,
    "session_features": lambda f: f.features,
    "discovery_input": lambda f: f.discovery,
    "state_assignments": lambda f: f.assignments,
    "transition_edges": lambda f: f.edges,
    "transition_edges_without_window": lambda f: f.edges_without_window,
    "disengagement_labels": lambda f: f.labels,
    "labels_by_horizon": lambda f: censoring.by_horizon(f.labels, f.conf, ["pid", "session_id", "state_id", "prev_state_id", "focal_streak"]),
    "horizon_summary": lambda f: censoring.horizon_summary(f.labels, f.conf),
    "transition_matrix": lambda f: transitions.transition_matrix(f.edges, f.conf.n_states),
    "risk_by_transition": lambda f: censoring.risk_by_transition(f.labels, f.conf),
    "risk_by_streak": lambda f: censoring.risk_by_streak(f.labels, f.conf),
    "focal_origins": lambda f: f.origins,
    "focal_frame": lambda f: f.focal,
    "rolling_metrics": lambda f: f.rolling,
    "terminal_anchors": lambda f: f.anchors,
}

_STREAK = "CASE WHEN focal_streak <= 0 THEN 'other' WHEN focal_streak <= 3 THEN concat('x', focal_streak) ELSE 'x4plus' END"

#: Table functions: parameters, columns and body; {p} is the names' prefix, {f} the function's own name, {least} the configured least group.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # Risk and lift by 'transition', 'state', 'streak' or 'player', of groups with enough evaluable sessions; another name is an error.
    "risk": (
        "by STRING DEFAULT 'transition', least BIGINT DEFAULT {least}",
        "horizon_days INT, grp STRING, evaluable_sessions BIGINT, disengaged_sessions BIGINT, risk_pct DOUBLE, lift DOUBLE",
        """
        WITH named AS (
          SELECT horizon_days, evaluable, disengaged,
            CASE {f}.by WHEN 'transition' THEN concat('S', prev_state_id, '->S', state_id) WHEN 'state' THEN string(state_id)
              WHEN 'streak' THEN """ + _STREAK + """ WHEN 'player' THEN pid ELSE raise_error(concat('no grouping is named ', {f}.by)) END AS grp
          FROM {p}labels_by_horizon WHERE {f}.by <> 'transition' OR prev_state_id IS NOT NULL
        ), counts AS (
          SELECT horizon_days, grp, count_if(evaluable) AS ev, count_if(disengaged) AS dis FROM named GROUP BY horizon_days, grp
        ), base AS (
          SELECT horizon_days, try_divide(sum(dis) * 100.0D, sum(ev)) AS overall FROM counts GROUP BY horizon_days
        )
        SELECT horizon_days, grp, ev, dis, try_divide(dis * 100.0D, ev), CASE WHEN overall > 0 THEN try_divide(dis * 100.0D, ev) / overall END
        FROM counts JOIN base USING (horizon_days) WHERE ev >= {f}.least""",
    ),
    # Sessions by state that nobody returned from within any number of days, as labels have it for the configured ones.
    "returns_within": (
        "days DOUBLE",
        "state_id INT, sessions BIGINT, evaluable_sessions BIGINT, disengaged_sessions BIGINT, disengaged_pct DOUBLE",
        """
        WITH seen AS (
          SELECT state_id, coalesce(next_gap_days <= {f}.days, false) AS back, days_to_cutoff >= {f}.days AS followed FROM {p}disengagement_labels
        ), counts AS (
          SELECT state_id, count(*) AS n, count_if(back OR followed) AS ev, count_if(followed AND NOT back) AS dis FROM seen GROUP BY state_id
        )
        SELECT state_id, n, ev, dis, try_divide(dis * 100.0D, ev) FROM counts""",
    ),
    # One player's sessions in order, with states and gaps.
    "player": (
        "id STRING",
        "session_index INT, login_time TIMESTAMP, exit_time TIMESTAMP, duration_minutes DOUBLE, state_id INT, next_gap_days DOUBLE",
        "SELECT session_index, login_time, exit_time, duration_minutes, state_id, next_gap_days FROM {p}disengagement_labels WHERE pid = {f}.id",
    ),
}


class Stages:
    """Views and table functions under names with a prefix. A frame is built when a text first names it, by `sql` or `define`."""

    def __init__(self, spark: SparkSession, folder: str, conf: Config = Config(), prefix: str = "lake_"):  # noqa: B008
        self.spark, self.frames, self.prefix = spark, Frames(spark, folder, conf), prefix
        self.defined: set[str] = set()

    def define(self, text: str) -> None:
        """Defines what a text names, and what that rests on. A name in a comment or a string counts too, which costs a plan and no job but the count of `Frames.hot`."""
        words = set(re.findall(r"\w+", text.lower()))
        for name in (*VIEWS, *FUNCTIONS):
            if self.prefix + name not in words or name in self.defined:
                continue
            self.defined.add(name)
            if name in VIEWS:
                VIEWS[name](self.frames).createOrReplaceTempView(self.prefix + name)
            else:
                of = {"p": self.prefix, "f": self.prefix + name, "least": self.frames.conf.min_group}
                parameters, columns, body = (part.format(**of) for part in FUNCTIONS[name])
                self.define(body)
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.prefix}{name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")

    def sql(self, text: str, **values: object) -> DataFrame:
        """The text's result; values fill its named parameters (`:name`)."""
        self.define(text)
        return self.spark.sql(text, args=values or None)
