"""States of sessions, their sequences, streaks and rolling measures. Everything is a window over one player's sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions import segments
from sessionlake.functions.columns import days_between, entropy_bits, ratio
from sessionlake.operators.features import ACTIVITY, total


def rule_state() -> Column:
    """A session's state by rule: 4 without activity, 0 a first session, 3 several modes, 1 something completed, else 2."""
    return F.when(total(ACTIVITY) == 0, 4).when(F.col("session_index") == 1, 0).when(F.col("mode_diversity") >= 2, 3).when(F.col("tasks_completed") + F.col("jobs_completed") >= 1, 1).otherwise(2)


def is_purchase_anomaly() -> Column:
    """Purchases without any job or task."""
    return (F.col("items_purchased") > 0) & (total(ACTIVITY[:-1]) == 0)


def with_rule_states(features: DataFrame) -> DataFrame:
    return features.withColumns({"state_id": rule_state(), "is_purchase_anomaly": is_purchase_anomaly()})


def purchase_flags(features: DataFrame) -> DataFrame:
    """The flagged sessions alone: session_id and the flag."""
    return features.filter(is_purchase_anomaly()).select("session_id", F.lit(True).alias("is_purchase_anomaly"))


def in_window(ts: Column, conf: Config) -> Column:
    return F.to_date(ts).between(F.lit(conf.window_start).cast("date"), F.lit(conf.window_end).cast("date"))


CARRIED = ("days_since_previous_session", "player_lifetime_days", "job_completion_ratio", "job_exit_ratio", "mode_diversity")


def state_assignments(features: DataFrame, states: DataFrame | None, conf: Config, flags: DataFrame | None = None, carry: tuple[str, ...] = CARRIED, hot: DataFrame | None = None) -> DataFrame:
    """Sessions with their state, its neighbours, flags and the carried features.

    states: session_id, state_id, joined by key; without it features has state_id itself. Without flags none is set, unless
    features has them. The neighbours need no exchange: sessions lie by player already. hot: as for the sessions.
    """
    df = features if states is None else features.join(states, "session_id")
    flag = F.col("is_purchase_anomaly") if "is_purchase_anomaly" in df.columns else F.lit(False)
    if flags is not None:
        df = df.join(flags, "session_id", "left")
        flag = F.coalesce("is_purchase_anomaly", F.lit(False))
    around = {"prev_state_id": segments.lag(F.col("state_id")), "next_state_id": segments.lead(F.col("state_id")), "next_session_id": segments.lead(F.col("session_id")), "next_login_time": segments.lead(F.col("login_time")), "total_sessions": segments.total(F.lit(1))}
    df = segments.scan(df, "pid", "login_time", ["session_index"], around, hot)
    return df.select(
        "session_id", "pid", "session_index", "login_time", "exit_time", "duration_minutes", "state_id", *around,
        in_window(F.col("login_time"), conf).alias("is_window"), flag.alias("is_purchase_anomaly"), *carry,
    )


def state_sequences(assignments: DataFrame) -> DataFrame:
    """Each player's states and sessions in order, joined by blanks. One player's sessions are in one row by definition."""
    items = F.array_sort(F.collect_list(F.struct("session_index", F.col("state_id").cast("string").alias("s"), "session_id")))
    return assignments.groupBy("pid").agg(F.count("*").alias("sessions"), F.concat_ws(" ", F.transform(items, lambda x: x["s"])).alias("state_sequence"), F.concat_ws(" ", F.transform(items, lambda x: x["session_id"])).alias("session_sequence"))


def player_ends(assignments: DataFrame) -> DataFrame:
    """First and last state of each player."""
    first, last = F.col("session_index") == 1, F.col("session_index") == F.col("total_sessions")
    return assignments.groupBy("pid").agg(F.max(F.when(first, F.col("state_id"))).alias("first_state"), F.max(F.when(last, F.col("state_id"))).alias("last_state"), F.max("total_sessions").alias("sessions"))


def with_streak(df: DataFrame, state: int, name: str, hot: DataFrame | None = None) -> DataFrame:
    """Adds the run of `state` up to and with the session, 0 at other states: such sessions so far, less those up to the last session of another state."""
    here, other = (F.coalesce(c, F.lit(False)) for c in (F.col("state_id") == state, F.col("state_id") != state))
    df = segments.scan(df, "pid", "login_time", ["session_index"], {"so far": segments.before(here.cast("int"))}, hot)
    df = segments.scan(df, "pid", "login_time", ["session_index"], {"cut": segments.last(F.when(other, F.col("so far")))}, hot)
    run = F.col("so far") + 1 - F.coalesce("cut", F.lit(0))
    return segments.without_ranges(df).withColumn(name, F.when(here, run).otherwise(0).cast("long")).drop("cut", "so far")


def trajectory_positions(assignments: DataFrame, focal: int, hot: DataFrame | None = None) -> DataFrame:
    """Four measures of how far along its player's sessions a session is, which are not the same."""
    i, n = F.col("session_index"), F.col("total_sessions")
    is_focal = F.col("state_id") == focal
    rows = segments.scan(assignments, "pid", "login_time", ["session_index"], {"last focal": segments.least(F.when(is_focal, -i))}, hot)
    last_focal = -F.col("last focal")
    return rows.select(
        "session_id",
        F.when(n > 1, (i - 1) / (n - 1)).otherwise(0.0).alias("from_first_to_last"),
        F.when(is_focal, i / last_focal).alias("within_focal"),
        (i / n).alias("of_all"),
        (last_focal / n).alias("player_last_focal"),
    )


def prior_exposure(df: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """Prior sessions, prior focal sessions and their share, and focal density of the last w sessions.

    The density's denominator counts a session before the first, so the second session of a player divides by 2: it is the
    lesser of w and the session's position. Focal sessions of the last w are those before, less those before the session w back.
    """
    focal = F.when(F.col("state_id") == conf.focal_state, 1).otherwise(0)
    ahead = lambda df, values: segments.scan(df, "pid", "login_time", ["session_index"], values, hot)
    out = ahead(df, {"prior_focal_count": segments.before(focal), "rows before": segments.before(F.lit(1))})
    back = {f"focal {w} back": segments.lag(F.col("prior_focal_count"), w) for w in conf.densities}
    out = segments.without_ranges(ahead(out, back))
    recent = {f"density_prev{w}": (F.col("prior_focal_count") - F.coalesce(f"focal {w} back", F.lit(0))) / F.least(F.lit(w), F.col("rows before") + 1) for w in conf.densities}
    prior = F.col("session_index") - 1
    out = out.withColumns({"prior_session_count": prior} | recent).drop("rows before", *back)
    return out.withColumn("prior_focal_share", F.coalesce(ratio(F.col("prior_focal_count"), prior), F.lit(0.0)))


METRICS = ("state_entropy", "unique_states", "dominant_state_share", "self_transition_ratio")


def rolling_metrics(df: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """Entropy, number of states, largest share and share of repeats within the last w sessions, for each w."""
    df = segments.with_edges(df, "pid", "login_time", ["session_index"], max(conf.rolling), hot)
    order = Window.partitionBy(*segments.range_keys(df, "pid")).orderBy("session_index")
    same = F.when(F.col("state_id") == F.lag("state_id").over(order), 1).otherwise(0)
    out = df.withColumn("same", same)
    for w in conf.rolling:
        frame = order.rowsBetween(-(w - 1), 0)
        counts = [F.sum(F.when(F.col("state_id") == s, 1).otherwise(0)).over(frame) for s in range(conf.n_states)]
        n = F.count("*").over(frame)
        # The pairs inside the window are those that its rows but the first end.
        pairs = F.sum("same").over(order.rowsBetween(-(w - 2), 0))
        pairs = F.when(F.row_number().over(order) >= w, pairs).otherwise(F.sum("same").over(order))
        out = out.withColumns(
            {
                f"window_n_w{w}": n,
                f"state_entropy_w{w}": entropy_bits(counts, n),
                f"unique_states_w{w}": sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0)),
                f"dominant_state_share_w{w}": F.greatest(*counts) / n,
                f"self_transition_ratio_w{w}": F.when(n >= 2, pairs / (n - 1)),
            }
        )
    return segments.without_edges(out.drop("same"))


def rolling_slopes(rolling: DataFrame, conf: Config, metrics: tuple[str, ...] = METRICS[:3], hot: DataFrame | None = None) -> DataFrame:
    """How fast each measure narrows over the sessions before an anchor, in a regression on its lag; positive is narrowing.

    Entropy and number of states fall with narrowing, shares rise. Null where fewer than slope_points rows have the measure;
    sessions with fewer than that many rows so far are left out.
    """
    rolling = segments.with_edges(rolling, "pid", "login_time", ["session_index"], conf.slope_back, hot)
    frame = Window.partitionBy(*segments.range_keys(rolling, "pid")).orderBy("session_index").rowsBetween(-conf.slope_back, 0)
    out = {}
    for w in conf.rolling:
        for m in metrics:
            y = F.col(f"{m}_w{w}").cast("double")
            x = F.when(y.isNotNull(), F.col("session_index").cast("double"))
            slope = F.when(F.count(y).over(frame) >= conf.slope_points, F.regr_slope(y, x).over(frame))
            out[f"narrowing_{m}_w{w}"] = -slope if m in ("state_entropy", "unique_states") else slope
    return segments.without_edges(rolling.withColumns({"slope_points": F.count("*").over(frame)} | out)).filter(F.col("session_index") >= conf.slope_points)


def next_gap(df: DataFrame) -> Column:
    return days_between("next_login_time", "exit_time")
