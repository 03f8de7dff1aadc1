"""Right-censored disengagement at several horizons, and risk tables over any groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions.columns import clip, days_between, ratio, right_closed
from sessionlake.functions.quantiles import with_quantiles
from sessionlake.operators.sequences import next_gap, with_streak


def disengagement_labels(assignments: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """For each horizon d whether a session is evaluable, censored or disengaged.

    Returned: the next login is within d days. Evaluable: returned, or d days of data follow. Disengaged: evaluable and not
    returned. A missing gap is no return, so comparisons with it are made false first. The end of data is the
    latest exit of all, one row joined to every session.
    """
    cutoff = assignments.agg(F.max("exit_time").alias("cutoff"))
    df = assignments.crossJoin(F.broadcast(cutoff))  # one row
    df = with_streak(df, conf.focal_state, "focal_streak", hot).withColumns({"next_gap_days": next_gap(df), "days_to_cutoff": days_between("cutoff", "exit_time"), "is_last": F.col("next_session_id").isNull()}).drop("cutoff")
    out = {}
    for d in conf.horizons:
        back = F.coalesce(F.col("next_gap_days") <= d, F.lit(False))
        evaluable = back | (F.col("days_to_cutoff") >= d)
        out |= {f"evaluable_{d}d": evaluable, f"censored_{d}d": ~evaluable, f"disengaged_{d}d": evaluable & ~back}
    return df.withColumns(out)


GAP_EDGES = (float("-inf"), 0, 1 / 24, 1, 3, 7, 14, 30, 60, 120, float("inf"))
GAP_LABELS = ("<=0d", "0-1h", "1h-1d", "1-3d", "3-7d", "7-14d", "14-30d", "30-60d", "60-120d", ">120d")
STREAK_EDGES = (-1, 0, 1, 2, 3, float("inf"))
STREAK_LABELS = ("other", "x1", "x2", "x3", "x4plus")


def gap_summary(labels: DataFrame) -> DataFrame:
    g = F.col("next_gap_days")
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = labels.agg(F.count(g).alias("with_next"), F.count_if(g.isNull()).alias("without_next"), F.min(g).alias("min"), F.max(g).alias("max"))
    return with_quantiles(out, labels, [], {n: ("next_gap_days", p) for n, p in names.items()}).select("with_next", "without_next", "min", *names, "max")


def gap_histogram(labels: DataFrame) -> DataFrame:
    counts = labels.filter("next_gap_days is not null").groupBy(right_closed(F.col("next_gap_days"), GAP_EDGES, GAP_LABELS).alias("gap_bin")).agg(F.count("*").alias("sessions"))
    total = counts.agg(F.sum("sessions").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("gap_bin", "sessions", (F.col("sessions") * 100.0 / F.col("total")).alias("pct"))  # one row


def by_horizon(df: DataFrame, conf: Config, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each session and horizon: horizon_days, evaluable, censored, disengaged. One pass serves all horizons."""
    rows = [F.struct(F.lit(d).alias("horizon_days"), F.col(f"evaluable_{d}d").alias("evaluable"), F.col(f"censored_{d}d").alias("censored"), F.col(f"disengaged_{d}d").alias("disengaged")) for d in conf.horizons]
    return df.select(*keep, F.inline(F.array(*rows)))


def horizon_summary(labels: DataFrame, conf: Config) -> DataFrame:
    ev, dis = F.count_if("evaluable"), F.count_if("disengaged")
    return by_horizon(labels, conf).groupBy("horizon_days").agg(
        F.count("*").alias("sessions"),
        ev.alias("evaluable_sessions"),
        F.count_if("censored").alias("censored_sessions"),
        (F.count_if("censored") * 100.0 / F.count("*")).alias("censored_pct"),
        dis.alias("disengaged_sessions"),
        F.try_divide(dis * 100.0, ev).alias("disengaged_pct"),
        (ev - dis).alias("returned_sessions"),
    )


def risk_by_group(df: DataFrame, groups: Sequence[str], conf: Config) -> DataFrame:
    """Risk of each group (null is one) at each horizon, where enough sessions are evaluable, and its lift over all rows given.

    The overall rate comes from the groups' own sums: the table is read once.
    """
    counts = by_horizon(df, conf, groups).groupBy("horizon_days", *groups).agg(F.count_if("evaluable").alias("evaluable_sessions"), F.count_if("disengaged").alias("disengaged_sessions"))
    base = counts.groupBy("horizon_days").agg(F.sum("evaluable_sessions").alias("all_ev"), F.sum("disengaged_sessions").alias("all_dis"))
    risk = F.col("disengaged_sessions") * 100.0 / F.col("evaluable_sessions")
    overall = F.try_divide(F.col("all_dis") * 100.0, F.col("all_ev"))
    joined = counts.filter(F.col("evaluable_sessions") >= conf.min_group).join(F.broadcast(base), "horizon_days")  # a row for each horizon
    return joined.select("horizon_days", *groups, "evaluable_sessions", "disengaged_sessions", risk.alias("risk_pct"), F.when(overall > 0, risk / overall).alias("lift"))


def state_pair(a: Column, b: Column) -> Column:
    """'S1->S4', with start and end where a side is missing."""
    side = lambda c, missing: F.coalesce(F.concat(F.lit("S"), c.cast("string")), F.lit(missing))
    return F.concat(side(a, "start"), F.lit("->"), side(b, "end"))


def risk_by_transition(labels: DataFrame, conf: Config) -> DataFrame:
    """Risk after the session that a transition leads to, which is the row that has a previous state."""
    dest = labels.filter("prev_state_id is not null").withColumn("transition_pair", state_pair(F.col("prev_state_id"), F.col("state_id")))
    return risk_by_group(dest, ["transition_pair"], conf)


def risk_by_streak(labels: DataFrame, conf: Config) -> DataFrame:
    return risk_by_group(labels.withColumn("streak_bucket", right_closed(F.col("focal_streak"), STREAK_EDGES, STREAK_LABELS)), ["streak_bucket"], conf)


def focused_comparisons(labels: DataFrame, conf: Config) -> DataFrame:
    """Risks overall, in the focal state, after staying in it, in streaks and after moving to it, with lifts, for each horizon."""
    long = by_horizon(labels, conf, ["state_id", "prev_state_id", "focal_streak"])
    f = conf.focal_state
    now, prev = F.col("state_id") == f, F.col("prev_state_id")
    risk = lambda cond: F.try_divide(F.count_if(cond & F.col("disengaged")) * 100.0, F.count_if(cond & F.col("evaluable")))
    a, b = conf.recovery_states
    out = long.groupBy("horizon_days").agg(
        risk(F.lit(True)).alias("overall_risk_pct"),
        risk(now).alias("focal_risk_pct"),
        risk(now & (prev == f)).alias("focal_after_focal_risk_pct"),
        risk(F.col("focal_streak") >= 2).alias("streak_2plus_risk_pct"),
        risk(now & (prev == a)).alias("s1_to_focal_risk_pct"),
        risk(now & (prev == b)).alias("s2_to_focal_risk_pct"),
    )
    return out.withColumns({"focal_lift": ratio(F.col("focal_risk_pct"), F.col("overall_risk_pct")), "streak_2plus_lift": ratio(F.col("streak_2plus_risk_pct"), F.col("overall_risk_pct")), "s2_minus_s1_pctpt": F.col("s2_to_focal_risk_pct") - F.col("s1_to_focal_risk_pct")})


def recovered_within(conf: Config, d: int) -> Column:
    """The next session is in a recovery state, within d days, at an evaluable session."""
    return F.coalesce(F.col("next_state_id").isin(*conf.recovery_states) & (F.col("next_gap_days") <= d) & F.col(f"evaluable_{d}d"), F.lit(False))


def capped_gap(d: int) -> Column:
    return clip(F.coalesce(F.col("next_gap_days"), F.lit(float(d))), 0, d)
