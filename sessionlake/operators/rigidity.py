"""How behaviour narrows before a player's last observed session: trends by distance, contrasts, and matched comparisons."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions.columns import days_between, month, right_closed
from sessionlake.functions.quantiles import with_quantiles
from sessionlake.functions.segments import numbered
from sessionlake.operators.recovery import log1p0
from sessionlake.operators.sequences import METRICS, prior_exposure, rolling_metrics, rolling_slopes
from sessionlake.session import ship, written

DAY_EDGES = (float("-inf"), 1, 3, 7, 14, 30, 60, 90, float("inf"))
DAY_LABELS = ("0-1d", "1-3d", "3-7d", "7-14d", "14-30d", "30-60d", "60-90d", "90d+")


def lag_period(lag: Column) -> Column:
    return F.when(lag.between(0, 2), "0-2 sessions").when(lag.between(3, 5), "3-5 sessions").when(lag.between(6, 10), "6-10 sessions").when(lag.between(11, 20), "11-20 sessions").when(lag > 20, "20+ sessions").otherwise("unknown")


def terminal_anchors(labels: DataFrame, conf: Config) -> DataFrame:
    """Each player's last session, where it is disengaged at the longest horizon."""
    d = conf.long_horizon
    return labels.filter(F.col("is_last") & F.col(f"evaluable_{d}d") & F.col(f"disengaged_{d}d")).select("pid", F.col("session_id").alias("anchor_session_id"), F.col("session_index").alias("anchor_index"), F.col("login_time").alias("anchor_login"), F.col("state_id").alias("anchor_state_id"))


def before_anchors(rolling: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sessions up to their player's anchor, with the distance to it in sessions and days."""
    df = rolling.join(anchors, "pid").filter(F.col("session_index") <= F.col("anchor_index"))
    lag, days = F.col("anchor_index") - F.col("session_index"), days_between("anchor_login", "login_time")
    return df.withColumns({"session_lag": lag, "days_to_anchor": days, "day_bin": right_closed(days, DAY_EDGES, DAY_LABELS), "lag_period": lag_period(lag)})


def metric_columns(conf: Config, metrics: Sequence[str] = METRICS) -> list[str]:
    return [f"{m}_w{w}" for w in conf.rolling for m in metrics]


def trend(df: DataFrame, groups: Sequence[str], conf: Config) -> DataFrame:
    """Mean and median of each rolling measure within groups."""
    names = metric_columns(conf)
    out = df.groupBy(*groups).agg(F.count("*").alias("sessions"), F.count_distinct("pid").alias("players"), *[F.avg(c).alias(f"{c}_mean") for c in names])
    return with_quantiles(out, df, groups, {f"{c}_median": (c, 0.5) for c in names})


def metrics_long(df: DataFrame, conf: Config, keep: Sequence[str]) -> DataFrame:
    """keep, metric, window, value: a row for each rolling measure."""
    parts = [F.struct(F.lit(m).alias("metric"), F.lit(w).alias("window"), F.col(f"{m}_w{w}").cast("double").alias("value")) for w in conf.rolling for m in METRICS]
    return df.select(*keep, F.inline(F.array(*parts)))


def near_far(df: DataFrame, conf: Config, groups: Sequence[str] = ()) -> DataFrame:
    """Means within two sessions of the anchor against six to ten before it, for each measure, and within groups if any."""
    long = metrics_long(df, conf, [*groups, "session_lag"])
    near, far = F.when(F.col("session_lag") <= 2, F.col("value")), F.when(F.col("session_lag").between(6, 10), F.col("value"))
    return long.groupBy(*groups, "window", "metric").agg(F.avg(near).alias("near_mean"), F.avg(far).alias("far_mean"), (F.avg(near) - F.avg(far)).alias("near_minus_far"), F.count(near).alias("near_sessions"), F.count(far).alias("far_sessions"))


def player_contrast(df: DataFrame, conf: Config, metrics: Sequence[str] = ("state_entropy", "self_transition_ratio")) -> DataFrame:
    """The same contrast for each player, wide."""
    lag = F.col("session_lag")
    parts, gaps = [], {}
    for c in metric_columns(conf, metrics):
        parts += [F.avg(F.when(lag <= 2, F.col(c))).alias(f"near_{c}"), F.avg(F.when(lag.between(6, 10), F.col(c))).alias(f"far_{c}")]
        gaps[f"gap_{c}"] = F.col(f"near_{c}") - F.col(f"far_{c}")
    return df.groupBy("pid").agg(F.count("*").alias("sessions"), F.max("anchor_index").alias("anchor_index"), F.max("anchor_state_id").alias("anchor_state_id"), F.max("days_to_anchor").alias("days_observed"), *parts).withColumns(gaps)


def anchor_distribution(anchors: DataFrame) -> DataFrame:
    out = anchors.groupBy("anchor_state_id").agg(F.count_distinct("pid").alias("players"), F.count("*").alias("anchors"))
    return out.withColumn("share", F.col("anchors") / F.sum("anchors").over(Window.partitionBy()))  # a row for each state


def player_slopes(long: DataFrame) -> DataFrame:
    """Regression slope of each measure on the distance to the anchor, for each player, from three rows and two distances on."""
    lag, v = F.col("session_lag").cast("double"), F.col("value")
    known = long.filter(v.isNotNull() & lag.isNotNull())
    out = known.groupBy("pid", "window", "metric").agg(F.count("*").alias("points"), F.count_distinct(lag).alias("lags"), F.regr_slope(v, lag).alias("slope"))
    return out.filter("points >= 3 and lags >= 2").select("pid", "window", "metric", "points", "slope")


# ---- Matched cases and controls

INDEX_EDGES, INDEX_LABELS = (0, 5, 10, 20, 50, 100, float("inf")), ("1-5", "6-10", "11-20", "21-50", "51-100", "100+")


def anchor_frame(labels: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """Sessions with enough history for slopes, with their slopes, exposure, stratum and role.

    Cases are terminal anchors, controls evaluable sessions after which the player returned. Sessions where any slope is null have
    no role. The stratum is the month and a bin of the session's index.
    """
    d = conf.long_horizon
    df = prior_exposure(labels, conf, hot).withColumns({"log_session_index": F.log1p("session_index"), "log_player_lifetime_days": log1p0("player_lifetime_days"), "log_prior_session_count": log1p0("prior_session_count"), "log_prior_focal_count": log1p0("prior_focal_count")})
    df = rolling_slopes(rolling_metrics(df, conf, hot), conf, hot=hot)
    slopes = slope_columns(conf)
    full = F.lit(True)
    for c in slopes:
        full = full & F.col(c).isNotNull()
    case = F.col("is_last") & F.col(f"evaluable_{d}d") & F.col(f"disengaged_{d}d")
    control = F.col(f"evaluable_{d}d") & ~F.col(f"disengaged_{d}d") & ~F.col("is_last")
    role = F.when(full & case, 1).when(full & control, 0)
    stratum = F.concat(month(F.col("login_time")), F.lit("|"), right_closed(F.col("session_index"), INDEX_EDGES, INDEX_LABELS))
    return df.withColumns({"terminal_case": role, "stratum": stratum, "month": month(F.col("login_time"))})


def slope_columns(conf: Config) -> list[str]:
    return [f"narrowing_{m}_w{w}" for w in conf.rolling for m in METRICS[:3]]


MATCHES = "stratum string, number long, case_pid string, case_session_id string, control_pid string, control_session_id string, case_index long, control_index long"


MATCH_BLOCK = 200_000


def greedy_matches(frame: DataFrame, block: int = MATCH_BLOCK) -> DataFrame:
    """One-to-one matches without replacement within each stratum, in the order of index, player and session.

    A case takes the next control; one of the same player is passed over and used up. Strata of at most `block` sessions are
    streamed, a stratum in a task; where there is a larger one, controls are matched in blocks (`block_matches`). The frame's matched
    sessions are written when the plan is built.
    """
    slim = written(frame.filter("terminal_case is not null").select("stratum", "terminal_case", "pid", "session_id", F.col("session_index").cast("long").alias("session_index")))
    largest = slim.groupBy("stratum").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return stream_matches(slim) if largest <= block else block_matches(slim, block)


def block_matches(slim: DataFrame, block: int = MATCH_BLOCK) -> DataFrame:
    """The matches of `stream_matches`, with the controls of a stratum dealt in blocks.

    Control j meets case j - s, where s is how many controls were passed over before. It is passed over where that case is its player's,
    that is where s is one of the control's gaps: its place less that of a case of the same player. So a block of controls maps the s that it
    begins with to the one that it ends with, and changes only those among its gaps. All blocks' maps are made side by side; one pass over
    these numbers, in the blocks' order, gives each block its s; then all blocks are matched side by side.
    """
    ship(slim.sparkSession)
    rows = written(numbered(slim, ["stratum", "terminal_case"], ["session_index", "pid", "session_id"], "at"))
    cases, controls = (rows.filter(F.col("terminal_case") == k).drop("terminal_case") for k in (1, 0))
    own = cases.select("stratum", "pid", F.col("at").alias("case_at"))
    gaps = controls.join(own, ["stratum", "pid"]).select("stratum", "at", (F.col("at") - F.col("case_at")).alias("gap")).filter("gap >= 0")
    gaps = written(gaps.groupBy("stratum", "at").agg(F.collect_set("gap").alias("gaps")).withColumn("block", F.floor(F.col("at") / block)))  # the cases of one player

    def changes(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        to: dict[int, int] = {}
        for found in part.sort_values("at", ascending=False)["gaps"]:
            to |= {s: to.get(s + 1, s + 1) for s in map(int, found)}
        return pd.DataFrame({"stratum": key[0], "block": key[1], "s": list(to.keys()), "to": list(to.values())})

    maps = gaps.groupBy("stratum", "block").applyInPandas(changes, "stratum string, block long, s long, to long")
    every = controls.select("stratum", F.floor(F.col("at") / block).alias("block")).distinct().select("*", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("to"))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, now, after = None, 0, 0
        for part in parts:
            out = []
            for stratum, number, s, to in part.itertuples(index=False):
                if here is None or here[0] != stratum:
                    now = after = 0
                elif here[1] != number:
                    now = after
                if here != (stratum, number):
                    here = stratum, number
                    out.append((stratum, number, now))
                if s == now:
                    after = int(to)
            yield pd.DataFrame(out, columns=["stratum", "block", "begin"])

    ordered = maps.unionByName(every).repartition("stratum").sortWithinPartitions("stratum", "block", F.asc_nulls_first("s"))
    begin = written(ordered.mapInPandas(walk, "stratum string, block long, begin long"))

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        s, at, met = int(part["begin"].iloc[0]), [], []
        for j, found in zip(part["at"].tolist(), part["gaps"], strict=True):
            if found is not None and s in found:
                s += 1
            else:
                at.append(j)
                met.append(j - s)
        return pd.DataFrame({"stratum": key[0], "at": at, "case_at": met})

    places = controls.select("stratum", "at", F.floor(F.col("at") / block).alias("block")).join(gaps.drop("block"), ["stratum", "at"], "left").join(begin, ["stratum", "block"])
    met = places.groupBy("stratum", "block").applyInPandas(meet, "stratum string, at long, case_at long")
    side = lambda df, name, at: df.select("stratum", F.col("at").alias(at), *[F.col(c).alias(f"{name}_{c.removeprefix('session_') if c == 'session_index' else c}") for c in ("pid", "session_id", "session_index")])
    out = met.join(side(cases, "case", "case_at"), ["stratum", "case_at"]).join(side(controls, "control", "at"), ["stratum", "at"])
    return out.select("stratum", (F.col("case_at") + 1).alias("number"), *[c.split()[0] for c in MATCHES.split(", ")[2:]])


def stream_matches(slim: DataFrame) -> DataFrame:
    """A stratum is one task's work, read once in order: the k-th case comes before the k-th control, and cases that wait for a control are all
    that is held, as many as controls were passed over; cases behind the last control aren't.
    """
    ship(slim.sparkSession)
    w = Window.partitionBy("stratum", "terminal_case").orderBy("session_index", "pid", "session_id")
    slim = slim.repartition("stratum")
    ordered = slim.withColumn("number", F.row_number().over(w)).sortWithinPartitions("stratum", "number", F.desc("terminal_case")).drop("number")
    names = [c.split()[0] for c in MATCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = object()
        waiting: deque = deque()
        number = cases = controls = 0
        for batch in batches:
            out = []
            for stratum, case, pid, session, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stratum != here:
                    here, number, cases, controls = stratum, 0, 0, 0
                    waiting.clear()
                cases, controls = cases + case, controls + 1 - case
                if case:
                    if controls >= cases - 1:
                        waiting.append((pid, session, index))
                elif waiting and waiting[0][0] != pid:
                    case_pid, case_session, case_index = waiting.popleft()
                    number += 1
                    out.append((stratum, number, case_pid, case_session, pid, session, case_index, index))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("number", "case_index", "control_index") else pa.string()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return ordered.mapInArrow(run, MATCHES)


def rank_matches(frame: DataFrame) -> DataFrame:
    """The k-th case of a stratum with its k-th control: the same matches where no player is on both sides. Windows and a join only."""
    w = Window.partitionBy("stratum", "terminal_case").orderBy("session_index", "pid", "session_id")
    ranked = frame.filter("terminal_case is not null").select("stratum", "terminal_case", "pid", "session_id", "session_index", F.row_number().over(w).alias("number"))
    side = lambda k, name: ranked.filter(F.col("terminal_case") == k).select("stratum", "number", F.col("pid").alias(f"{name}_pid"), F.col("session_id").alias(f"{name}_session_id"), F.col("session_index").alias(f"{name}_index"))
    return side(1, "case").join(side(0, "control"), ["stratum", "number"])


def match_quality(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("matched_pairs"), F.count_distinct("stratum").alias("strata"), F.percentile(F.abs(F.col("case_index") - F.col("control_index")).cast("double"), F.lit(0.5)).alias("median_index_gap"))


def matched_rows(frame: DataFrame, matches: DataFrame) -> DataFrame:
    """The matched sessions' rows of the frame, a case and a control for each (stratum, number)."""
    side = lambda name: matches.select(F.col("stratum").alias("match_stratum"), "number", F.col(f"{name}_session_id").alias("session_id"))
    return frame.join(side("case").unionByName(side("control")), "session_id")


def paired_comparison(matched: DataFrame, conf: Config) -> DataFrame:
    """Mean slopes of cases and controls, and the mean of their differences with its standard error and normal p-value."""
    names = slope_columns(conf)
    long = matched.unpivot(["match_stratum", "number", "terminal_case"], names, "slope", "value")
    pairs = long.groupBy("slope", "match_stratum", "number").agg(F.max(F.when(F.col("terminal_case") == 1, F.col("value"))).alias("case"), F.max(F.when(F.col("terminal_case") == 0, F.col("value"))).alias("control"))
    pairs = pairs.filter("`case` is not null and control is not null").withColumn("gap", F.col("case") - F.col("control"))
    out = pairs.groupBy("slope").agg(F.count("*").alias("pairs"), F.avg("case").alias("case_mean"), F.avg("control").alias("control_mean"), F.avg("gap").alias("mean_gap"), (F.stddev_samp("gap") / F.sqrt(F.count("*"))).alias("se"))
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("mean_gap") / F.col("se")))
    return out.withColumn("p_value", two_sided_p(F.col("z")))


def two_sided_p(z: Column, steps: int = 2000) -> Column:
    """The normal chance of at least |z|: one minus the error function, by Simpson's rule; right to 1e-12."""
    x = F.least(F.abs(z) / math.sqrt(2), F.lit(10.0))
    weight = lambda k: F.when(k.isin(0, steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: weight(k) * F.exp(-F.pow(x * k / steps, F.lit(2.0)))), F.lit(0.0), lambda a, v: a + v)
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * x / (3 * steps) * area))


def normal_p(z: float | None) -> float | None:
    return None if z is None or not math.isfinite(z) else math.erfc(abs(z) / math.sqrt(2))
