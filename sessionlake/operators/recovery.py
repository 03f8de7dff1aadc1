"""What follows the focal state: paths, outcomes, relapse, and scans for thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions.columns import clip, days_between, month, quantile_bin, ratio
from sessionlake.functions.quantiles import around, between, values_at, with_quantiles
from sessionlake.functions.segments import coming, lead, least, scan, without_ranges
from sessionlake.operators.censoring import by_horizon, capped_gap, recovered_within
from sessionlake.operators.sequences import prior_exposure
from sessionlake.session import written


def exact_path(next_state: Column, conf: Config) -> Column:
    return F.coalesce(F.concat(F.lit(f"S{conf.focal_state}->S"), next_state.cast("string")), F.lit(f"S{conf.focal_state}->end"))


def broad_path(next_state: Column, conf: Config) -> Column:
    """As exact_path, with the recovery states in one."""
    joined = "/".join(f"S{s}" for s in conf.recovery_states)
    return F.when(next_state.isin(*conf.recovery_states), f"S{conf.focal_state}->{joined}").otherwise(exact_path(next_state, conf))


def followup(second: Column, conf: Config) -> Column:
    """Where the session after the recovery session leads."""
    joined = "/".join(f"S{s}" for s in conf.recovery_states)
    return (
        F.when(second.isNull(), "end_after_recovery_session")
        .when(second.isin(*conf.recovery_states), f"stays_in_{joined}")
        .when(second == conf.focal_state, f"returns_to_S{conf.focal_state}")
        .otherwise(F.concat(F.lit("moves_to_S"), second.cast("string")))
    )


def focal_origins(labels: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """Focal sessions with the states one to three sessions ahead, their paths, and how far along they are among the player's focal sessions."""
    ahead = {f"state_plus_{k}": lead(F.col("state_id"), k) for k in (1, 2, 3)}
    focal = F.col("state_id") == conf.focal_state
    rows = scan(labels, "pid", "login_time", ["session_index"], ahead | {"last focal": least(F.when(focal, -F.col("session_index")))}, hot)
    rows = without_ranges(rows).filter(focal)
    paths = {"path_exact": exact_path(F.col("next_state_id"), conf), "path_broad": broad_path(F.col("next_state_id"), conf), "position_in_focal": F.col("session_index") / -F.col("last focal")}
    return rows.withColumns(paths).drop("last focal")


def path_distribution(origins: DataFrame) -> DataFrame:
    n = F.count("*")
    out = origins.groupBy("path_broad", "path_exact").agg(
        n.alias("sessions"),
        F.count_distinct("pid").alias("players"),
        (F.count_if("is_window") / n).alias("window_share"),
        (F.count_if("is_purchase_anomaly") / n).alias("purchase_anomaly_share"),
    )
    out = with_quantiles(out, origins, ["path_broad", "path_exact"], {"median_duration_minutes": ("duration_minutes", 0.5), "median_next_gap_days": ("next_gap_days", 0.5), "median_position": ("position_in_focal", 0.5)})
    return out.withColumn("share", F.col("sessions") / F.sum("sessions").over(Window.partitionBy()))  # a row for each path


SUMMARY = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def number_summary(df: DataFrame, group: str, column: str, prefix: str) -> DataFrame:
    """Count, mean, quantiles and maximum of a column within each group."""
    out = df.groupBy(group).agg(F.count("*").alias("rows"), F.count(column).alias(f"{prefix}_n"), F.avg(column).alias(f"{prefix}_mean"), F.max(column).alias(f"{prefix}_max"))
    wanted = {f"{prefix}_{s}": (column, p) for s, p in SUMMARY.items()}
    return with_quantiles(out, df, [group], wanted).select(group, "rows", f"{prefix}_n", f"{prefix}_mean", *wanted, f"{prefix}_max")


def outcome_summary(df: DataFrame, group: str, conf: Config) -> DataFrame:
    """Sizes, medians and, for each horizon, evaluable, censored and disengaged sessions and risk of each group, in one aggregate."""
    n = F.count("*")
    wide = []
    for d in conf.horizons:
        ev, dis = F.count_if(f"evaluable_{d}d"), F.count_if(f"disengaged_{d}d")
        wide += [ev.alias(f"evaluable_{d}d"), F.count_if(f"censored_{d}d").alias(f"censored_{d}d"), dis.alias(f"disengaged_{d}d"), F.try_divide(dis.cast("double"), ev).alias(f"risk_{d}d")]
    out = df.groupBy(group).agg(n.alias("sessions"), F.count_distinct("pid").alias("players"), (F.count_if("is_window") / n).alias("window_share"), (F.count_if("is_purchase_anomaly") / n).alias("purchase_anomaly_share"), *wide)
    out = with_quantiles(out, df, [group], {"median_duration_minutes": ("duration_minutes", 0.5), "median_next_gap_days": ("next_gap_days", 0.5)})
    return out.withColumn("share", F.col("sessions") / F.sum("sessions").over(Window.partitionBy()))  # a row for each group


def destinations(labels: DataFrame, conf: Config) -> DataFrame:
    """Sessions that follow a focal one, with the path that led to them."""
    after = labels.filter(F.col("prev_state_id") == conf.focal_state)
    return after.withColumns({"path_exact": exact_path(F.col("state_id"), conf), "path_broad": broad_path(F.col("state_id"), conf)})


def recovery_followup(origins: DataFrame, conf: Config) -> DataFrame:
    """What comes after a recovery, as shares within its path and of all recoveries."""
    rec = origins.filter(F.col("next_state_id").isin(*conf.recovery_states)).withColumn("next_step", followup(F.col("state_plus_2"), conf))
    out = rec.groupBy("path_exact", "next_step").agg(F.count("*").alias("origins"), F.count_distinct("pid").alias("players"))
    out = with_quantiles(out, rec, ["path_exact", "next_step"], {"median_gap_days": ("next_gap_days", 0.5)})
    return out.withColumns({"share_within_path": F.col("origins") / F.sum("origins").over(Window.partitionBy("path_exact")), "share_of_all": F.col("origins") / F.sum("origins").over(Window.partitionBy())})  # a row for each step


def time_to_relapse(labels: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """For each recovery the first focal session after the one it led to: sessions and days from there. One scan, no join.

    Recovery states don't include the focal one, so the session that a recovery leads to isn't focal and the next focal one is the first after it.
    """
    focal = F.col("state_id") == conf.focal_state
    df = without_ranges(scan(labels, "pid", "login_time", ["session_index"], {"relapse": coming(F.when(focal, F.struct("session_index", "login_time")))}, hot))
    df = df.filter(focal & F.col("next_state_id").isin(*conf.recovery_states))
    return df.select(
        F.col("session_id").alias("origin_session_id"), "pid", "session_index", F.col("next_session_id").alias("destination_session_id"),
        exact_path(F.col("next_state_id"), conf).alias("path_exact"),
        (F.col("total_sessions") - F.col("session_index") - 1).alias("sessions_after_destination"),
        F.col("relapse").isNotNull().alias("relapses"),
        (F.col("relapse.session_index") - F.col("session_index") - 1).alias("sessions_until_relapse"),
        days_between("relapse.login_time", "next_login_time").alias("days_until_relapse"),
    )


def relapse_summary(relapse: DataFrame) -> DataFrame:
    base = relapse.groupBy("path_exact").agg(F.count_distinct("pid").alias("players"), F.count_if("relapses").alias("relapsed"), (F.count_if("relapses") / F.count("*")).alias("relapse_rate"))
    return base.join(number_summary(relapse, "path_exact", "sessions_until_relapse", "sessions"), "path_exact").join(number_summary(relapse, "path_exact", "days_until_relapse", "days").drop("rows"), "path_exact")


def player_footprint(labels: DataFrame, conf: Config) -> DataFrame:
    """How often each player who has focal sessions recovered, stayed or ended, and where in the sequence they lie."""
    focal, nxt = F.col("state_id") == conf.focal_state, F.col("next_state_id")
    index = F.when(focal, F.col("session_index"))
    out = labels.groupBy("pid").agg(
        F.count_if(focal).alias("focal_sessions"),
        F.count_if(focal & nxt.isin(*conf.recovery_states)).alias("recoveries"),
        F.count_if(focal & (nxt == conf.focal_state)).alias("persistences"),
        F.count_if(focal & nxt.isNull()).alias("terminal"),
        F.min(index).alias("first_focal_index"),
        F.max(index).alias("last_focal_index"),
        F.max("session_index").alias("total_sessions"),
    )
    return out.filter("focal_sessions > 0").withColumns({"has_recovery": F.col("recoveries") > 0, "has_persistence": F.col("persistences") > 0, "last_focal_position": F.col("last_focal_index") / F.col("total_sessions")})


# ---- The frame of focal sessions, and scans over it

#: Variable to when it is known: before the session, with its outcome, or only in hindsight. {d} is the horizon.
SCANNED = {
    "gap_before_days": "ex_ante",
    "gap_after_{d}d_capped": "outcome_proximal",
    "density_prev5": "ex_ante",
    "density_prev10": "ex_ante",
    "prior_focal_share": "ex_ante",
    "lifecycle_position": "descriptive_hindsight",
    "player_lifetime_days": "ex_ante",
    "prior_session_count": "ex_ante",
}


def log1p0(c: str) -> Column:
    return F.log1p(clip(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 0))


def focal_frame(labels: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """Focal sessions with exposure before them, recovery within each horizon after them, and the covariates of the curve model.

    Exposure is counted over all sessions before focal ones are picked.
    """
    df = prior_exposure(labels, conf, hot).withColumns({"lifecycle_position": F.col("session_index") / F.col("total_sessions"), "gap_before_days": clip(F.coalesce("days_since_previous_session", F.lit(0.0)), 0), "month": month(F.col("login_time"))})
    df = df.withColumns({"log_gap_before_days": F.log1p("gap_before_days"), "log_player_lifetime_days": log1p0("player_lifetime_days"), "log_prior_session_count": log1p0("prior_session_count"), "log_prior_focal_count": log1p0("prior_focal_count")})
    out = {}
    for d in conf.horizons:
        out |= {f"recovered_{d}d": recovered_within(conf, d), f"gap_after_{d}d_capped": capped_gap(d)}
    return df.filter(F.col("state_id") == conf.focal_state).withColumns(out)


def scan_rows(focal: DataFrame, conf: Config, d: int, variables: Sequence[str] | None = None) -> DataFrame:
    """pid, recovered, variable, value: evaluable focal sessions once for each scanned variable."""
    names = [v.format(d=d) for v in (variables or SCANNED)]
    return focal.filter(F.col(f"evaluable_{d}d")).select("pid", F.col(f"recovered_{d}d").alias("recovered"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["pid", "recovered"], names, "variable", "value").filter("value is not null")


def odds(p: Column, eps: float = 1e-9) -> Column:
    return (p + eps) / (1 - p + eps)


def _cuts(counted: DataFrame, key: Sequence[str], shares: Sequence[float]) -> dict[tuple, list[float]]:
    """The distinct quantiles of each key with more than one value. counted: key, value, n."""
    sizes = {tuple(r[c] for c in key): r.rows for r in counted.groupBy(*key).agg(F.sum("n").alias("rows"), F.count("*").alias("values")).filter("values > 1").collect()}
    ends = {k: [around(p, n) for p in shares] for k, n in sizes.items()}
    found = values_at(counted, key, {k: [at for lo, hi, _ in of for at in (lo, hi)] for k, of in ends.items()})
    return {k: list(dict.fromkeys(between(found[k][lo], found[k][hi], part) for lo, hi, part in of)) for k, of in ends.items()}


def threshold_scan(rows: DataFrame, conf: Config, cuts: Sequence[float] = tuple(k / 100 for k in range(10, 91, 5))) -> DataFrame:
    """Recovery below and from each distinct quantile cut of each variable on, where both sides have enough rows.

    One pass over the rows counts them, and their recoveries, by distinct value, and takes each player's least and greatest value:
    a player is below a cut if the least value is, and above it if the greatest is. These are written and cut into the stretches
    between cuts, whose running sums answer every cut. A variable of one value has no cuts. The pass runs when the plan is built.
    """
    hits = F.sum(F.col("recovered").cast("long"))
    sets = [[F.col("variable"), F.col("value")], [F.col("variable"), F.col("pid")]]
    both = rows.groupingSets(sets, "variable", "value", "pid").agg(F.grouping("value").alias("of_player"), F.count("*").alias("n"), hits.alias("hits"), F.min(F.col("value") + 0.0).alias("least"), F.max(F.col("value") + 0.0).alias("most"))
    both = written(both.select("variable", "of_player", "n", "hits", "least", "most"))
    counted = both.filter("of_player = 0").select("variable", F.col("least").alias("value"), "n", "hits")
    found = _cuts(counted.drop("hits"), ["variable"], cuts)
    points = rows.sparkSession.createDataFrame([(k[0], c) for k, c in found.items()], "variable string, cuts array<double>")
    cell = lambda v: F.size(F.filter("cuts", lambda c: c <= F.col(v)))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    kinds = ("cell", "n", "hits", "first", "last")
    row = lambda *v: F.struct(*[c.alias(k) for k, c in zip(kinds, v, strict=True)])
    of_value = F.array(row(cell("least"), F.col("n"), F.col("hits"), zero, zero))
    of_player = F.array(row(cell("least"), zero, zero, one, zero), row(cell("most"), zero, zero, zero, one))
    cells = both.join(F.broadcast(points), "variable").select("variable", F.inline(F.when(F.col("of_player") == 0, of_value).otherwise(of_player)))  # a row for each variable
    cells = cells.groupBy("variable", "cell").agg(*[F.sum(k).alias(k) for k in kinds[1:]])
    tries = points.select("variable", F.posexplode("cuts").alias("at", "threshold"))
    low = F.col("cell") <= F.col("at")
    side = lambda k, where: F.coalesce(F.sum(F.when(where, F.col(k))), zero)
    # At most 18 stretches and 17 cuts a variable.
    out = cells.join(F.broadcast(tries), "variable").groupBy("variable", "threshold").agg(
        side("n", low).alias("n_low"), side("n", ~low).alias("n_high"), side("first", low).alias("players_low"), side("last", ~low).alias("players_high"), side("hits", low).alias("hits_low"), side("hits", ~low).alias("hits_high"),
    )
    out = out.filter((F.col("n_low") >= conf.min_side) & (F.col("n_high") >= conf.min_side))
    out = out.select("variable", "threshold", "n_low", "n_high", "players_low", "players_high", ratio(F.col("hits_low"), F.col("n_low")).alias("rate_low"), ratio(F.col("hits_high"), F.col("n_high")).alias("rate_high"))
    return out.withColumns({"drop": F.col("rate_low") - F.col("rate_high"), "odds_ratio": odds(F.col("rate_high")) / odds(F.col("rate_low"))})


def best_thresholds(scan: DataFrame) -> DataFrame:
    """The cut with the largest drop for each variable, ties to the smaller cut."""
    w = Window.partitionBy("variable").orderBy(F.col("drop").desc(), "threshold")
    return scan.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def threshold_stability(focal: DataFrame, best: DataFrame, conf: Config) -> DataFrame:
    """The cuts chosen at the longest horizon tried again at every horizon, with and without the window's sessions.

    One pass: a row for each session, horizon and exclusion it belongs to, and variable.
    """
    names = [v.format(d=conf.long_horizon) for v in SCANNED]
    tried = [F.struct(F.lit(d).alias("horizon_days"), F.lit(out).alias("without_window"), F.col(f"recovered_{d}d").alias("recovered"), (F.col(f"evaluable_{d}d") & ~(F.lit(out) & F.col("is_window"))).alias("inside")) for d in conf.horizons for out in (False, True)]
    rows = focal.select(*[F.col(n).cast("double").alias(n) for n in names], F.inline(F.array(*tried))).filter("inside")
    rows = rows.unpivot(["horizon_days", "without_window", "recovered"], names, "variable", "value").filter("value is not null")
    rows = rows.join(F.broadcast(best.select("variable", "threshold")), "variable")  # a row for each variable
    low = F.col("value") < F.col("threshold")
    rate = lambda side: F.avg(F.when(side, F.col("recovered").cast("double")))
    out = rows.groupBy("horizon_days", "without_window", "variable", "threshold").agg(F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"), rate(low).alias("rate_low"), rate(~low).alias("rate_high"))
    out = out.filter((F.col("n_low") >= conf.min_side) & (F.col("n_high") >= conf.min_side))
    return out.withColumns({"drop": F.col("rate_low") - F.col("rate_high"), "odds_ratio": odds(F.col("rate_high")) / odds(F.col("rate_low"))})


def quantile_bins(rows: DataFrame, bins: int = 8) -> DataFrame:
    """Recovery in quantile bins of each variable: right-closed, the first with the least value, repeated edges once.

    Rows are counted by distinct value once; edges, sums and medians are read from these counts, and only players are counted over the rows again.
    The first pass and those for edges and medians run when the plan is built.
    """
    counted = written(rows.groupBy("variable", "value").agg(F.count("*").alias("n"), F.sum(F.col("recovered").cast("long")).alias("hits")))
    found = _cuts(counted, ["variable"], [k / bins for k in range(bins + 1)])
    edges = F.broadcast(rows.sparkSession.createDataFrame([(k[0], c) for k, c in found.items()], "variable string, edges array<double>"))  # a row for each variable
    binned = counted.join(edges, "variable").select("variable", quantile_bin(F.col("value"), F.col("edges")).alias("bin"), "value", "n", "hits")
    sums = binned.groupBy("variable", "bin").agg(F.sum("n").alias("sessions"), F.min("value").alias("value_min"), F.max("value").alias("value_max"), (F.sum("hits") / F.sum("n")).alias("recovery_rate"))
    sizes = {(r.variable, r.bin): around(0.5, r.sessions) for r in sums.select("variable", "bin", "sessions").collect()}  # a row for each bin
    at = values_at(binned.select("variable", "bin", "value", "n"), ["variable", "bin"], {k: v[:2] for k, v in sizes.items()})
    medians = rows.sparkSession.createDataFrame([(*k, between(at[k][lo], at[k][hi], part)) for k, (lo, hi, part) in sizes.items()], "variable string, bin int, value_median double")
    players = rows.join(edges, "variable").groupBy("variable", quantile_bin(F.col("value"), F.col("edges")).alias("bin")).agg(F.count_distinct("pid").alias("players"))
    out = sums.join(F.broadcast(medians), ["variable", "bin"]).join(players, ["variable", "bin"])
    return out.select("variable", "bin", "sessions", "players", "value_min", "value_max", "recovery_rate", "value_median")


def unadjusted_path_risk(labels: DataFrame, conf: Config) -> DataFrame:
    """Recovered against persisting destinations, at each horizon."""
    dest = destinations(labels, conf).filter(F.col("state_id").isin(*conf.recovery_states, conf.focal_state))
    long = by_horizon(dest, conf, ["path_broad", "pid", "duration_minutes", "next_gap_days"]).filter("evaluable")
    out = long.groupBy("horizon_days", "path_broad").agg(F.count("*").alias("sessions"), F.count_distinct("pid").alias("players"), F.count_if("disengaged").alias("events"), ratio(F.count_if("disengaged"), F.count("*")).alias("risk"))
    return with_quantiles(out, long, ["horizon_days", "path_broad"], {"median_duration_minutes": ("duration_minutes", 0.5), "median_next_gap_days": ("next_gap_days", 0.5)})
