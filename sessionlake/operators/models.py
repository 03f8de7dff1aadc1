"""The model families: which sessions, outcome, terms and clusters go into each fit."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions.columns import clip, month
from sessionlake.operators.recovery import broad_path, log1p0
from sessionlake.operators.regression import CURVE_CONTINUOUS, CURVE_CONTROLS, SPLINE, Design, Fit, coefficients, curve, fit_design, fit_designs, linear_many, logistic_many, with_spline
from sessionlake.operators.rigidity import slope_columns
from sessionlake.operators.sequences import prior_exposure
from sessionlake.session import held
from sessionlake.sources.files import union_by_name

FOCAL_MOVES = ((1, 4), (2, 4), (3, 4))
DISENGAGEMENT = ("focal_persistence", *[f"state_s{s}" for s in range(1, 5)], *[f"prev_s{s}" for s in range(1, 5)], *[f"s{a}_to_s{b}" for a, b in FOCAL_MOVES], "first_session", "log_duration_minutes", "log_gap_days", "log_player_lifetime_days", "log_prior_session_count", "log_prior_focal_count", "completion_ratio", "exit_ratio", "mode_diversity", "is_window", "is_purchase_anomaly")
DISENGAGEMENT_CONTINUOUS = ("log_duration_minutes", "log_gap_days", "log_player_lifetime_days", "log_prior_session_count", "log_prior_focal_count", "completion_ratio", "exit_ratio", "mode_diversity")
PATH = ("recovery_path", "log_gap_days", "log_player_lifetime_days", "log_prior_session_count", "log_prior_focal_count", "prior_focal_share", "is_window")
PATH_CONTINUOUS = PATH[1:-1]
NARROWING = ("terminal_case", "log_session_index", "log_player_lifetime_days", "log_prior_session_count", "log_prior_focal_count", "prior_focal_share")


def _covariates(labels: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    df = prior_exposure(labels, conf, hot)
    return df.withColumns(
        {
            "month": month(F.col("login_time")),
            "log_duration_minutes": log1p0("duration_minutes"),
            "log_gap_days": log1p0("days_since_previous_session"),
            "log_player_lifetime_days": log1p0("player_lifetime_days"),
            "log_prior_session_count": log1p0("prior_session_count"),
            "log_prior_focal_count": log1p0("prior_focal_count"),
            "completion_ratio": F.coalesce(clip(F.col("job_completion_ratio"), 0, 1), F.lit(0.0)),
            "exit_ratio": F.coalesce(clip(F.col("job_exit_ratio"), 0, 1), F.lit(0.0)),
            "mode_diversity": F.coalesce("mode_diversity", F.lit(0)),
        }
    )


def disengagement_frame(labels: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """All sessions with the covariates of the disengagement models; lags and exposure are over all sessions, before any is left out."""
    prev = F.coalesce("prev_state_id", F.lit(-1))
    now = F.col("state_id")
    out = {"first_session": (F.col("session_index") == 1).cast("int"), "focal_persistence": ((prev == conf.focal_state) & (now == conf.focal_state)).cast("int")}
    for s in range(1, 5):
        out |= {f"state_s{s}": (now == s).cast("int"), f"prev_s{s}": (prev == s).cast("int")}
    for a, b in FOCAL_MOVES:
        out[f"s{a}_to_s{b}"] = ((prev == a) & (now == b)).cast("int")
    return _covariates(labels, conf, hot).withColumns(out)


def path_frame(labels: DataFrame, conf: Config, hot: DataFrame | None = None) -> DataFrame:
    """Sessions after a focal one that recovered or stayed, with the same covariates."""
    df = _covariates(labels, conf, hot)
    keep = (F.col("prev_state_id") == conf.focal_state) & F.col("state_id").isin(*conf.recovery_states, conf.focal_state)
    return df.filter(keep).withColumns({"recovery_path": F.col("state_id").isin(*conf.recovery_states).cast("int"), "path_label": broad_path(F.col("state_id"), conf)})


def analyses(conf: Config) -> list[tuple[str, int, bool]]:
    """Every horizon, and the longest without the window."""
    return [*[(f"{d}d", d, False) for d in conf.horizons], (f"{conf.long_horizon}d_without_window", conf.long_horizon, True)]


def sample(frame: DataFrame, d: int, leave_out: bool) -> DataFrame:
    df = frame.filter(F.col(f"evaluable_{d}d"))
    return df.filter(~F.col("is_window")) if leave_out else df


def _together(rows: DataFrame, designs: dict[str, Design], outcomes: dict[str, str], cluster: str, model: str) -> DataFrame:
    """model, y, cluster, x of rows that name their model, each by its own design."""
    longest = max(len(d.names) for d in designs.values())
    y = x = F.lit(None)
    for name, d in designs.items():
        here = F.col(model) == name
        y, x = F.when(here, F.col(outcomes[name]).cast("double")).otherwise(y), F.when(here, d.vector(longest)).otherwise(x)
    return rows.filter(F.col(model).isin(*designs)).select(F.col(model).alias("model"), y.alias("y"), F.col(cluster).cast("string").alias("cluster"), x.alias("x"))


def fit_family(frame: DataFrame, conf: Config, terms: tuple[str, ...], continuous: tuple[str, ...], outcome: str = "disengaged_{d}d") -> DataFrame:
    """Coefficients of the family's logistic models, clustered by player. A session is a row for each analysis it belongs to; all models are fitted together."""
    inside = F.array(*[F.when(F.col(f"evaluable_{d}d") & (~F.col("is_window") if leave_out else F.lit(True)), F.lit(name)) for name, d, leave_out in analyses(conf)])
    outcomes = {name: outcome.format(d=d) for name, d, _ in analyses(conf)}
    needed = list(dict.fromkeys(["pid", "month", *terms, *outcomes.values()]))
    rows = frame.select(F.explode(F.filter(inside, lambda a: a.isNotNull())).alias("analysis"), *needed)
    with held(rows) as rows:
        designs = fit_designs(rows, "analysis", terms, continuous, ["month"])
        fits = logistic_many(_together(rows, designs, outcomes, "pid", "analysis"), {name: len(d.names) for name, d in designs.items()}) if designs else {}
    return _all_coefficients(frame, {name: (designs[name].names, fits[name]) for name, *_ in analyses(conf) if name in fits})


def _all_coefficients(frame: DataFrame, fits: dict[str, tuple[list[str], Fit]]) -> DataFrame:
    parts = [coefficients(frame, names, fit, name) for name, (names, fit) in fits.items()] or [coefficients(frame, [], Fit(np.zeros(0), np.zeros((0, 0)), 0), "")]
    return union_by_name(parts)


def threshold_family(focal: DataFrame, best: DataFrame, conf: Config) -> DataFrame:
    """Recovery on indicators of lying at or above the chosen cuts, which were chosen on the same sample."""
    cuts = {r.variable: r.threshold for r in best.collect()}  # a row for each variable
    names = [v for v in ("gap_before_days", "density_prev5", "prior_focal_share", "prior_session_count") if v in cuts]  # known before the session
    frame = focal.withColumns({f"high_{v}": (F.col(v) >= F.lit(cuts[v])).cast("int") for v in names})
    return fit_family(frame, conf, (*[f"high_{v}" for v in names], *CURVE_CONTROLS), CURVE_CONTINUOUS, "recovered_{d}d")


def curve_models(focal: DataFrame, conf: Config) -> tuple[DataFrame, dict[str, tuple[Design, Fit]]]:
    """The spline and the linear model of recovery at the longest horizon, and their coefficients."""
    d = conf.long_horizon
    kinds = {"spline": SPLINE, "linear": SPLINE[:1]}
    terms = (*SPLINE, *CURVE_CONTROLS)
    df = with_spline(focal.filter(F.col(f"evaluable_{d}d"))).select("pid", "month", *terms, f"recovered_{d}d")
    with held(df) as df:
        whole = fit_design(df, terms, CURVE_CONTINUOUS, ["month"])
        designs = {name: replace(whole, terms=tuple(c for c in whole.terms if c not in SPLINE or c in density)) for name, density in kinds.items()}
        rows = df.select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
        found = logistic_many(_together(rows, designs, dict.fromkeys(kinds, f"recovered_{d}d"), "pid", "kind"), {name: len(d.names) for name, d in designs.items()}, max_iter=100)
    fits = {name: (designs[name], found[name]) for name in kinds}
    return _all_coefficients(focal, {name: (design.names, fit) for name, (design, fit) in fits.items()}), fits


def recovery_curve(focal: DataFrame, conf: Config, at_month: str | None = None) -> DataFrame:
    design, fit = curve_models(focal, conf)[1]["spline"]
    return curve(focal.filter(F.col(f"evaluable_{conf.long_horizon}d")), design, fit, at_month)


def narrowing_models(matched: DataFrame, conf: Config) -> DataFrame:
    """Each slope of matched cases and controls on being a case, clustered by match."""
    slopes = slope_columns(conf)
    df = matched.select(F.concat_ws("|", "match_stratum", "number").alias("match"), "month", "state_id", *NARROWING, *slopes)
    with held(df) as df:
        design = fit_design(df, NARROWING, NARROWING[1:], ["month", "state_id"])
        rows = df.select("*", F.explode(F.array(*map(F.lit, slopes))).alias("slope"))
        found = linear_many(_together(rows, dict.fromkeys(slopes, design), {c: c for c in slopes}, "match", "slope"), dict.fromkeys(slopes, len(design.names)))
    return _all_coefficients(matched, {c: (design.names, found[c]) for c in slopes})
