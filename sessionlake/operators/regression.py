"""Logistic and linear models with cluster-robust errors, from distributed Gram sums.

A design is a table of rows (y, cluster, x array<double>). A family of models is fitted at once, from rows that name their model: each
step is one scan that adds up X'WX and X'(y - mu) of all models that haven't settled, within partitions and then on executors, and brings
one p-by-p matrix a model to the driver; the sandwich's middle adds scores up by cluster first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import spline_basis
from sessionlake.functions.quantiles import exact_quantiles
from sessionlake.operators.rigidity import normal_p
from sessionlake.session import held, ship


@dataclass(frozen=True)
class Design:
    """How rows become numbers: terms, one-hot levels with the first left out, and stored means and deviations."""

    terms: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]
    standard: dict[str, tuple[float, float]]

    @property
    def names(self) -> list[str]:
        return ["intercept", *self.terms, *[f"{c}_{v}" for c, vs in self.levels.items() for v in vs]]

    def columns(self) -> list[Column]:
        def term(c: str) -> Column:
            x = F.col(c).cast("double")
            if c in self.standard:
                m, s = self.standard[c]
                x = (x - F.lit(m)) / F.lit(s)
            return x

        return [F.lit(1.0), *map(term, self.terms), *[(F.col(c).cast("string") == v).cast("double") for c, vs in self.levels.items() for v in vs]]

    def vector(self, length: int) -> Column:
        """A row's numbers, with noughts behind them up to a length."""
        return F.array(*self.columns(), *[F.lit(0.0)] * (length - len(self.names)))

    def rows(self, df: DataFrame, y: str, cluster: str) -> DataFrame:
        return df.select(F.col(y).cast("double").alias("y"), F.col(cluster).cast("string").alias("cluster"), F.array(*self.columns()).alias("x"))


MOST_LEVELS = 1000


def fit_designs(df: DataFrame, model: str, terms: Sequence[str], continuous: Sequence[str], one_hot: Sequence[str] = ()) -> dict[str, Design]:
    """A design for each value of the column `model`. Drops terms and levels without variance, and standardises continuous terms: one aggregate for all.

    A column of more than MOST_LEVELS levels is refused.
    """
    measures = [f(F.col(c).cast("double")).alias(f"{n} {c}") for c in terms for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("sd", F.stddev_samp))]
    hot = {c: f"level {k}" for k, c in enumerate(one_hot)}
    df = df.select(F.col(model).alias("model"), *terms, *[F.col(c).cast("string").alias(name) for c, name in hot.items()])
    sets = [["model"], *[["model", name] for name in hot.values()]]
    grouped = df.groupingSets([[F.col(c) for c in cs] for cs in sets], *[F.col(c) for c in ("model", *hot.values())])
    kind = [(F.grouping(name) == 0).alias(f"is {name}") for name in hot.values()]
    rows = grouped.agg(*kind, *measures).limit(10 * (MOST_LEVELS + 1)).collect()  # a row for each model, and for each of its levels
    stats = {r.model: r for r in rows if not any(r[f"is {name}"] for name in hot.values())}
    out = {}
    for m, r in stats.items():
        kept = tuple(c for c in terms if r[f"lo {c}"] is not None and r[f"lo {c}"] != r[f"hi {c}"])
        standard = {c: (r[f"mean {c}"], r[f"sd {c}"]) for c in kept if c in continuous and r[f"sd {c}"]}
        levels = {c: tuple(sorted(x[name] for x in rows if x.model == m and x[f"is {name}"] and x[name] is not None))[1:] for c, name in hot.items()}
        for c, found in levels.items():
            if len(found) >= MOST_LEVELS or len(rows) == 10 * (MOST_LEVELS + 1):
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
        out[m] = Design(kept, levels, standard)
    return out


def fit_design(df: DataFrame, terms: Sequence[str], continuous: Sequence[str], one_hot: Sequence[str] = ()) -> Design:
    """The design of one model; of no rows, one without terms."""
    return fit_designs(df.withColumn("the model", F.lit("")), "the model", terms, continuous, one_hot).get("", Design((), {c: () for c in one_hot}, {}))


def _grams(rows: DataFrame, betas: dict[str, np.ndarray], logistic: bool) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(X'WX, X'r) of each model: mu and weights of the logistic, or 1 and y - Xb of the linear model. rows: model, y, x of at least the model's length."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            every = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            names, ys = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False)
            for m, beta in betas.items():
                here = names == m
                if here.any():
                    x = every[here, : len(beta)]
                    y, mu, w = _mean(x, ys[here], beta, logistic)
                    both = np.concatenate([((x.T * w) @ x).ravel(), x.T @ (y - mu)])
                    sums[m] = sums[m] + both if m in sums else both
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["model", "cells"])

    some = rows.filter(F.col("model").isin(*betas)).select("model", "y", "x")
    cells = some.mapInArrow(run, "model string, cells array<double>").select("model", F.posexplode("cells").alias("cell", "v"))
    total = {m: np.zeros(len(b) * (len(b) + 1)) for m, b in betas.items()}
    for r in cells.groupBy("model", "cell").agg(F.sum("v").alias("v")).collect():  # p * (p + 1) numbers a model, however many partitions
        total[r.model][r.cell] = r.v
    return {m: (total[m][: len(b) ** 2].reshape(len(b), -1), total[m][len(b) ** 2 :]) for m, b in betas.items()}


def _mean(x: np.ndarray, y: np.ndarray, beta: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    eta = x @ beta
    if not logistic:
        return y, eta, np.ones(len(y))
    mu = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
    return y, mu, np.maximum(mu * (1 - mu), 1e-8)


def _meats(rows: DataFrame, betas: dict[str, np.ndarray], logistic: bool) -> dict[str, np.ndarray]:
    """For each model the sum over clusters of the outer product of their summed scores."""
    p = max(map(len, betas.values()))
    table = rows.sparkSession.createDataFrame([(m, [*map(float, b), *[0.0] * (p - len(b))]) for m, b in betas.items()], "model string, beta array<double>")
    rows = rows.join(F.broadcast(table), "model")  # a row for each model
    eta = F.aggregate(F.zip_with(F.slice("x", 1, p), "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta)))) if logistic else eta
    scores = rows.withColumn("r", F.col("y") - mu).groupBy("model", "cluster").agg(*[F.sum(F.col("x")[i] * F.col("r")).alias(f"s{i}") for i in range(p)])
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    out = {m: np.zeros((p, p)) for m in betas}
    for row in scores.groupBy("model").agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in cells]).collect():
        for i, j in cells:
            out[row.model][i, j] = out[row.model][j, i] = row[f"m{i}_{j}"] or 0.0
    return {m: out[m][: len(b), : len(b)] for m, b in betas.items()}


@dataclass(frozen=True)
class Fit:
    beta: np.ndarray
    covariance: np.ndarray
    iterations: int

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0))


def _ridge(p: int, size: float) -> np.ndarray:
    out = np.eye(p) * size
    out[0, 0] = 0.0
    return out


def logistic_many(rows: DataFrame, sizes: dict[str, int], ridge: float = 1e-6, max_iter: int = 80, tol: float = 1e-7) -> dict[str, Fit]:
    """Newton steps from 0 for all models at once; a model whose step doesn't exceed tol takes no further part. The intercept has no ridge.

    rows: model, y, cluster, x, as long for all models as the longest; sizes: the columns of x that belong to each model. No correction
    for few clusters. There are as many scans as the slowest model has steps, and two.
    """
    with held(rows) as rows:
        betas, penalty, steps = {m: np.zeros(p) for m, p in sizes.items()}, {m: _ridge(p, ridge) for m, p in sizes.items()}, dict.fromkeys(sizes, 0)
        active = set(sizes)
        for k in range(1, max_iter + 1):
            for m, (gram, score) in _grams(rows, {m: betas[m] for m in sizes if m in active}, True).items():
                step = np.linalg.solve(gram + penalty[m], score - penalty[m] @ betas[m])
                betas[m], steps[m] = betas[m] + step, k
                if np.abs(step).max() < tol:
                    active.discard(m)
            if not active:
                break
        meats, out = _meats(rows, betas, True), {}
        for m, (gram, _) in _grams(rows, betas, True).items():
            bread = np.linalg.inv(gram + penalty[m])
            out[m] = Fit(betas[m], bread @ meats[m] @ bread, steps[m])
        return out


def linear_many(rows: DataFrame, sizes: dict[str, int], ridge: float = 1e-8) -> dict[str, Fit]:
    """One solve for each model, with cluster-robust errors: two scans for all."""
    with held(rows) as rows:
        totals = {m: (gram + _ridge(len(gram), ridge), xy) for m, (gram, xy) in _grams(rows, {m: np.zeros(p) for m, p in sizes.items()}, False).items()}
        betas = {m: np.linalg.solve(total, xy) for m, (total, xy) in totals.items()}
        meats = _meats(rows, betas, False)
        return {m: Fit(betas[m], (bread := np.linalg.inv(total)) @ meats[m] @ bread, 1) for m, (total, _) in totals.items()}


def logistic(rows: DataFrame, p: int, ridge: float = 1e-6, max_iter: int = 80, tol: float = 1e-7) -> Fit:
    return logistic_many(rows.withColumn("model", F.lit("")), {"": p}, ridge, max_iter, tol)[""]


def linear(rows: DataFrame, p: int, ridge: float = 1e-8) -> Fit:
    return linear_many(rows.withColumn("model", F.lit("")), {"": p}, ridge)[""]


def coefficients(df: DataFrame, names: Sequence[str], fit: Fit, analysis: str) -> DataFrame:
    """term, coefficient, error, z, p, odds ratio and its 95 % limits."""
    out = []
    for name, b, s in zip(names, fit.beta, fit.se, strict=True):
        z = b / s if s > 0 else None
        up = lambda v: float(math.exp(min(700.0, v)))
        out.append((analysis, name, float(b), float(s), None if z is None else float(z), normal_p(z), up(b), up(b - 1.96 * s), up(b + 1.96 * s)))
    return df.sparkSession.createDataFrame(out, "analysis string, term string, coefficient double, robust_se double, z double, p_value double, odds_ratio double, ci_low double, ci_high double")


def sample_summary(df: DataFrame, y: str, analysis: str, focal: Column | None = None) -> DataFrame:
    """One row: rows, players and events of a model's sample, and of its focal rows."""
    event = F.col(y).cast("boolean")
    hit = F.coalesce(focal, F.lit(False)) if focal is not None else F.lit(False)
    return df.agg(F.count("*").alias("sessions"), F.count_distinct("pid").alias("players"), F.count_if(event).alias("events"), F.try_divide(F.count_if(event).cast("double"), F.count("*")).alias("event_rate"), F.count_if(hit).alias("focal_sessions"), F.try_divide(F.count_if(hit & event).cast("double"), F.count_if(hit)).alias("focal_risk")).select(F.lit(analysis).alias("analysis"), "*")


def predicted_mean(rows: DataFrame, fit: Fit) -> float:
    eta = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in fit.beta]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.agg(F.avg(F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))).first()[0]


# ---- The recovery curve

KNOTS = (0.0, 0.2, 0.5, 1.0)
SPLINE = ("density_linear", "density_rcs1", "density_rcs2")
CURVE_CONTROLS = ("log_gap_before_days", "log_player_lifetime_days", "log_prior_session_count", "log_prior_focal_count", "prior_focal_share", "is_window")
CURVE_CONTINUOUS = CURVE_CONTROLS[:-1]


def with_spline(df: DataFrame, density: str = "density_prev5", knots: Sequence[float] = KNOTS) -> DataFrame:
    return df.withColumns(dict(zip(SPLINE, spline_basis(F.col(density), knots), strict=True)))


def curve(focal: DataFrame, design: Design, fit: Fit, at_month: str | None = None, points: int = 101) -> DataFrame:
    """Recovery over densities 0 to 1 with controls at their medians, with 95 % limits by the delta method.

    By default the curve stands at the earliest month, the level that is left out; at_month sets another.
    """
    controls = [c for c in design.terms if c not in SPLINE]
    med = {c: q[0] for c, q in exact_quantiles(focal, {c: [0.5] for c in controls if c != "is_window"}).items()}
    grid = np.linspace(0, 1, points)
    x = np.zeros((points, len(design.names)))
    x[:, 0] = 1.0
    cube = lambda k: np.maximum(grid - k, 0) ** 3
    last, before = KNOTS[-1], KNOTS[-2]
    values = {"density_linear": grid}
    for i, k in enumerate(KNOTS[:-2]):
        values[SPLINE[i + 1]] = cube(k) - cube(before) * (last - k) / (last - before) + cube(last) * (before - k) / (last - before)
    for i, c in enumerate(design.names[1 : 1 + len(design.terms)]):
        v = values.get(c, 0.0 if c == "is_window" else med[c] if c in controls else 0.0)
        m, s = design.standard.get(c, (0.0, 1.0))
        x[:, i + 1] = (v - m) / s
    for c, vs in design.levels.items():
        for v in vs:
            x[:, design.names.index(f"{c}_{v}")] = float(c == "month" and v == at_month)
    eta, se = x @ fit.beta, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, fit.covariance, x), 0))
    p = lambda e: 1 / (1 + np.exp(-np.clip(e, -35, 35)))
    rows = [tuple(map(float, r)) for r in zip(grid, p(eta), p(eta - 1.96 * se), p(eta + 1.96 * se), strict=True)]
    return focal.sparkSession.createDataFrame(rows, "density double, recovery double, low double, high double")
