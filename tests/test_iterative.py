"""Registered queries without a SQL counterpart, at the smallest size, against NumPy on the query's own frame."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import clusters, features, models, recovery, regression, rigidity, starts
from sessionlake.plans.frames import Frames
from sessionlake.plans.queries import QUERIES
from tests.conftest import SMALL

LARGER = "/root/testdata/sf0.01"  # where the smallest size has too few sessions for a model


@pytest.fixture
def frames(spark):
    yield Frames(spark, SMALL)
    spark.catalog.clearCache()


@pytest.fixture
def larger(spark):
    yield Frames(spark, LARGER)
    spark.catalog.clearCache()


def close(a, b, digits=1e-5):
    return a == pytest.approx(b, rel=digits, abs=digits)


# ---- Principal components


def test_components(spark, frames):
    z = clusters.zscored(frames.discovery, "session_id", features.DISCOVERY).toPandas().set_index("session_id")
    x = z[list(features.DISCOVERY)].to_numpy()
    assert np.abs(x.mean(axis=0)).max() < 1e-9
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    values = s**2 / (len(x) - 1)
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    rows = QUERIES["pca_variance"](spark, SMALL).collect()
    assert [r.component for r in rows] == [f"PC{k + 1}" for k in range(len(values))]
    assert [r.eigenvalue for r in rows] == pytest.approx(list(values), abs=1e-5)
    assert [r.cumulative for r in rows] == pytest.approx(list((values / values.sum()).cumsum()), abs=1e-5)

    for r in QUERIES["pca_top_loadings"](spark, SMALL).collect():
        k = int(r.component[2:]) - 1
        if (np.abs(np.delete(values, k) - values[k]) < 1e-6).any():
            continue  # components of equal eigenvalues aren't determined
        order = sorted(vt[k], reverse=r.side == "positive")
        assert r.loading == pytest.approx(order[r.rank - 1], abs=1e-5)
        assert r.loading == pytest.approx(vt[k, features.DISCOVERY.index(r.feature)], abs=1e-5)

    scores = {r.session_id: r for r in QUERIES["pca_scores"](spark, SMALL).collect()}
    assert set(scores) == set(z.index)
    for key, row in zip(z.index, x, strict=True):
        assert [scores[key][f"PC{k + 1}"] for k in range(6)] == pytest.approx(list(vt[:6] @ row), abs=1e-4)


# ---- k-means and mixtures


def numpy_lloyd(x, centers, max_iter, tol=1e-6):
    """Centres after the last step, and sizes, variances and inertia of the labels before it."""
    last = None
    for _ in range(max_iter):
        d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        label, inertia = d.argmin(axis=1), d.min(axis=1).sum()
        new = np.array([x[label == k].mean(axis=0) if (label == k).any() else centers[k] for k in range(len(centers))])
        var = np.array([x[label == k].var(axis=0) if (label == k).any() else np.zeros(x.shape[1]) for k in range(len(centers))])
        sizes, centers = np.bincount(label, minlength=len(centers)), new
        if last is not None and abs(last - inertia) <= tol * max(1.0, inertia):
            break
        last = inertia
    return centers, sizes, var, inertia


def joint(x, w, mean, var):
    return np.log(w + 1e-15) - 0.5 * (np.log(2 * math.pi * var)[None] + (x[:, None] - mean[None]) ** 2 / var[None]).sum(axis=2)


def numpy_em(x, w, mean, var, max_iter, tol=1e-5, floor=1e-6):
    last = None
    for _ in range(max_iter):
        logs = joint(x, w, mean, var)
        norm = np.logaddexp.reduce(logs, axis=1)
        r = np.exp(logs - norm[:, None])
        mass = r.sum(axis=0) + 1e-12
        w, mean = mass / len(x), (r.T @ x) / mass[:, None]
        var = np.array([(r[:, k, None] * (x - mean[k]) ** 2).sum(axis=0) / mass[k] for k in range(len(w))]) + floor
        if last is not None and abs(norm.sum() - last) <= tol * max(1.0, abs(last)):
            break
        last = norm.sum()
    return w, mean, var, norm.sum()


def vectors(pts):
    return np.array([r.x for r in pts.collect()])


def test_kmeans_fit(spark, frames):
    pts = frames.embedding_points
    jobs = [starts.Job(5, starts.restart_seed(42, 5, r)) for r in range(8)]
    x = vectors(pts)
    best = min((numpy_lloyd(x, c, 120) for c in starts.seeds(starts.hashed(pts), jobs)), key=lambda f: f[3])
    d = ((x[:, None] - best[0][None]) ** 2).sum(axis=2)
    label = d.argmin(axis=1)
    want = {k: (int((label == k).sum()), d.min(axis=1)[label == k].sum()) for k in range(5) if (label == k).any()}
    got = {r.label: (r["size"], r.inertia) for r in QUERIES["kmeans_fit"](spark, SMALL).collect()}
    assert set(got) == set(want)
    for k, (n, inertia) in want.items():
        assert got[k][0] == n and close(got[k][1], inertia)


def test_mixture_fit(spark, frames):
    pts = frames.embedding_points.select("id", F.slice("x", 1, 4).alias("x"))
    fits, x = [], vectors(pts)
    df = starts.hashed(pts)
    outer = [starts.mixture_seed(42, 5, r) for r in range(5)]
    first = starts.seeds(df, [starts.Job(5, starts.restart_seed(s, 5, r)) for s in outer for r in range(8)])
    for i in range(5):
        mean, sizes, var, _ = min((numpy_lloyd(x, c, 120) for c in first[i * 8 : i * 8 + 8]), key=lambda f: f[3])
        fits.append(numpy_em(x, sizes / sizes.sum(), mean, var + 1e-6, 120))
    w, mean, var, _ = max(fits, key=lambda f: f[3])
    logs = joint(x, w, mean, var)
    p = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
    label, top = p.argmax(axis=1), p.max(axis=1)
    got = {r.label: r for r in QUERIES["mixture_fit"](spark, SMALL).collect()}
    assert set(got) == set(label)
    for k, r in got.items():
        assert r.points == (label == k).sum()
        assert r.mean_max_posterior == pytest.approx(top[label == k].mean(), abs=1e-3)
        assert r.p10_max_posterior == pytest.approx(np.quantile(top[label == k], 0.1), abs=1e-3)


# ---- Regressions


def design(pdf, terms, continuous, one_hot=("month",)):
    names, columns, standard = ["intercept"], [np.ones(len(pdf))], {}
    for c in terms:
        v = pdf[c].to_numpy(float)
        if len(v) and v.min() != v.max():
            if c in continuous:
                standard[c] = v.mean(), v.std(ddof=1)
                v = (v - v.mean()) / v.std(ddof=1)
            names.append(c)
            columns.append(v)
    for c in one_hot:
        for level in sorted(set(pdf[c]))[1:]:
            names.append(f"{c}_{level}")
            columns.append((pdf[c] == level).to_numpy(float))
    return names, np.column_stack(columns), standard


def sandwich(x, gram, residual, groups):
    bread = np.linalg.inv(gram)
    s = np.array([(x[groups == g] * residual[groups == g, None]).sum(axis=0) for g in np.unique(groups)])
    return bread @ (s.T @ s) @ bread


def newton(x, y, groups, max_iter=80):
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-6
    penalty[0, 0] = 0

    def at(beta):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        return mu, (x.T * np.maximum(mu * (1 - mu), 1e-8)) @ x + penalty

    for _ in range(max_iter):
        mu, gram = at(beta)
        step = np.linalg.solve(gram, x.T @ (y - mu) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    mu, gram = at(beta)
    return beta, sandwich(x, gram, y - mu, groups)


def pandas_of(df, numbers, texts):
    return df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(numbers)], *[F.col(c).cast("string").alias(c) for c in texts]).toPandas()


def hold(rows, analysis, names, beta, covariance):
    got = {r.term: r for r in rows if r.analysis == analysis}
    assert sorted(got) == sorted(names)
    for name, b, s in zip(names, beta, np.sqrt(np.maximum(np.diag(covariance), 0)), strict=True):
        r = got[name]
        assert close(r.coefficient, b, 1e-3) and close(r.robust_se, s, 1e-3), (analysis, name)
        if s > 1e-6 and abs(b) < 20:
            assert close(r.p_value, math.erfc(abs(b / s) / math.sqrt(2)), 1e-3)
            assert close(r.odds_ratio, math.exp(b), 1e-2)


@pytest.mark.parametrize("name", ["disengagement_models", "path_models"])
def test_families(spark, frames, name):
    build, terms, continuous = {
        "disengagement_models": (models.disengagement_frame, models.DISENGAGEMENT, models.DISENGAGEMENT_CONTINUOUS),
        "path_models": (models.path_frame, models.PATH, models.PATH_CONTINUOUS),
    }[name]
    frame = build(frames.labels, frames.conf).cache()
    rows = QUERIES[name](spark, SMALL).collect()
    assert {r.analysis for r in rows} == {a for a, _, _ in models.analyses(frames.conf)}
    for analysis, d, leave_out in models.analyses(frames.conf):
        y = f"disengaged_{d}d"
        pdf = pandas_of(models.sample(frame, d, leave_out), [*terms, y], ["month", "pid"])
        names, x, _ = design(pdf, terms, continuous)
        hold(rows, analysis, names, *newton(x, pdf[y].to_numpy(), pdf["pid"].to_numpy()))


def test_threshold_models(spark, larger):
    frames = larger
    focal = frames.focal.cache()
    scan = recovery.threshold_scan(recovery.scan_rows(focal, frames.conf, frames.conf.long_horizon), frames.conf).toPandas()
    best = scan.sort_values(["variable", "drop", "threshold"], ascending=[True, False, True]).groupby("variable").first()
    rows = QUERIES["threshold_models"](spark, LARGER).collect()
    used = [v for v in ("gap_before_days", "density_prev5", "prior_focal_share", "prior_session_count") if v in best.index]
    assert used
    for analysis, d, leave_out in models.analyses(frames.conf):
        pdf = pandas_of(models.sample(focal, d, leave_out), [*used, *regression.CURVE_CONTROLS, f"recovered_{d}d"], ["month", "pid"])
        for v in used:
            pdf[f"high_{v}"] = np.where(pdf[v].isna(), np.nan, pdf[v] >= best.loc[v, "threshold"])
        terms = [f"high_{v}" for v in used]
        assert not pdf[terms].isna().any().any()
        names, x, _ = design(pdf, (*terms, *regression.CURVE_CONTROLS), regression.CURVE_CONTINUOUS)
        hold(rows, analysis, names, *newton(x, pdf[f"recovered_{d}d"].to_numpy(), pdf["pid"].to_numpy()))


def basis(v):
    a, b, c, d = regression.KNOTS
    cube = lambda k: np.maximum(v - k, 0) ** 3
    return [v, *[cube(k) - cube(c) * (d - k) / (d - c) + cube(d) * (c - k) / (d - c) for k in (a, b)]]


def test_recovery_curve_and_its_models(spark, frames):
    d = frames.conf.long_horizon
    y = f"recovered_{d}d"
    pdf = pandas_of(frames.focal.filter(F.col(f"evaluable_{d}d")), ["density_prev5", *regression.CURVE_CONTROLS, y], ["month", "pid"])
    for c, v in zip(regression.SPLINE, basis(pdf["density_prev5"].to_numpy()), strict=True):
        pdf[c] = v
    rows = QUERIES["curve_models"](spark, SMALL).collect()
    for name, density in (("linear", regression.SPLINE[:1]), ("spline", regression.SPLINE)):
        names, x, standard = design(pdf, (*density, *regression.CURVE_CONTROLS), regression.CURVE_CONTINUOUS)
        beta, covariance = newton(x, pdf[y].to_numpy(), pdf["pid"].to_numpy(), 100)
        hold(rows, name, names, beta, covariance)
    grid = np.linspace(0, 1, 101)
    values = dict(zip(regression.SPLINE, basis(grid), strict=True))
    at = np.zeros((101, len(names)))
    for i, c in enumerate(names):
        m, s = standard.get(c, (0.0, 1.0))
        if c in values or c in regression.CURVE_CONTINUOUS:
            at[:, i] = ((values[c] if c in values else pdf[c].median()) - m) / s
    at[:, 0] = 1
    eta, se = at @ beta, np.sqrt(np.maximum((at @ covariance * at).sum(axis=1), 0))
    p = lambda e: 1 / (1 + np.exp(-np.clip(e, -35, 35)))
    got = sorted(QUERIES["recovery_curve"](spark, SMALL).collect(), key=lambda r: r.density)
    for name, want in (("density", grid), ("recovery", p(eta)), ("low", p(eta - 1.96 * se)), ("high", p(eta + 1.96 * se))):
        assert [r[name] for r in got] == pytest.approx(list(want), abs=1e-4), name


def test_narrowing_models(spark, larger):
    frames = larger
    frame = frames.anchor_frame.cache()
    matched = rigidity.matched_rows(frame, rigidity.greedy_matches(frame)).withColumn("match", F.concat_ws("|", "match_stratum", "number"))
    slopes = rigidity.slope_columns(frames.conf)
    pdf = pandas_of(matched, [*models.NARROWING, *slopes], ["month", "state_id", "match"])
    names, x, _ = design(pdf, models.NARROWING, models.NARROWING[1:], ("month", "state_id"))
    rows = QUERIES["narrowing_models"](spark, LARGER).collect()
    assert len(pdf) > len(names)
    assert {r.analysis for r in rows} == set(slopes)
    ridge = np.eye(len(names)) * 1e-8
    ridge[0, 0] = 0
    for c in slopes:
        v = pdf[c].to_numpy()
        assert not np.isnan(v).any()
        beta = np.linalg.solve(x.T @ x + ridge, x.T @ v)
        hold(rows, c, names, beta, sandwich(x, x.T @ x + ridge, v - x @ beta, pdf["match"].to_numpy()))
