"""Statistical operators against NumPy."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import clusters, regression, rigidity
from tests.conftest import SMALL


def numpy_logistic(x, y, groups, ridge=1e-6):
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 0
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        w = mu * (1 - mu)
        beta = beta + np.linalg.solve((x.T * w) @ x + penalty, x.T @ (y - mu) - penalty @ beta)
    mu = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv((x.T * (mu * (1 - mu))) @ x + penalty)
    s = np.array([(x[groups == g] * (y - mu)[groups == g, None]).sum(0) for g in np.unique(groups)])
    return beta, np.sqrt(np.diag(bread @ (s.T @ s) @ bread))


def rows(spark, x, y, g):
    return spark.createDataFrame([(float(a), str(c), [float(v) for v in b]) for a, c, b in zip(y, g, x, strict=True)], "y double, cluster string, x array<double>")


def test_logistic_and_linear(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 2))])
    g = rng.integers(0, 40, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [0.2, 1.0, -0.5])))).astype(float)
    fit = regression.logistic(rows(spark, x, y, g), 3)
    beta, se = numpy_logistic(x, y, g)
    assert fit.beta == pytest.approx(beta, abs=1e-8)
    assert fit.se == pytest.approx(se, abs=1e-8)
    z = x @ [1.0, 2.0, 3.0] + rng.normal(size=300)
    lin = regression.linear(rows(spark, x, z, g), 3)
    assert lin.beta == pytest.approx(np.linalg.lstsq(x, z, rcond=None)[0], abs=1e-6)
    bread, res = np.linalg.inv(x.T @ x), z - x @ lin.beta
    s = np.array([(x[g == k] * res[g == k, None]).sum(0) for k in np.unique(g)])
    assert lin.se == pytest.approx(np.sqrt(np.diag(bread @ (s.T @ s) @ bread)), abs=1e-6)


def test_design_drops_constant_terms_and_first_levels(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (2.0, 5.0, "b"), (4.0, 5.0, "c")], "u double, v double, m string")
    d = regression.fit_design(df, ["u", "v"], ["u", "v"], ["m"])
    assert d.names == ["intercept", "u", "m_b", "m_c"]
    x = np.array([r.x for r in d.rows(df.selectExpr("*", "1 AS y", "m AS c"), "y", "c").collect()])
    assert x[:, 1].mean() == pytest.approx(0, abs=1e-12)
    assert x[:, 1].std(ddof=1) == pytest.approx(1)


def test_pca_is_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, a double, b double, c double, d double")
    z = clusters.zscored(df, "id", list("abcd"))
    model = clusters.pca(z, list("abcd"))
    zx = (x - x.mean(0)) / x.std(0, ddof=1)
    s = np.linalg.svd(zx, compute_uv=False)
    assert model.eigenvalues == pytest.approx(s**2 / 59, rel=1e-9)
    assert model.eigenvalues.sum() == pytest.approx(4)
    assert sum(r.share for r in clusters.explained_variance(z, model).collect()) == pytest.approx(1)


def blobs(spark, n=90):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    return x, spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, x array<double>")


def test_em_steps_improve(spark):
    x, pts = blobs(spark)
    m = clusters.Mixture(np.full(3, 1 / 3), x[[0, 1, 60]], np.ones((3, 2)))
    lls = []
    for _ in range(4):
        m = clusters.m_step(clusters.posteriors(pts, m), m)
        lls.append(m.log_likelihood)
    assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:], strict=False))
    assert m.weights.sum() == pytest.approx(1)
    p = clusters.posteriors(pts, m).collect()
    assert all(sum(r.posterior) == pytest.approx(1) for r in p)


def test_cluster_scores(spark):
    x, pts = blobs(spark)
    centers = np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    labelled = clusters.assign(pts, centers)
    label = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sil = []
    for i in range(len(x)):
        a = d[i, (label == label[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i, label == k].mean() for k in range(3) if k != label[i])
        sil.append((b - a) / max(a, b))
    assert clusters.silhouette(labelled).first()[0] == pytest.approx(np.mean(sil))
    same = labelled.selectExpr("id", "label AS a", "(label + 1) % 3 AS b")
    assert clusters.adjusted_rand(same, "a", "b").first()[0] == pytest.approx(1.0)


def test_matching_skips_and_uses_up_the_same_player(spark):
    frame = spark.createDataFrame([("s", 1, "p1", "c1", 5), ("s", 0, "p1", "k1", 5), ("s", 0, "p2", "k2", 6), ("t", 1, "p3", "c2", 5)], "stratum string, terminal_case int, pid string, session_id string, session_index long")
    got = rigidity.greedy_matches(frame).collect()
    assert [(r.case_session_id, r.control_session_id) for r in got] == [("c1", "k2")]


def test_matching_is_the_plain_rule(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(6)}", int(rng.random() < (0.8 if k % 2 else 0.3)), f"p{rng.randrange(7)}", f"x{k:03d}", rng.randrange(1, 9)) for k in range(400)]
    want = []
    for s in sorted({r[0] for r in rows}):
        order = sorted((r for r in rows if r[0] == s), key=lambda r: (r[4], r[2], r[3]))
        controls, n = [r for r in order if not r[1]], 0
        for c in (r for r in order if r[1]):
            while controls and controls[0][2] == c[2]:
                controls.pop(0)
            if not controls:
                break
            n += 1
            k = controls.pop(0)
            want.append((s, n, c[2], c[3], k[2], k[3], c[4], k[4]))
    frame = spark.createDataFrame(rows, "stratum string, terminal_case int, pid string, session_id string, session_index long")
    assert sorted(tuple(r) for r in rigidity.greedy_matches(frame).collect()) == sorted(want)
    assert rigidity.greedy_matches(frame.limit(0)).collect() == []
    for block in (1, 4, 7, 40):  # a stratum in many tasks, the same pairs
        assert sorted(tuple(r) for r in rigidity.block_matches(frame.filter("terminal_case is not null"), block).collect()) == sorted(want)


def test_p_value_by_columns(spark):
    zs = [0.0, 0.3, -1.959963984540054, 2.5, 5.0, -9.0, 40.0, None]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(rigidity.two_sided_p(F.col("z")).alias("p")).collect()]
    assert got[:-1] == pytest.approx([rigidity.normal_p(z) for z in zs[:-1]], abs=1e-11)
    assert got[-1] is None


def test_no_window_looks_ahead_without_bound(spark):
    """Frames that end at the last row are worked out anew for each row: quadratic in a busy player's rows."""
    from sessionlake.catalog import QUERIES

    for name in ("pairing_by_player", "time_to_relapse"):
        if name in QUERIES:
            plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"RowFrame, \d+, unboundedfollowing", plan)


def test_normal_p():
    assert rigidity.normal_p(1.959963984540054) == pytest.approx(0.05)
    assert rigidity.normal_p(None) is None
    assert rigidity.normal_p(math.inf) is None


def test_models_of_a_family_share_their_steps(spark, monkeypatch):
    """As many scans as the slowest model has steps, and one for the errors; each model's fit is its own."""
    rng = np.random.default_rng(12)
    parts, want = [], {}
    for m, (p, slope) in {"slow": (3, 4.0), "quick": (2, 0.1), "none": (1, 0.0)}.items():
        x = np.column_stack([np.ones(200), rng.normal(size=(200, 2))])[:, :p]
        y = (rng.random(200) < 1 / (1 + np.exp(-(x @ np.array([0.1, slope, slope])[:p])))).astype(float)
        g = rng.integers(0, 30, 200)
        want[m] = p, numpy_logistic(x, y, g)
        parts += [(m, float(a), str(c), [*map(float, b), *[0.0] * (3 - p)]) for a, c, b in zip(y, g, x, strict=True)]
    df = spark.createDataFrame(parts, "model string, y double, cluster string, x array<double>")
    scans, grams = [], regression._grams
    monkeypatch.setattr(regression, "_grams", lambda rows, betas, logistic: scans.append(set(betas)) or grams(rows, betas, logistic))
    fits = regression.logistic_many(df, {m: p for m, (p, _) in want.items()})
    for m, (_, (beta, se)) in want.items():
        assert fits[m].beta == pytest.approx(beta, abs=1e-8)
        assert fits[m].se == pytest.approx(se, abs=1e-8)
    assert len(scans) == max(f.iterations for f in fits.values()) + 1
    assert [sum(m in s for s in scans) for m in want] == [fits[m].iterations + 1 for m in want]
    assert fits["slow"].iterations > fits["none"].iterations


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(regression, "MOST_LEVELS", 5)
    df = spark.range(30).selectExpr("id", "id * 1.0 AS u", "'a' AS m", "id % 8 AS level")
    with pytest.raises(ValueError, match="level has more than 5 levels"):
        regression.fit_design(df, ["u"], ["u"], ["level"])
    designs = regression.fit_designs(df.selectExpr("*", "id % 4 AS few", "cast(id % 2 AS string) AS part"), "part", ["u"], ["u"], ["few"])
    assert {k: d.names for k, d in designs.items()} == {"0": ["intercept", "u", "few_2"], "1": ["intercept", "u", "few_3"]}
    assert regression.fit_design(df.limit(0), ["u"], ["u"], ["m"]).names == ["intercept"]
