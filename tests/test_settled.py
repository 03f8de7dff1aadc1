from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pytest

from sessionlake.operators import starts
from sessionlake.operators.diagnostics import hash_sample
from sessionlake.operators.features import ACTIVITY
from sessionlake.plans import queries
from sessionlake.plans.frames import Frames
from sessionlake.plans.queries import QUERIES
from tests.conftest import SMALL
from tests.test_iterative import numpy_em, numpy_lloyd
from tests.test_models import blobs
from tests.test_starts import check_grid_row, ids_and_points, mixture_labels


def settled(r):
    return SimpleNamespace(**{c.removeprefix("settled_"): v for c, v in r.asDict().items() if c.startswith("settled_")})


def numpy_mixture(x, first, restarts, kmeans_restarts, kmeans_iter, max_iter):
    """The greatest likelihood of mixtures that settle, each from the best of its own k-means."""
    fits = []
    for i in range(restarts):
        mean, sizes, var, _ = min((numpy_lloyd(x, c, kmeans_iter) for c in first[i * kmeans_restarts : (i + 1) * kmeans_restarts]), key=lambda f: f[3])
        fits.append(numpy_em(x, sizes / sizes.sum(), mean, np.where(sizes[:, None] > 0, var, x.var(axis=0)) + 1e-6, max_iter)[3])
    return max(fits)


def test_grid_has_settled_fits(spark):
    """Every value of fits that settle, beside those after one step; limits that end a fit are kept to."""
    _, pts = blobs(spark)
    ks, df = (2, 3, 4), starts.hashed(pts)
    ids, x = ids_and_points(pts)
    jobs = [starts.Job(k, 42) for k in ks]
    once = {(r.method, r.k): r.asDict() for r in starts.model_grid({"a": pts}, ks, 42, 3, 2, 1, 40).collect()}
    for limit in (2, 120):
        rows = {(r.method, r.k): r for r in starts.model_grid({"a": pts}, ks, 42, 3, 2, 1, 40, limit).collect()}
        for method, fits in (("kmeans", starts.kmeans_many(df, jobs, 3, limit)), ("gmm_diag", starts.mixture_many(df, jobs, 2, 3, limit))):
            for k, f in zip(ks, fits, strict=True):
                r = rows[method, k]
                assert {c: r[c] for c in once[method, k]} == pytest.approx(once[method, k], nan_ok=True)
                check_grid_row(settled(r), f, k, method, ids, x, [i.id for i in hash_sample(pts, "id", 40, starts.grid_seed(42, k, method)).collect()])
                assert r.iterations == 1 and r.settled_iterations == (f.iterations if method == "kmeans" else f.after.iterations) <= limit
    assert max(r.settled_iterations for r in rows.values()) > 2


def test_model_grid_query_settles(spark):
    """The query's fits go on until NumPy's settle, from the same first centres."""
    rows = {(r.space, r.method, r.k): r for r in QUERIES["model_grid"](spark, SMALL).collect()}
    pts = queries._pc(Frames(spark, SMALL)).cache()
    _, x = ids_and_points(pts)
    df = starts.hashed(pts).cache()
    for k in (2, 6):
        r, job = rows["pc1_pc5", "kmeans", k], starts.Job(k, 42)
        best = min(numpy_lloyd(x, c, 120)[3] for c in starts.seeds(df, starts.every_start([job], 8)))
        assert r.settled_inertia == pytest.approx(best, rel=1e-5) and r.settled_inertia < r.inertia and r.settled_iterations > 1
        r = rows["pc1_pc5", "gmm_diag", k]
        first = starts.seeds(df, starts.every_start(starts.own_kmeans([job], 5), 8))
        assert r.settled_log_likelihood == pytest.approx(numpy_mixture(x, first, 5, 8, 120, 120), rel=1e-4)
        assert r.settled_log_likelihood > r.log_likelihood and r.settled_iterations > 1
    spark.catalog.clearCache()


def test_regime_refit_query_settles(spark):
    """Settled clusters of each regime, their likelihood by NumPy from the same first centres; a cluster of either fit is a row."""
    rows = QUERIES["regime_refit"](spark, SMALL).collect()
    frames = Frames(spark, SMALL)
    for name in queries.REGIMES:
        part, pts = queries._regime_points(frames, name)
        ids, x = ids_and_points(pts)
        df = starts.hashed(pts).cache()
        own = starts.own_kmeans([queries.REFIT], 8)
        first = starts.seeds(df, starts.every_start(own, 8))
        of = [r for r in rows if r.regime == name]
        ll = numpy_mixture(x, first, 8, 8, 120, 140)
        free = 4 + 2 * 5 * x.shape[1]
        assert [r.settled_bic for r in of] == pytest.approx([-2 * ll + free * math.log(len(x))] * len(of), rel=1e-4)
        assert all(r.settled_bic < r.bic and 1 < r.settled_iterations <= 140 for r in of)
        fit = starts.mixture_many(df, [queries.REFIT], 8, 8, 140, begun=starts.kmeans_many(df, own, 8, 120))[0]
        pdf = part.toPandas().set_index("session_id")
        label = dict(zip(ids, mixture_labels(x, fit.before), strict=True))
        pdf["cluster"] = [label[i] for i in pdf.index]
        pdf["events"] = pdf[list(ACTIVITY)].sum(axis=1)
        got = {r.cluster: r for r in of if r.settled_size is not None}
        assert set(got) == set(pdf.cluster) and len(of) == len({r.cluster for r in of})
        assert sum(r.settled_size for r in got.values()) == sum(r["size"] or 0 for r in of) == len(x)
        for k, g in pdf.groupby("cluster"):
            want = (len(g), g.duration_minutes.median(), g.events.median(), (g.events == 0).mean(), (g.primary_game_mode == "").mean())
            r = got[k]
            assert (r.settled_size, r.settled_duration_median, r.settled_events_median, r.settled_no_event_rate, r.settled_missing_mode_rate) == pytest.approx(want, abs=1e-5)
            assert r.settled_minimal_found == (want[1] <= 2 and want[3] >= 0.95 and want[4] >= 0.9)
        assert sum(r.settled_is_minimal for r in got.values()) == 1
    spark.catalog.clearCache()
