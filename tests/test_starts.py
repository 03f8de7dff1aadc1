from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import clusters, starts
from sessionlake.operators.diagnostics import hash_sample
from sessionlake.operators.features import ACTIVITY
from sessionlake.plans import queries
from sessionlake.plans.frames import Frames
from sessionlake.plans.queries import QUERIES
from tests.conftest import SMALL
from tests.test_iterative import joint
from tests.test_models import blobs


@pytest.fixture
def frames(spark):
    yield Frames(spark, SMALL)
    spark.catalog.clearCache()


def test_one_step_is_numpy_and_partitions_do_not_matter(spark):
    x, pts = blobs(spark)
    jobs = [starts.Job(3, s) for s in range(4)]
    df = starts.hashed(pts)
    centers = starts.seeds(df, jobs)
    for c, d in zip(centers, starts.seeds(starts.hashed(pts.repartition(7)), jobs), strict=True):
        assert np.array_equal(c, d)
        assert len(np.unique(c, axis=0)) == 3
        assert all((x == row).all(axis=1).any() for row in c)
    for c, km in zip(centers, starts.lloyd(df, jobs, centers), strict=True):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert km.inertia == pytest.approx(d.min(axis=1).sum())
        for k in range(3):
            assert km.centers[k] == pytest.approx(x[d.argmin(axis=1) == k].mean(axis=0))
            assert km.variances[k] == pytest.approx(x[d.argmin(axis=1) == k].var(axis=0))
    best = starts.mixture_many(df, [starts.Job(3, 1)], max_iter=40)[0]
    assert sorted(best.after.weights) == pytest.approx([1 / 3] * 3, abs=0.02)


@pytest.mark.parametrize("parts", [1, 50, 400])
def test_sums_meet_on_executors(spark, parts):
    """However many partitions there are, the driver gets one row of each model."""
    pts = spark.range(2000, numPartitions=parts).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("x"))

    def part(h, x):
        return {i: (len(x), x.sum(axis=0) * (i + 1)) for i in range(6)}

    rows = starts.partials(starts.hashed(pts), part, starts._sums, fan=8)
    assert rows.count() == 6
    got = starts._pass(starts.hashed(pts), part, starts._sums)
    for i in range(6):
        assert got[i][0] == 2000
        assert got[i][1] == pytest.approx([(i + 1) * 1999000.0, (i + 1) * 2000.0])


def test_fit_is_the_same_over_thousands_of_partitions(spark):
    _, pts = blobs(spark)
    jobs = [starts.Job(3, 2)]
    few, many = (starts.kmeans_many(starts.hashed(pts.repartition(n)), jobs, 2, 2)[0] for n in (2, 1200))
    in_order = lambda f: np.array(sorted(f.centers.tolist()))  # noqa: E731  two starts may end alike but for their clusters' order
    assert in_order(many) == pytest.approx(in_order(few))
    assert many.inertia == pytest.approx(few.inertia)


# ---- Values of the queries that choose a model, from the same fits


def ids_and_points(pts):
    rows = sorted(pts.collect(), key=lambda r: str(r.id))
    return [r.id for r in rows], np.array([r.x for r in rows])


def by_pairs(a, b):
    """Adjusted Rand index by its definition over all pairs of points."""
    same_a, same_b = a[:, None] == a[None], b[:, None] == b[None]
    upper = np.triu(np.ones((len(a), len(a)), bool), 1)
    both, one, two, every = (same_a & same_b & upper).sum(), (same_a & upper).sum(), (same_b & upper).sum(), upper.sum()
    chance, top = one * two / every, (one + two) / 2
    return 1.0 if top == chance else (both - chance) / (top - chance)


def silhouette(x, label):
    if len(np.unique(label)) < 2:
        return None
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = label == label[i]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min(d[i, label == k].mean() for k in set(label) - {label[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def check_grid_row(r, f, k, method, ids, x, sampled):
    if method == "kmeans":
        d = ((x[:, None] - f.before[None]) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        assert r.inertia == pytest.approx(d.min(axis=1).sum(), abs=1e-4)
    else:
        logs = joint(x, f.before.weights, f.before.means, f.before.variances)
        label = logs.argmax(axis=1)
        norm = np.logaddexp.reduce(logs, axis=1).sum()
        free = (k - 1) + 2 * k * x.shape[1]
        assert r.log_likelihood == pytest.approx(norm, rel=1e-6)
        assert r.bic == pytest.approx(-2 * norm + free * math.log(len(x)), rel=1e-6)
        assert r.aic == pytest.approx(-2 * norm + 2 * free, rel=1e-6)
    kinds, size = np.unique(label, return_counts=True)
    assert (r.least_size, r.most_size) == (size.min(), size.max())
    mean = np.array([x[label == j].mean(axis=0) for j in kinds])
    within = sum(((x[label == j] - m) ** 2).sum() for j, m in zip(kinds, mean, strict=True))
    between = sum(n * ((m - x.mean(axis=0)) ** 2).sum() for n, m in zip(size, mean, strict=True))
    if within > 0 and len(kinds) > 1:
        assert r.calinski_harabasz == pytest.approx(between / (len(kinds) - 1) / (within / (len(x) - len(kinds))), rel=1e-4)
    spread = [np.sqrt(((x[label == j] - m) ** 2).sum(axis=1)).mean() for j, m in zip(kinds, mean, strict=True)]
    if len(kinds) > 1:
        worst = [max((spread[i] + spread[j]) / np.sqrt(((mean[i] - mean[j]) ** 2).sum()) for j in range(len(kinds)) if j != i) for i in range(len(kinds))]
        assert r.davies_bouldin == pytest.approx(np.mean(worst), rel=1e-4)
    at = [ids.index(i) for i in sampled]
    assert r.silhouette_points == len(at)
    want = silhouette(x[at], label[at])
    assert (r.silhouette is None) == (want is None) and (want is None or r.silhouette == pytest.approx(want, abs=1e-5))


def test_grid_values(spark):
    """Every value of a grid from its own fits; samples smaller than the points."""
    _, pts = blobs(spark)
    ks = (2, 3, 4)
    rows = {(r.method, r.k): r for r in starts.model_grid({"a": pts}, ks, 42, 3, 2, 1, 40).collect()}
    ids, x = ids_and_points(pts)
    jobs = [starts.Job(k, 42) for k in ks]
    for method, fits in (("kmeans", starts.kmeans_many(starts.hashed(pts), jobs, 3)), ("gmm_diag", starts.mixture_many(starts.hashed(pts), jobs, 2, 3))):
        for k, f in zip(ks, fits, strict=True):
            sampled = [r.id for r in hash_sample(pts, "id", 40, starts.grid_seed(42, k, method)).collect()]
            check_grid_row(rows[method, k], f, k, method, ids, x, sampled)


def test_model_grid_query(spark, frames):
    rows = {(r.space, r.method, r.k): r for r in QUERIES["model_grid"](spark, SMALL).collect()}
    assert set(rows) == {(s, m, k) for s in ("standardised", "pc1_pc5") for m in ("kmeans", "gmm_diag") for k in range(2, 9)}
    pts = queries._pc(frames).cache()
    ids, x = ids_and_points(pts)
    jobs = [starts.Job(k, 42) for k in range(2, 9)]
    for j, f in zip(jobs, starts.kmeans_many(starts.hashed(pts), jobs, 8), strict=True):
        check_grid_row(rows["pc1_pc5", "kmeans", j.k], f, j.k, "kmeans", ids, x, ids)  # fewer points than a sample
    for j, f in zip(jobs[:2], starts.mixture_many(starts.hashed(pts), jobs[:2], 5, 8), strict=True):
        check_grid_row(rows["pc1_pc5", "gmm_diag", j.k], f, j.k, "gmm_diag", ids, x, ids)


def mixture_labels(x, m):
    return joint(x, m.weights, m.means, m.variances).argmax(axis=1)


def test_stability_queries(spark, frames):
    pts = queries._pc(frames).cache()
    ids, x = ids_and_points(pts)
    df = starts.hashed(pts)
    pairs = {(r.k, r.seed_a, r.seed_b): r.adjusted_rand for r in QUERIES["seed_stability"](spark, SMALL).collect()}
    assert set(pairs) == {(k, a, b) for k in range(4, 9) for a in range(1, 6) for b in range(a + 1, 6)}
    keys = [(k, s) for k in (4, 7) for s in (1, 2, 5)]
    at = {key: mixture_labels(x, f.after) for key, f in zip(keys, starts.mixture_many(df, [starts.Job(*key) for key in keys], 3, 5), strict=True)}
    for k in (4, 7):
        for a, b in ((1, 2), (1, 5), (2, 5)):
            assert pairs[k, a, b] == pytest.approx(by_pairs(at[k, a], at[k, b]), abs=1e-5)
    parts = {(r.k, r.seed): r for r in QUERIES["subsample_stability"](spark, SMALL).collect()}
    assert set(parts) == {(k, s) for k in range(4, 9) for s in range(1, 6)}
    hashes = {r.id: r.h for r in pts.select("id", F.xxhash64("id").alias("h")).collect()}
    h = np.array([hashes[i] for i in ids], np.int64).view(np.uint64)
    jobs = [starts.Job(k, 0) for k in (4, 7)] + [starts.Job(k, s, 0.8, starts.restart_seed(s, k, 0)) for k in (4, 7) for s in (1, 3)]
    fits = starts.mixture_many(df, jobs, 3, 5)
    full = {j.k: mixture_labels(x, f.after) for j, f in zip(jobs[:2], fits[:2], strict=True)}
    for j, f in zip(jobs[2:], fits[2:], strict=True):
        r, own, inside = parts[j.k, j.seed], mixture_labels(x, f.after), starts.uniform(h, j.share_seed) < 0.8
        assert r.points == inside.sum() and 0.6 * len(x) < r.points < len(x)
        assert r.adjusted_rand == pytest.approx(by_pairs(full[j.k], own), abs=1e-5)
        assert r.adjusted_rand_own == pytest.approx(by_pairs(full[j.k][inside], own[inside]), abs=1e-5)
        y = x[inside]
        norm = np.logaddexp.reduce(joint(y, f.before.weights, f.before.means, f.before.variances), axis=1).sum()
        assert r.bic == pytest.approx(-2 * norm + ((j.k - 1) + 2 * j.k * x.shape[1]) * math.log(len(y)), rel=1e-6)


def test_regime_refit_query(spark, frames):
    rows = QUERIES["regime_refit"](spark, SMALL).collect()
    assert {r.regime for r in rows} == set(queries.REGIMES)
    for name in queries.REGIMES:
        part, pts = queries._regime_points(frames, name)
        ids, x = ids_and_points(pts)
        fit = starts.mixture_many(starts.hashed(pts), [queries.REFIT], 8, 8)[0]
        label = dict(zip(ids, mixture_labels(x, fit.before), strict=True))
        pdf = part.toPandas().set_index("session_id")
        pdf["cluster"] = [label[i] for i in pdf.index]
        pdf["events"] = pdf[list(ACTIVITY)].sum(axis=1)
        got = {r.cluster: r for r in rows if r.regime == name}
        assert set(got) == set(pdf.cluster)
        want = {}
        for k, g in pdf.groupby("cluster"):
            want[k] = (g.duration_minutes.median(), g.events.median(), -(g.events == 0).mean(), -(g.primary_game_mode == "").mean())
            r = got[k]
            assert (r["size"], r.duration_median, r.events_median, r.no_event_rate, r.missing_mode_rate) == (len(g), *(pytest.approx(abs(v), abs=1e-5) for v in want[k]))
            assert r.minimal_found == (want[k][0] <= 2 and -want[k][2] >= 0.95 and -want[k][3] >= 0.9)
        score = {k: sum(1 + sum(o[i] < v[i] for o in want.values()) for i in range(4)) for k, v in want.items()}
        assert {k: r.minimal_score for k, r in got.items()} == score
        assert [k for k, r in got.items() if r.is_minimal] == [min(want, key=lambda k: (score[k], want[k][0], k))]


def test_scores_of_few_clusters():
    assert starts.scatter_scores(np.zeros((2, 1)), np.array([3, 0]), 0.0, np.zeros(2))[0] is None
    assert isinstance(clusters.restart_seed(1, 2, -1), int)


def test_starts_of_both_methods_share_passes(spark, monkeypatch):
    """A grid draws the centres of k-means and of the mixtures' own k-means in the same passes: one a centre, and one step for all."""
    _, pts = blobs(spark)
    passes, of = [], starts._pass
    monkeypatch.setattr(starts, "_pass", lambda df, part, add: passes.append(df.rdd.getNumPartitions()) or of(df, part, add))
    starts.model_grid({"a": pts.coalesce(1)}, (2, 3), 42, 2, 2, 1, 40).collect()
    assert len(passes) == 3 + 1 + 1 + 1  # centres, Lloyd, EM, scores
    assert set(passes) == {spark.sparkContext.defaultParallelism}  # points of one part are dealt to all cores


def test_draws_of_many_jobs_are_those_of_each(spark, monkeypatch):
    """Whole points and shares of them, in blocks of any size."""
    _, pts = blobs(spark)
    df = starts.hashed(pts).cache()
    jobs = [starts.Job(k, s, share, 7) for k in (2, 4) for s in (1, 2) for share in (1.0, 0.5)]
    together = starts.seeds(df, jobs)
    monkeypatch.setattr(starts, "CELLS", 1)
    for job, c, d in zip(jobs, together, starts.seeds(df, jobs), strict=True):
        assert np.array_equal(c, d) and np.array_equal(c, starts.seeds(df, [job])[0])
    rows = df.collect()
    h, x = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.x for r in rows])
    for job, c in zip(jobs, together, strict=True):
        own = starts.uniform(h, 7) < job.share
        for step in range(job.k):
            key = -np.log(starts.uniform(h, job.seed * 64 + step))
            if step:
                far = ((x[:, None] - c[None, :step]) ** 2).sum(axis=2).min(axis=1)
                key = np.where(far > 1e-12, key / np.maximum(far, 1e-12), np.inf)
            assert np.array_equal(c[step], x[np.where(own, key, np.inf).argmin()])


def test_silhouette_of_a_sample_is_small_in_memory():
    """A task holds distances of a block of points, not gaps of all components: 6,000 points of 12 components took 312 MB."""
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(6000, 12)), rng.integers(0, 4, 6000)
    tracemalloc.start()
    starts.sampled_silhouette(x, label)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert starts.sampled_silhouette(x[:300], label[:300]) == pytest.approx(silhouette(x[:300], label[:300]))


def test_regime_refit_reads_events_before_it_returns(spark):
    """What is returned reads a written table of sessions with their points: no plan goes back to the events for each regime."""
    files = QUERIES["regime_refit"](spark, SMALL).inputFiles()
    assert files and not [f for f in files if "events" in f]


def test_label_as_a_column_is_that_of_the_posteriors(spark):
    x, pts = blobs(spark)
    m = clusters.Mixture(np.array([0.2, 0.5, 0.3]), x[:3], np.full(x[:3].shape, 0.4))
    rows = clusters.posteriors(pts, m).withColumn("again", clusters.mixture_label(F.col("x"), m)).collect()
    assert len({r.label for r in rows}) > 1 and all(r.label == r.again for r in rows)
