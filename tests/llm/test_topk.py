from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sessionlake.llm.topk import ImpactIndex, TopK, op4_impact_ordered_topk, quantised, top_k


def brute(vectors, queries, k):
    out = []
    for q in queries:
        scores = [(-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "span", "conf"), [(300, 16, 50, TopK()), (120, 3, 1, TopK(k=5, row_block=9, query_block=7, growth=2)), (4, 8, 9, TopK()), (90, 1, 2, TopK(levels=1)), (200, 24, 40, TopK(k=3, row_block=60, rest=0.0)), (60, 8, 10**9, TopK(row_block=30))])
def test_is_brute_force(spark, n, dims, span, conf):
    rng = np.random.default_rng(n)
    vectors = {k: rng.integers(-span, span + 1, dims).tolist() for k in range(n)}
    vectors[n // 2] = vectors[0]  # ties
    rows = spark.createDataFrame([(k, v) for k, v in vectors.items()], "vec_id long, vector array<long>")
    got = top_k(rows, rows.filter("vec_id % 10 = 0"), conf).collect()
    assert sorted(tuple(r) for r in got) == brute(vectors, [k for k in vectors if k % 10 == 0], conf.k)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.0005]), (1, [0.1, 0.2]), (2, None), (3, [nan, 0.1]), (4, [inf, 0.1]), (5, [None, 0.1]), (None, [0.1, 0.1])]
    q = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score"))
    assert sorted((r.vec_id, r.vector) for r in q.collect()) == [(0, [512, -1]), (1, [102, 204])]
    assert [tuple(r) for r in top_k(q, q.filter("vec_id = 0")).collect()] == [(0, 1, 1, 512 * 102 - 204)]
    assert top_k(q.limit(0), q.limit(0)).collect() == []
    assert top_k(q.filter("vec_id = 0"), q.filter("vec_id = 0")).collect() == []


def test_ragged_empty_and_large_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, []), (3, []), (4, [1.0]), (5, [2.0, 0.0]), (7, [0.0, 0.0])]
    q = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scale=1)
    got = sorted(tuple(r) for r in top_k(q.withColumn("rank", q.vec_id), q.unionAll(q)).collect())
    want = [(0, 1, 1, 5), (0, 2, 5, 2), (0, 3, 7, 0), (1, 1, 5, 6), (1, 2, 0, 5), (1, 3, 7, 0), (2, 1, 3, 0), (3, 1, 2, 0), (5, 1, 1, 6), (5, 2, 0, 2), (5, 3, 7, 0), (7, 1, 0, 0), (7, 2, 1, 0), (7, 3, 5, 0)]
    assert got == want


def test_large_vectors_keep_their_rows(spark):
    """Norms from 2**31 on, as rows and as queries, among ordinary vectors; components beyond a long where the score fits."""
    rng = np.random.default_rng(8)
    vectors = {k: rng.integers(-50, 51, 6).tolist() for k in range(120)}
    vectors |= {7: [2**33, -1, 2, 0, 0, 3], 20: [0, 2**35 + 1, 0, 0, 0, -5], 33: [-(2**33), 1, 1, 1, 1, 1], 40: [0, 2**20, -(2**27), 2**27, 0, 0], 50: [1, 0, 0, 0, 2**31, 0]}
    rows = spark.createDataFrame([(k, v) for k, v in vectors.items()], "vec_id long, vector array<long>")
    # Dot products in Python, since two large vectors' products leave NumPy's long.
    want = []
    for q in (k for k in vectors if k % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1)]
    for conf in (TopK(), TopK(row_block=25, query_block=3)):
        assert sorted(tuple(r) for r in top_k(rows, rows.filter("vec_id % 10 = 0"), conf).collect()) == sorted(want)
    huge = [(0, [0.0, 1.0]), (1, [1e30, 2.0]), (2, [0.5, 3.0]), (3, [-1e30, 1.0])]
    q = quantised(spark.createDataFrame(huge, "vec_id long, embedding array<float>"), scale=1)
    assert [tuple(r) for r in top_k(q, q.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 3), (0, 2, 1, 2), (0, 3, 3, 1)]
    with pytest.raises(Exception, match="query 1 and row 2 does not fit|query 1 and row 0 does not fit|query 1 and row 3 does not fit"):
        top_k(q.withColumn("vector", F.transform("vector", lambda x: x + 1)), q.filter("vec_id = 1")).collect()


def test_repeated_rows_and_ties(spark):
    rows = spark.createDataFrame([(k % 40, [1, 2, 3]) for k in range(200)] + [(900, [1, 2, 2])], "vec_id long, vector array<long>")
    got = [tuple(r) for r in top_k(rows, rows.filter("vec_id = 3"), TopK(row_block=50)).collect()]
    assert sorted(got) == [(3, r, v, 14) for r, v in enumerate([0] * 5 + [1] * 5, 1)]


@pytest.mark.parametrize("least", [False, True])
def test_index_reads_part_and_scores_few(least):
    """At the query's settings, over sf0.1: the shares that the README gives."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids = table.column("vec_id").to_numpy()
    x = np.floor(np.array(table.column("embedding").to_pylist(), float) * 1024).astype(np.int64)
    index, read, rescored = ImpactIndex(ids, x), [], []
    for at in np.flatnonzero(ids % 100 == 0):
        scores = np.where(ids == ids[at], -(2**60), x @ x[at])
        best = np.lexsort((ids, -scores))[:10]
        found = index.search(x[at], 10, int(ids[at]), float(scores[best[-1]]) if least else -np.inf)
        assert found.ids.tolist() == ids[best].tolist()
        assert found.scores.tolist() == scores[best].tolist()
        read.append(found.read / x.size)
        rescored.append(found.rescored / len(x))
    assert np.mean(read) < 0.63
    assert np.mean(rescored) < 0.15
