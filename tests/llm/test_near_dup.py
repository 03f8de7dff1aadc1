from __future__ import annotations

import random
from itertools import combinations

import pytest

from sessionlake.llm.components import components
from sessionlake.llm.near_dup import NearDup, least_matches, near_dup_stage, near_duplicates
from sessionlake.llm.shared import shared_folder
from tests.llm.data import awkward, edited, frame, sentence
from tests.llm.test_kernel import plain


def shingles(text):
    w = plain(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    """(id, set size, component) of (id, text) rows, by all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((k, len(s), find(k)) for k, s in sets)


def corpus(rng):
    texts = awkward(rng)
    for _ in range(12):
        base = sentence(rng, rng.randrange(20, 120))
        texts += [base] + [edited(rng, base, rng.choice((0.0, 0.005, 0.02, 0.03, 0.1))) for _ in range(rng.randrange(6))]
    passage = sentence(rng, 60)
    texts += [f"{passage} {sentence(rng, rng.randrange(5, 60))}" for _ in range(15)]
    chain = sentence(rng, 80).split()
    for _ in range(12):  # each a near copy of the one before, the ends unlike
        chain = [*chain[1:], rng.choice(chain) + "q"]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "conf"), [(1, NearDup()), (2, NearDup(percent=80)), (3, NearDup(bucket_block=3, family_block=200)), (4, NearDup(worth=2))])
def test_is_brute_force(spark, seed, conf):
    texts = corpus(random.Random(seed))
    got = near_duplicates(frame(spark, texts), conf).collect()
    want = brute(list(enumerate(texts, 1)), conf.percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_of_copies(spark):
    rng = random.Random(4)
    base = sentence(rng, 90)
    texts = [base] * 300 + [edited(rng, base, 0.004) for _ in range(300)] + [sentence(rng, 50) for _ in range(20)]
    got = near_duplicates(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(list(enumerate(texts, 1)), 85)


def test_edge_rows(spark):
    rng = random.Random(5)
    t = sentence(rng, 20)
    rows = [(5, t), (5, t), (2, t), (None, t), (7, None), (8, ""), (None, None), (9, sentence(rng, 20)), (9, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "'x' AS family", "0 AS n")
    got = sorted(near_duplicates(df).collect(), key=repr)
    by = [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id != 9]
    assert sorted(by, key=repr) == sorted([(5, 2, False), (5, 2, False), (2, 2, True), (None, None, False), (7, 7, True), (8, 8, True), (None, None, False)], key=repr)
    assert len(got) == len(rows)
    assert near_duplicates(df.limit(0)).collect() == []


def test_stage_keeps_columns_and_one_of_each(spark):
    rng = random.Random(6)
    t = sentence(rng, 40)
    docs = frame(spark, [t, t, sentence(rng, 30), None, "", t + " end"])
    out = near_dup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_bounds_are_posterior_tails():
    conf = NearDup()
    least = least_matches(conf)
    assert len(least) == conf.hashes // conf.batch
    rng = random.Random(7)
    missed = sum(any(sum(rng.random() < 0.85 for _ in range(conf.batch * (k + 1))) < m for k, m in enumerate(least)) for _ in range(3000))
    assert missed == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "u long, v long")
    got = {r.node: r.component for r in components(edges, shared_folder(spark), "t").collect()}
    assert all(got[k] == 0 for k in range(41))
    assert (got[101], got[200]) == (100, 200)
    assert components(edges.limit(0), shared_folder(spark), "t").collect() == []


def test_stage_takes_any_column_names_and_odd_rows(spark):
    rng = random.Random(8)
    t = sentence(rng, 30)
    rows = [(3, t), (3, t), (1, t), (None, t), (None, None), (4, ""), (5, None), (6, sentence(rng, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gone", "2 AS bucket", "3 AS `gone id`", "4 AS id", "5 AS doc", "6 AS `a.b`")
    out = near_dup_stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == sorted([(1, t), (None, t), (None, None), (4, ""), (5, None), rows[-1]], key=repr)
    assert near_dup_stage(spark, docs.limit(0), "").collect() == []
