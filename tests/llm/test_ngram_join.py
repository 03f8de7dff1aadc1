from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm.ngram_join import Cell, CountTree, Order, Tree, ngram_join, sets
from tests.llm.data import edited, frame, sentence
from tests.llm.test_near_dup import brute, corpus


@pytest.mark.parametrize(
    ("seed", "conf"),
    [(1, CountTree()), (2, CountTree(frequent=2, share=0.0, worth=3)), (3, CountTree(fan=2, cell_block=200, family_block=200, worth=2)), (4, CountTree(percent=60, per_group=1, known=5, frequent=3))],
)
def test_is_brute_force(spark, seed, conf):
    rng = random.Random(seed)
    texts = corpus(rng)
    for n in (62, 66, 70, 130):  # sets on both sides of a change of coordinates
        base = sentence(rng, n).split()
        texts += [" ".join(base[: n - k]) for k in range(0, 9, 2)]
    got = ngram_join(frame(spark, texts), conf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(list(enumerate(texts, 1)), conf.percent)


def test_group_with_a_common_passage(spark):
    """Near copies and texts around one passage: many members in each cell, several blocks."""
    rng = random.Random(7)
    base, passage = sentence(rng, 60), sentence(rng, 50)
    texts = [edited(rng, base, 0.01) for _ in range(120)] + [f"{passage} {sentence(rng, rng.randrange(8, 40))}" for _ in range(120)]
    got = ngram_join(frame(spark, texts), CountTree(worth=16, frequent=20)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(list(enumerate(texts, 1)), 80)


def test_frequent_shingles_are_counted_in_all_tasks(spark):
    rng = random.Random(3)
    passage = sentence(rng, 8)
    df = frame(spark, [f"{passage} {sentence(rng, 20)}" for _ in range(60)]).select("doc_id", "text").repartition(3)
    rows = sets(df, CountTree()).filter("shingle is not null").groupBy("shingle").agg(F.sum("texts").alias("texts")).collect()
    assert sorted(r.texts for r in rows)[-4:] == [60] * 4  # the passage's own shingles


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 6, (30, 32))
    points = np.maximum(centres[rng.integers(0, 30, 700)] + rng.integers(-1, 2, (700, 32)) * (rng.random((700, 32)) < 0.1), 0).astype(np.uint8)
    sizes = points.sum(axis=1).astype(np.int64)
    tree, visited = Tree(points, sizes, 4), []
    assert sorted(tree.order.tolist()) == list(range(700))
    for r in range(0, 700, 37):
        overlap = np.minimum(points, points[r]).sum(axis=1, dtype=np.int64)
        want = np.flatnonzero((overlap * 180 >= 80 * (sizes + sizes[r])) & (sizes * 100 >= 80 * sizes[r]) & (sizes[r] * 100 >= 80 * sizes))
        got = tree.search(points[r], int(sizes[r]), 80)
        assert set(want) <= set(got.tolist())
        visited.append(len(got))
    assert max(visited) < 200  # the bound leaves few


def test_bound_never_rules_out_a_link():
    """Sets at and above the threshold share their first cells' order and pass the bound, whatever the table says."""
    rng = np.random.default_rng(9)
    conf = CountTree()
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(len(a) * rng.random() * 0.25)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 20))).astype(np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        known = rng.permutation(a)[: int(rng.integers(0, len(a) + 1))]
        order = Order(known, rng.integers(1, 5000, len(known)))
        assert len(np.intersect1d(order.first(a, conf.cells(len(a))), order.first(b, conf.cells(len(b)))))
        point = lambda s: np.bincount((s & np.uint64(conf.groups(len(s)) - 1)).astype(np.int64), minlength=conf.groups(len(s))).astype(np.uint8).tobytes()
        cell = Cell([point(a), point(b)], np.array([len(a), len(b)]), conf)
        assert cell.linked(0, np.array([1])).tolist() == [1]
        assert cell.linked(1, np.array([0])).tolist() == [0]


def test_odd_tables(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", None, ""]).withColumn("cells", F.lit(1)).withColumn("key_hi", F.lit("x"))
    rows = df.unionByName(df.limit(1)).unionByName(frame(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("cells", F.lit(1)).withColumn("key_hi", F.lit("x")))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(rows).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (None, 2, None)], key=str)
    assert ngram_join(frame(spark, [])).count() == 0
