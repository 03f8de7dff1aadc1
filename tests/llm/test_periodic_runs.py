from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm.catalog import QUERIES
from sessionlake.llm.periodic_runs import Runs, SuffixTree, document_runs, periodic_runs, runs_of
from tests.llm.data import awkward, frame, sentence


def brute(words, length=6, times=4):
    """All maximal runs of smallest period q with at least `length` words and `times` periods, by definition."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - s
            if i > s and size >= max(length, times * q) and not any(all(words[k] == words[k + r] for k in range(s, s + size - r)) for r in range(1, q)):
                out.append((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(rng):
    words = [rng.randrange(rng.choice((1, 2, 3, 5, 20))) for _ in range(rng.randrange(60))]
    if rng.random() < 0.6 and len(words) > 3:
        a = rng.randrange(len(words))
        p = 1 + (len(words) - a) // rng.randrange(3, 9)
        words = words[:a] + [words[a + k % p] for k in range(len(words) - a)] + [rng.randrange(3) for _ in range(rng.randrange(6))]
    return words


@pytest.mark.parametrize("conf", [Runs(), Runs(2, 2), Runs(4, 3), Runs(1, 2), Runs(9, 4)])
def test_runs_are_those_of_the_definition(conf):
    rng = random.Random(conf.length)
    for _ in range(400):
        words = drawn(rng)
        want = brute(words, conf.length, conf.times)
        assert [tuple(r) for r in runs_of(np.array(words, np.int64), conf).tolist()] == want
        runs, kept = document_runs([str(w).encode() for w in words], conf)
        assert [tuple(r) for r in runs.tolist()] == want
        gone = {k for s, size, q in want for k in range(s + q, s + size)}
        assert kept == [str(w).encode() for k, w in enumerate(words) if k not in gone]


def test_common_extensions():
    rng = random.Random(3)
    words = [rng.randrange(3) for _ in range(150)]
    tree = SuffixTree(words)
    pairs = [(i, j) for i in range(150) for j in range(150) if i != j]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    want = []
    for a, b in pairs:
        k = 0
        while max(a, b) + k < 150 and words[a + k] == words[b + k]:
            k += 1
        want.append(k)
    assert tree.common(i, j).tolist() == want
    assert sorted(range(151), key=lambda k: tree.rank[k]) == sorted(range(151), key=lambda k: words[k:])


def test_long_texts():
    """Deep trees, long periods, one word only; a text without repeats gets no tree."""
    rng = random.Random(5)
    part = [str(rng.randrange(10**6)).encode() for _ in range(3000)]
    assert document_runs(part * 5)[0].tolist() == [[0, 15000, 3000]]
    assert document_runs([b"x"] * 20000)[0].tolist() == [[0, 20000, 1]]
    assert document_runs(part)[0].tolist() == []
    runs, kept = document_runs(part + [b"a", b"b"] * 5000 + part)
    assert runs.tolist() == [[3000, 10000, 2]]
    assert kept == part + [b"a", b"b"] + part


def expected(key, text):
    """A document's digests by the contract's words, with runs by definition."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    text = " ".join(w for k, w in enumerate(words) if k not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (key, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query_is_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = [t for t in awkward(rng) if len(t or "") < 9000]
    for _ in range(150):
        line = sentence(rng, rng.randrange(1, 9))
        texts.append(" \n".join([sentence(rng, rng.randrange(30)), *[line] * rng.randrange(8), sentence(rng, rng.randrange(30))]))
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(expected(k, t) for k, t in enumerate(texts, 1))
    assert sum(r.n_runs > 1 for r in got) and sum(r.n_runs == 0 for r in got)


def test_odd_tables(spark):
    df = frame(spark, [None, "", "a a a a a a", "A a A a A a A a b"]).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2))
    df = df.unionByName(df.filter("doc_id = 3")).unionByName(df.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    one = (6, [(0, 6, 1)], "a")
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, *one), (3, *one), (None, *one), (4, 9, [(0, 8, 2)], "A a b")], key=str)
    assert periodic_runs(frame(spark, [])).count() == 0
