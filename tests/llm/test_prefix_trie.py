from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import prefix_trie as trie
from sessionlake.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows, every=100, most=6):
    """The trie of rebuilt conversations by tuples of turns."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        whole = tuple(convs.get(c - int(abs(c) % every) * (1 if c > 0 else -1), [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, of in members.items()) if members else []


def result(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def key(row):
    return tuple((v is not None, v) for v in row)


def drawn(rng, n, longest):
    rows = []
    for c in range(n):
        for turn in range(rng.choice((1, 2, 3, 5, longest))):
            rows.append((c * rng.choice((1, 1, 7)), turn, rng.choice(("user", "assistant")), rng.choice(("a", "bb", "ccc")) if turn < 3 else "same"))
    return rows


@pytest.mark.parametrize(("seed", "height", "longest"), [(1, 8, 6), (2, 2, 20), (3, 3, 30)])
def test_is_brute_force(spark, seed, height, longest):
    rng = random.Random(seed)
    rows = drawn(rng, 60, longest)
    got = result(conversation_trie(spark.createDataFrame(rows, SCHEMA), height=height))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert max(r[1] for r in got) >= 6


def test_long_conversations_in_segments(spark, monkeypatch):
    """Running values cross segments; the depth needs several levels of bands."""
    monkeypatch.setattr(trie, "SEGMENT", 5)
    rows = [(c, t, "user", "x" if t % 40 or c < 3 else f"{c}") for c in range(5) for t in range(150)]
    got = result(conversation_trie(spark.createDataFrame(rows, SCHEMA), height=4))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_awkward_rows(spark):
    """Null ids, turns, roles and texts, equal turn numbers, repeated rows, negative ids, absent first conversations, clashing names."""
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", None), (5, 0, None, "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (300, 1, "u", "é\U0001f600"), (300, 1, "u", "é\U0001f600"), (301, 0, "u", "é\U0001f600"), (-7, 0, "u", "x"), (0, 0, "u", "y"), (0, 1, "u", "z" * 3000)]
    rows += [(c, 0, "u", "q") for c in range(900, 930)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "at": F.lit(2), "depth": F.lit("x")})
    assert sorted(result(conversation_trie(df)), key=key) == sorted(brute(rows), key=key)
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0


def test_only_turnless_conversations(spark):
    """A conversation without turns is a member of the root and ends there."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = result(conversation_trie(spark.createDataFrame([(c, 0, "u", "gone")], SCHEMA)))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
