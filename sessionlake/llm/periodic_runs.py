"""Maximal periodic runs of words in each document, by longest common extensions of suffix trees.

1. A run of the least length and exponent asked for lies whole in a stretch whose word n-grams all occur again in the
   document, some of them no farther back than a period can be (`stretches`). Only such stretches get trees. Equal hashes of
   unlike n-grams make a stretch longer and change no result.
2. Ukkonen's construction makes the suffix trees of the stretch and of its reversal. A tour of a tree, in which the inner nodes
   between two leaves are reduced to their least depth, and a sparse table over it answer lowest common ancestors, and so
   longest common extensions, in constant time.
3. Each run has a Lyndon root under the order of words or its reverse: the longest Lyndon word that begins at a position
   ends where the next smaller suffix begins. These candidates are extended to both sides; those of enough length are the runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.kernel import grams, mix
from sessionlake.session import ship


@dataclass(frozen=True)
class Runs:
    """A run has at least so many words, and so many times its smallest period."""

    length: int = 6
    times: int = 4

    @property
    def gram(self) -> int:
        """The greatest n for which each n-gram of a run occurs again in it: a run of period q needs 2 * q + n - 1 words."""
        return max(1, min(max(self.length, self.times * q) - 2 * q + 1 for q in range(1, self.length + 1)))


class SuffixTree:
    """Ukkonen's suffix tree of words, given as numbers from 0 on. The text's end is a word of its own, before all others."""

    def __init__(self, words: list[int]):
        self.n = n = len(words)
        text = [w + 1 for w in words]
        text.append(0)
        size, wide = n + 1, (max(text) if text else 0) + 1
        start, end, link, parent = [0], [0], [0], [0]
        child: dict[int, int] = {}
        leaves: list[int] = []
        node = edge = length = waiting = 0

        def new(a: int, b: int, above: int) -> int:
            start.append(a)
            end.append(b)
            link.append(0)
            parent.append(above)
            return len(start) - 1

        for at, word in enumerate(text):
            waiting += 1
            last = 0  # the inner node made last, whose link isn't known yet
            while waiting:
                if not length:
                    edge = at
                key = node * wide + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = leaf = new(at, size, node)
                    leaves.append(leaf)
                    if last:
                        link[last], last = node, 0
                else:
                    span = end[below] - start[below]
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    if text[start[below] + length] == word:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    child[key] = split = new(start[below], start[below] + length, node)
                    leaf = new(at, size, split)
                    leaves.append(leaf)
                    child[split * wide + word] = leaf
                    start[below] += length
                    parent[below] = split
                    child[split * wide + text[start[below]]] = below
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        del child, link
        self._parent = np.array(parent, np.int64)
        self._first = np.array(text, np.int64)[np.array(start, np.int64)]
        self._span = np.array(end, np.int64) - np.array(start, np.int64)
        self._suffix = np.full(len(start), -1, np.int64)
        self._suffix[leaves] = np.arange(size)
        self.rank, between = self.tour(1)
        self._table = [between]
        while len(between) > 1 << len(self._table) - 1:
            step = 1 << len(self._table) - 1
            before = self._table[-1]
            if len(before) <= step:
                break
            self._table.append(np.minimum(before[:-step], before[step:]))

    def tour(self, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Each suffix's place among the leaves, and the depth of the lowest common ancestor of each leaf and the next one.

        Children go by their first words, upward or downward; the text's end comes first in both.
        """
        first = self._first * sign
        first[self._first == 0] = np.iinfo(np.int64).min
        children = np.lexsort((first, self._parent))
        children = children[children != 0]
        above = self._parent[children]
        count = np.bincount(above, minlength=len(self._parent))
        begin = (np.cumsum(count) - count).tolist()
        many, kids = count.tolist(), children.tolist()
        suffix, span = self._suffix.tolist(), self._span.tolist()
        order: list[int] = []
        between: list[int] = []
        stack, depths, fresh = [0], [0], [True]
        while stack:
            v, depth, is_first = stack.pop(), depths.pop(), fresh.pop()
            if not is_first:
                between.append(depth)
            k = many[v]
            if not k:
                order.append(suffix[v])
                continue
            depth += span[v]
            a = begin[v]
            stack.extend(reversed(kids[a : a + k]))
            depths.extend([depth] * k)
            fresh.extend([False] * (k - 1))
            fresh.append(True)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank, np.array(between, np.int32)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes from i and from j have in common; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            out[here] = np.minimum(self._table[k][low[here]], self._table[k][high[here] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank; there is one for each but the last."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out[:-1], np.int64)


def runs_of(words: np.ndarray, conf: Runs = Runs()) -> np.ndarray:  # noqa: B008
    """Rows (start, length, period) of a stretch's runs, by start, then period. words: numbers of any kind, equal for equal words."""
    n = len(words)
    if n < max(conf.length, conf.times):
        return np.zeros((0, 3), np.int64)
    _, small = np.unique(words, return_inverse=True)
    tree = SuffixTree(small.tolist())
    at = np.arange(n)
    roots = [(at, next_smaller(tree.rank)), (at, next_smaller(tree.tour(-1)[0]))]
    i, j = (np.concatenate(x) for x in zip(*roots, strict=True))
    i, j = np.unique(np.stack([i, j], 1)[j < n], axis=0).T
    ahead = tree.common(i, j)
    del tree
    # A root's copies fill the run: one of the first has all but two periods ahead of it.
    fit = ahead >= np.maximum(conf.times * (j - i), conf.length) - 2 * (j - i)
    i, j, ahead = i[fit], j[fit], ahead[fit]
    if not len(i):
        return np.zeros((0, 3), np.int64)
    back = np.zeros(len(i), np.int64)
    inner = i > 0
    if inner.any():
        mirror = SuffixTree(small[::-1].tolist())
        back[inner] = mirror.common(n - i[inner], n - j[inner])
    period, start = j - i, i - back
    length = back + period + ahead
    fit = length >= np.maximum(conf.length, conf.times * period)
    found = np.unique(np.stack([start, period, length], 1)[fit], axis=0)
    return found[:, [0, 2, 1]]


def stretches(words: np.ndarray, conf: Runs = Runs()) -> list[tuple[int, int]]:  # noqa: B008
    """Disjoint or overlapping ranges of words, in each of which a run may lie, and in one of which each run lies whole."""
    n = conf.gram
    if len(words) < max(conf.length, conf.times):
        return []
    hashes = grams(mix(words.astype(np.uint64) + np.uint64(1)), n)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    earlier, later = order[:-1][same], order[1:][same]
    far = np.full(len(hashes), len(words), np.int64)
    far[later] = later - earlier
    again = np.zeros(len(hashes) + 2, np.int8)
    again[earlier + 1] = again[later + 1] = 1
    edges = np.diff(again)
    out = []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        size = b - a + n - 1
        if size >= conf.length and far[a:b].min() <= size // conf.times:
            out.append((a, a + size))
    return out


def document_runs(words: list[bytes], conf: Runs = Runs()) -> tuple[np.ndarray, list[bytes]]:  # noqa: B008
    """A document's runs, and its words without those that a run holds after its first period."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = []
    for a, b in stretches(numbers, conf):
        part = runs_of(numbers[a:b], conf)
        part[:, 0] += a
        found.append(part)
    if not found or not sum(map(len, found)):
        return np.zeros((0, 3), np.int64), words
    runs = np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
    return runs, [words[k] for k in kept]


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, conf: Runs = Runs(), id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:  # noqa: B008
    """doc_id, n_words, runs, collapsed: a row for each row of docs.

    runs are the maximal runs, by start, then period: start (a word's number, from 0), length and period in words. collapsed is the
    text's words, joined by one space, without those that any run holds after its first period. Words are what ASCII blanks (0x20,
    0x09 to 0x0D) part, as they are written. `change` makes other words of a document's before runs are looked for.
    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and ids give a row each, null ids
    too. Other columns of docs don't matter. An empty table gives no rows. A text is one task's work: its words are in memory, and
    for a repetitive stretch a suffix tree at a time, of some 700 bytes a word (measured on 200,000 words).
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            sizes, counts, every, joined = [], [], [np.zeros((0, 3), np.int64)], []
            for key, text in zip(ids.to_pylist(), texts, strict=True):
                words = (text.as_py() or "").encode().split()
                if change is not None:
                    words = change(key, words)
                runs, kept = document_runs(words, conf)
                sizes.append(len(words))
                counts.append(len(runs))
                every.append(runs)
                joined.append(b" ".join(kept).decode())
            flat = np.concatenate(every)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, struct), pa.array(joined, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def repeated_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """The query's documents: in one of ten, words from a place on repeat a stretch of the document. A null id's words stay."""
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def run_digests(found: DataFrame) -> DataFrame:
    """A row for each of periodic_runs: the number of runs, the longest (the first of equals, then the one of smallest period), and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 6 words and 4 periods in all documents, as `periodic_runs` states."""
    return run_digests(periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=repeated_tail))
