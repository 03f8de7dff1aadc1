"""Quality by logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features: single words and pairs of words (A-Z folded), and one to three successive word shapes (runs
of lower case, capitals, digits and each punctuation sign, so `ab###` and `xyz###` look alike), and whether a
word repeats the one before. Each is hashed to a bucket; a bucket's value is its share of the text's n-grams
of that kind. A score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.kernel import IS_SPACE, LONG_BYTES, Words, _power_tables, chunks, grams, mix, pieces
from sessionlake.llm.learning import held_out, labelled_sample, train
from sessionlake.llm.shared import columns, unused
from sessionlake.session import ship

THRESHOLD = 0.3


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.05
    epochs: int = 3
    #: At most about so many labelled rows are learnt from.
    max_rows: int = 10_000
    #: Runs of a word that have a place of their own in its shape; a word's later ones, in any order, count at the last place.
    runs: int = 64
    #: What each kind's shares are multiplied by: words, pairs, shapes, shape pairs, shape triples, repeats.
    scale: tuple[float, ...] = (2.0, 1.0, 4.0, 4.0, 4.0, 4.0)


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_SHAPE = mix(np.arange(1, 257, dtype=np.uint64))


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """A hash of each word's runs of character classes."""
    if len(data) > LONG_BYTES and (parts := [p for p in pieces(data)])[1:]:
        cut = [0, *np.searchsorted(start, [b for _, b in parts]).tolist()]
        return np.concatenate([_shapes(data[a:b], start[i:j] - a, end[i:j] - a, most) for (a, b), i, j in zip(parts, cut, cut[1:], strict=False)])
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    up, _ = _power_tables()
    # A run's place within its word, from how many runs began before the word's own first.
    runs = np.cumsum(new)
    place = np.zeros(len(data), np.int64)
    word = np.cumsum(np.bincount(start, minlength=len(data))[: len(data)]) - 1 if len(start) else place
    if len(start):
        place = np.minimum(runs - runs[start][np.maximum(word, 0)], most - 1)
        place[place < 0] = 0
    value = np.where(new & ~IS_SPACE[data], _SHAPE[kind] * up[place], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mix(total[end] - total[start])


def features(data: np.ndarray, offsets: np.ndarray, conf: Ftrl) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: buckets of all n-grams, and the first n-gram of each row (rows + 1 numbers)."""
    w = Words(data, offsets)
    shapes = _shapes(data, w.start, w.end, conf.runs)
    again = np.zeros(len(w.hash), np.uint64)
    again[1:] = w.hash[1:] == w.hash[:-1]
    shift = np.uint64(64 - conf.bits)
    for kind, (hashes, n) in enumerate(((w.hash, 1), (w.hash, 2), (shapes, 1), (shapes, 2), (shapes, 3), (again, 2))):
        if kind == 5:
            every = mix(again[1:] + np.uint64(977))
        else:
            every = grams(hashes, n) + np.uint64(kind)
        count = np.maximum(np.diff(w.first) - (n - 1), 0)
        # Of n-grams over row ends, none is kept.
        first = np.concatenate([[0], np.cumsum(count)])
        keep = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])
        yield (mix(every[keep]) >> shift).astype(np.int64), first


def dots(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, conf: Ftrl) -> np.ndarray:
    """Each row's sparse dot product; the last weight is the bias."""
    out = np.full(len(offsets) - 1, float(weights[-1]))
    for kind, (buckets, first) in enumerate(features(data, offsets, conf)):
        total = np.concatenate([[0.0], np.cumsum(weights[buckets].astype(np.float64))])
        count = np.diff(first)
        out += conf.scale[kind] * (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)
    return out


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]], conf: Ftrl) -> np.ndarray:
    """FTRL-proximal over (label, buckets, values) rows, in their order, `epochs` times; returns weights and bias."""
    size = (1 << conf.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= conf.l1, 0.0, -(zi - np.sign(zi) * conf.l1) / ((conf.beta + np.sqrt(n[i])) / conf.alpha + conf.l2))

    for _ in range(conf.epochs):
        for y, buckets, values in rows:
            w = weights(buckets)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - y) * values
            sigma = (np.sqrt(n[buckets] + g * g) - np.sqrt(n[buckets])) / conf.alpha
            z[buckets] += g - sigma * w
            n[buckets] += g * g
    return weights(slice(None)).astype(np.float32)


def training_rows(labels: list[int], column: pa.Array, conf: Ftrl) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    bias = 1 << conf.bits
    for row, after, data, offsets in chunks(column):
        kinds = list(features(data, offsets, conf))
        for k in range(after - row):
            buckets, values = [np.array([bias])], [np.ones(1)]
            for kind, (b, first) in enumerate(kinds):
                own, count = np.unique(b[first[k] : first[k + 1]], return_counts=True)
                buckets.append(own)
                values.append(count * (conf.scale[kind] / max(1, count.sum())))
            where, at = np.unique(np.concatenate(buckets), return_inverse=True)
            yield float(labels[row + k]), where.astype(np.int32), np.bincount(at, np.concatenate(values)).astype(np.float32)


def train_quality(docs: DataFrame, labels: DataFrame, conf: Ftrl = Ftrl(), label: str = "quality") -> np.ndarray:  # noqa: B008
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, conf.max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> bytes:
        rows = [r for b in batches for r in training_rows(b.column(0).to_pylist(), b.column(2), conf)]
        return fit(rows, conf).tobytes()

    return np.frombuffer(train(sample, [F.col("at"), F.col("text")], run), np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, conf: Ftrl = Ftrl(), text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:  # noqa: B008
    """docs with a score from 0 to 1 of each whole text. One scan, no shuffle; the weights (1 MB) go with the task.

    A null or empty text has the bias alone. Each row is treated by itself; an empty table gives none. A column of docs
    with the score's name is replaced; the other columns, or those in keep, stay. With no labelled rows all weights are 0 and scores 0.5.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != score_col] if keep is None else keep
    kept = docs.select(*columns(*keep))
    docs = docs.select(*columns(*keep), *(c.cast("string").alias(unused("text", keep)) for c in columns(text_col)))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [dots(data, offsets, weights, conf) for _, _, data, offsets in chunks(batch.column(n))]
            d = np.concatenate(parts) if parts else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(d, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(score)], names=[*keep, score_col])

    return docs.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op7_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
