"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Vectors are integers. Rows are dealt in blocks. In a block, each component's postings lie in segments by the
quantised size of their values, the largest first. A segment's impact for a query is its level plus the level of the
query's weight, both logarithmic, so it bounds the product of the two. A query takes segments in descending impact, over
all components at once, and adds their products up. What a row can still gain or lose lies in the components not met in it:
by Cauchy and Schwarz at most the norm of what is left of the query times the norm of what is left of the row. The search
stops when this proves all rows but a few out of the k best; those few are scored exactly.

Vectors of a norm from 2**31 on are kept beside the index: pairs with one of them are scored by whole numbers of any width.

Queries and rows meet in a grid of blocks, each of which holds a bounded number of both. The row blocks come in rounds,
each with a few times as many as the one before, and a round's searches start from the k-th best scores of earlier rounds.
Every cell gives k rows a query at most, and the cells' best are merged by ranks. No row is broadcast or collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.shared import map_sorted_groups, materialise, remove, shared_folder
from sessionlake.session import ship

#: Tasks of a round, at most; each takes one cell of the grid after another.
MOST_TASKS = 20_000


@dataclass(frozen=True)
class TopK:
    k: int = 10
    row_block: int = 16_384
    query_block: int = 256
    #: Segments of a component, and the least size of a segment's values as a share of the segment's before.
    levels: int = 20
    ratio: float = 0.85
    #: A search stops reading when at most this share of a block's rows, or 4 k of them, may be among the best.
    rest: float = 0.0625
    #: How many times as many row blocks a round has as the one before.
    growth: int = 4


@dataclass(frozen=True)
class Found:
    ids: np.ndarray
    scores: np.ndarray
    #: Postings read, and rows scored exactly.
    read: int
    rescored: int


#: Two vectors whose squared norms are below this have an inner product below 2**62.
NARROW = 2.0**62


def _whole(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers of any width."""
    return np.array([int(v) for v in vectors.ravel().tolist()], object).reshape(vectors.shape)


class ImpactIndex:
    """A block of vectors of whole numbers; segments of each component's postings by descending size of the value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, conf: TopK = TopK()):  # noqa: B008
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        values = vectors.astype(np.float64)
        wide = (values * values).sum(1) >= NARROW
        self.wide_ids, self.wide = ids[wide], _whole(vectors[wide])
        self.conf, self.ids, self.vectors = conf, ids[~wide], vectors[~wide].astype(np.int64)
        values = values[~wide]
        self.norms, self.most = (values * values).sum(1), float(np.abs(values).max(initial=0))
        level = self._levels(np.abs(values).T, self.most)
        self.rows = np.argsort(level, axis=1, kind="stable")
        self.values = np.take_along_axis(values.T, self.rows, 1)
        self.ends = np.stack([np.bincount(x, minlength=conf.levels).cumsum() for x in level]) if len(level) else np.zeros((0, conf.levels), np.int64)

    def _levels(self, size: np.ndarray, most: float) -> np.ndarray:
        """A size of level l is at most most * ratio**l, whatever the last level holds."""
        with np.errstate(divide="ignore", invalid="ignore"):
            exact = np.log(size / most) / log(self.conf.ratio) - 1e-9
        return np.where(size > 0, np.clip(np.nan_to_num(exact, posinf=self.conf.levels), 0, self.conf.levels - 1), self.conf.levels - 1).astype(np.int64)

    def search(self, query: np.ndarray, k: int, own: int, least: float = -np.inf) -> Found:
        """The k rows with the highest inner products, ties to smaller ids; rows with the id `own` take no part, nor need rows that score below `least`.

        A score among them that doesn't fit in a long is an error.
        """
        values = query.astype(np.float64)
        if float(values @ values) < NARROW:
            found = self._search(query, k, own, least)
            if not len(self.wide_ids):
                return found
        else:
            others = self.ids != own
            found = Found(self.ids[others], _whole(self.vectors[others]) @ _whole(query) if self.vectors.shape[1] else np.zeros(others.sum(), np.int64), 0, int(others.sum()))
        others = self.wide_ids != own
        pairs = [*zip(found.scores.tolist(), found.ids.tolist(), strict=True), *zip(self.wide[others] @ _whole(query), self.wide_ids[others].tolist(), strict=True)]
        best = sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]
        for score, row in best:
            if not -(1 << 63) <= score < 1 << 63:
                raise OverflowError(f"the inner product of query {own} and row {row} does not fit in a long")
        return Found(np.array([i for _, i in best], np.int64), np.array([s for s, _ in best], np.int64), found.read, found.rescored + int(others.sum()))

    def _search(self, query: np.ndarray, k: int, own: int, least: float) -> Found:
        n, dims = self.vectors.shape
        conf, q = self.conf, query.astype(np.int64)
        weight = q.astype(np.float64)
        own_levels, q_norm = self._levels(np.abs(weight), float(np.abs(weight).max(initial=0))), float(weight @ weight)
        total, met, left = np.zeros(n), np.zeros(n), self.norms.copy()
        possible = np.flatnonzero(self.ids != own)
        whole = not dims or q_norm == 0
        known, exact, read = np.zeros(n, bool), np.zeros(n, np.int64), 0

        def score(at: np.ndarray) -> np.ndarray:
            new = at[~known[at]]
            exact[new] = self.vectors[new] @ q
            known[new] = True
            return exact[at]

        slack = 1e-7 * (1 + np.sqrt(q_norm * self.norms.max(initial=0)))
        for impact in range(0 if whole else 2 * conf.levels - 1):
            segment = impact - own_levels
            at = np.flatnonzero((segment >= 0) & (segment < conf.levels))
            stops = self.ends[at, segment[at]]
            starts = np.where(segment[at] > 0, self.ends[at, segment[at] - 1], 0)
            some = stops > starts
            at, starts, stops = at[some].tolist(), starts[some].tolist(), stops[some].tolist()
            if at:
                rows = np.concatenate([self.rows[d, a:b] for d, a, b in zip(at, starts, stops, strict=True)])
                values = np.concatenate([self.values[d, a:b] for d, a, b in zip(at, starts, stops, strict=True)])
                by = np.repeat(weight[at], np.subtract(stops, starts))
                read += len(rows)
                total += np.bincount(rows, values * by, n)
                met += np.bincount(rows, by * by, n)
                left -= np.bincount(rows, values * values, n)
            if read == n * dims:
                whole = True
                break
            if read < n * dims // 8:
                continue
            to_come = np.sqrt(np.maximum(q_norm - met[possible], 0) * np.maximum(left[possible], 0)) + slack
            if len(possible) > k:
                likely = possible[np.argpartition(-total[possible], min(4 * k, len(possible) - 1))[: 4 * k]]
                least = max(least, float(np.sort(score(likely))[::-1][k - 1]))
            possible = possible[total[possible] + to_come >= least]
            if len(possible) <= max(4 * k, int(conf.rest * n)):
                break
        if whole and q_norm * self.norms.max(initial=0) < 2.0**104:  # all sums are of integers below 2**53
            scores = total[possible].astype(np.int64)
        else:
            scores = score(possible)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return Found(self.ids[possible[best]], scores[best], read, int(known.sum()))


def _block(ids, n: int, salt: int):
    return F.pmod(F.xxhash64(ids, F.lit(salt)), F.lit(n)).cast("int")


def top_k(rows: DataFrame, queries: DataFrame, conf: TopK = TopK()) -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id, score for each query; rows and queries: vec_id long, vector array of whole numbers.

    A query's own id takes no part among its rows. Ties go to the smaller id; fewer rows than k give fewer. Rows that
    repeat an id are each ranked; repeated queries give one result. Null ids or vectors take no part. Vectors of different
    lengths have no inner product: a query is answered from the rows of its own length. Vectors may be doubles that are whole
    numbers. Of any size: only a score among the k best that leaves the long is an error. Empty tables give no rows;
    other columns don't matter.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = "array<double>" if any("double" in dict(df.dtypes)["vector"] for df in (rows, queries)) else "array<long>"
    fine = lambda df: df.filter("vec_id is not null and vector is not null").select("vec_id", F.col("vector").cast(kind).alias("vector"))
    rows, queries = fine(rows), fine(queries)
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = -(-n_rows // conf.row_block) or 1, -(-n_queries // conf.query_block) or 1
    each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    k, folder, best, done = conf.k, shared_folder(spark), None, 0

    def cell(group: pa.Table) -> pa.RecordBatch | None:
        kind, ids, least = (group.column(c).to_numpy() for c in ("is_query", "vec_id", "least"))
        flat = pa.concat_arrays(group.column("vector").chunks).flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(ids), group.column("dims")[0].as_py())
        if not (kind == 0).any() or not (kind == 1).any():
            return None
        index = ImpactIndex(ids[kind == 0], vectors[kind == 0], conf)
        query, row, score = [], [], []
        for at in np.flatnonzero(kind == 1).tolist():
            if query and query[-1][:1] == ids[at]:
                continue
            found = index.search(vectors[at], k, int(ids[at]), float(least[at]))
            if len(found.ids):
                query.append(np.full(len(found.ids), ids[at]))
                row.append(found.ids)
                score.append(found.scores)
        if not query:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (query, row, score)], names=["query_id", "vec_id", "score"])

    rounds = 0
    while done < row_blocks:
        stop = min(row_blocks, 1 + done * (1 + conf.growth) if done else 1)
        dealt = rows.withColumn("rb", _block("vec_id", row_blocks, 1)).filter((F.col("rb") >= done) & (F.col("rb") < stop))
        dealt = dealt.select("rb", each(0, query_blocks).alias("qb"), F.lit(0).alias("is_query"), "vec_id", F.lit(float("-inf")).alias("least"), "vector")
        if best is None:
            asked = queries.withColumn("least", F.lit(float("-inf")))
        else:
            asked = queries.join(best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least")), "vec_id", "left").fillna(float("-inf"), ["least"])
        asked = asked.select(each(done, stop).alias("rb"), _block("vec_id", query_blocks, 2).alias("qb"), F.lit(1).alias("is_query"), "vec_id", "least", "vector")
        both = dealt.unionAll(asked).withColumn("dims", F.size("vector"))
        n = min((stop - done) * query_blocks, MOST_TASKS)
        found = map_sorted_groups(both, ["rb", "qb", "dims"], ["is_query", "vec_id", "vector"], cell, "query_id long, vec_id long, score long", n, (F.col("rb") - done) * query_blocks + F.col("qb"))
        if best is not None:
            found = found.unionAll(best.drop("rank"))
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        old, best = best, found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best = materialise(best, f"{folder}/round-{rounds}")
        if old is not None:
            remove(spark, f"{folder}/round-{rounds - 1}")
        done, rounds = stop, rounds + 1
    return best


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, vector: floor(scale * x) of each component, as a double. Vectors that are null or hold null or non-finite components are left out."""
    x, whole = F.col(vector_col).cast("array<double>"), 2.0**53  # from here on doubles are whole
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    floor = lambda v: F.when(F.abs(v) < whole, F.floor(F.when(F.abs(v) < whole, v)).cast("double")).otherwise(v)
    return embeddings.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: floor(v * scale)).alias("vector"))


def op4_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
