"""Exact Jaccard self-join of word n-gram sets by R-trees of count vectors.

1. One scan makes each text's set of distinct shingles and a key of the whole set; equal sets form a class, whose least id
   stands for it. The same scan counts, task by task, the shingles that many texts share; a bounded table of the most
   frequent ones goes to all tasks. It only orders shingles, so whatever it misses costs time and no result.
2. A second scan hashes each set's shingles into groups and keeps the count of each: a point. Points have a power of two of
   coordinates, `per_group` shingles each at most, so that those of a finer grid fold onto a coarser one by sums. It also
   gives the set's cells: in an order of all shingles, rare ones first, the first n - ceil(t * n) + 1. Two sets that reach
   the similarity t share a cell, whatever the order is.
3. In each cell an R-tree is packed from the points. A set's overlap with any set below a node is at most the sum of
   coordinate minima of its point and the node's greatest corner; a node that this bound or the sizes rule out is skipped.
   Pairs already joined within a cell aren't searched again, so a cell of m gives m - 1 links at most.
4. The links' components are families, within which every pair that isn't joined yet is verified on the full sets.

A cell or a family is cut into blocks, each pair of which is a group of its own (`near_dup`). No pair is skipped, so
the result is that of comparing all pairs, but for equal 64-bit hashes of unlike shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.components import components
from sessionlake.llm.kernel import mix, shingle_sets
from sessionlake.llm.near_dup import NearDup, _blocks, _first, _joins, _number_of_blocks, _turn, confirmed
from sessionlake.llm.shared import map_sorted_groups, materialise, remove, shared_folder


@dataclass(frozen=True)
class CountTree:
    shingle: int = 5
    #: Two texts are linked if 100 * |intersection| >= percent * |union|.
    percent: int = 80
    #: Shingles of a coordinate at most, on average, and least number of coordinates.
    per_group: int = 4
    least_groups: int = 16
    #: Entries of a node.
    fan: int = 16
    #: A shingle counts as frequent from so many texts on; so many of the most frequent are known to all tasks.
    frequent: int = 64
    known: int = 1 << 17
    #: A task counts so many shingles at a time, and reports those that more than this share of the texts have.
    counted: int = 1 << 21
    share: float = 1 / 1024
    #: Members that are worth a block of their own, blocks of a cell for the work's sake, and coordinates in a block at most.
    worth: int = 128
    cell_spread: int = 4
    cell_block: int = 1 << 23
    #: How families are cut and verified.
    family_spread: int = 16
    family_block: int = 1_000_000

    def groups(self, n: int) -> int:
        """Coordinates of a set of n."""
        return max(self.least_groups, 1 << max(0, (-(-n // self.per_group) - 1).bit_length()))

    def cells(self, n: int) -> int:
        """Cells of a set of n."""
        return n - -(-n * self.percent // 100) + 1

    @property
    def verify(self) -> NearDup:
        return NearDup(shingle=self.shingle, percent=self.percent, worth=self.worth, family_spread=self.family_spread, family_block=self.family_block)


class Tree:
    """An R-tree packed from count vectors: rows of `points`, and their sets' sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int):
        order = np.concatenate(_packed(points, sizes, np.argsort(sizes, kind="stable"), fan)) if len(points) else np.zeros(0, np.int64)
        self.order, self.fan = order, fan
        corner, least, most = points[order], sizes[order], sizes[order]
        self.levels = [(corner, least, most)]
        while len(corner) > fan:
            at = np.arange(0, len(corner), fan)
            corner, least, most = np.maximum.reduceat(corner, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((corner, least, most))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose sets may reach the similarity with a set of this point and size."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least, most = self.levels[depth]
            nodes = nodes[may_reach(corner, least, most, nodes, point, size, percent)]
            if depth and len(nodes):
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def may_reach(corner: np.ndarray, least: np.ndarray, most: np.ndarray, nodes: np.ndarray, point: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which nodes may hold a set b with 100 * |a and b| >= percent * |a or b|, that is (100 + percent) * |a and b| >= percent * (|a| + |b|)."""
    smallest = np.maximum(least[nodes], -(-percent * size // 100))
    fit = smallest <= np.minimum(most[nodes], 100 * size // percent)
    at = nodes[fit]
    bound = np.minimum(corner[at], point).sum(axis=1, dtype=np.int64)
    fit[fit] = (100 + percent) * bound >= percent * (size + smallest[fit])
    return fit


def _packed(points: np.ndarray, sizes: np.ndarray, rows: np.ndarray, fan: int) -> list[np.ndarray]:
    """Rows in an order whose runs of `fan` lie close: split at the middle of the widest coordinate, in whole leaves."""
    done, todo = [], [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= fan:
            done.append(rows)
            continue
        part = points[rows].astype(np.float32)
        widest = int(part.var(axis=0).argmax())
        rows = rows[np.argsort(part[:, widest], kind="stable")]
        middle = max(fan, len(rows) // 2 // fan * fan)
        todo += [rows[middle:], rows[:middle]]
    return done


class Cell:
    """The points of a cell: a tree for each number of coordinates, and one folded to half of them for the next smaller sets."""

    def __init__(self, vectors: list[bytes], sizes: np.ndarray, conf: CountTree):
        self.conf, self.sizes = conf, sizes
        self.width = np.array([len(v) for v in vectors], np.int64)
        self.place = np.zeros(len(vectors), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.points: dict[tuple[int, int], np.ndarray] = {}
        self.trees: dict[tuple[int, int], Tree] = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.rows[w], self.place[rows] = rows, np.arange(len(rows))
            self.points[w, w] = np.frombuffer(b"".join([vectors[r] for r in rows]), np.uint8).reshape(-1, w)

    def at(self, w: int, to: int) -> np.ndarray:
        """Points of w coordinates, folded to fewer."""
        if (w, to) not in self.points:
            self.points[w, to] = self.points[w, w].reshape(-1, w // to, to).sum(axis=1, dtype=np.uint16)
        return self.points[w, to]

    def linked(self, row: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that the bound leaves."""
        size, w, percent, out = int(self.sizes[row]), int(self.width[row]), self.conf.percent, []
        for v in (x for x in (w // 2, w, w * 2) if x in self.rows):
            to = min(v, w)
            point = self.at(w, to)[self.place[row]]
            near = others[self.width[others] == v] if len(self.rows) > 1 else others
            if len(near) <= 4 * self.conf.fan:
                at = self.place[near]
                n = self.sizes[self.rows[v]]
                out.append(near[may_reach(self.at(v, to), n, n, at, point, size, percent)])
                continue
            if (v, to) not in self.trees:
                self.trees[v, to] = Tree(self.at(v, to), self.sizes[self.rows[v]], self.conf.fan)
            out.append(np.intersect1d(self.rows[v][self.trees[v, to].search(point, size, percent)], near, assume_unique=True))
        return np.sort(np.concatenate(out)) if out else others[:0]


def _set_key(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s + np.uint64(1)).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(2))))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def sets(docs: DataFrame, conf: CountTree) -> DataFrame:
    """A row for each text (doc_id, n_shingles, and key_hi and key_lo of its set, null without words), and rows of frequent shingles (shingle, texts)."""
    n = conf.shingle

    def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = times > max(2.0, conf.share * len(held))
        return every[often].view(np.int64), times[often]

    def rows(ids: pa.Array, size: np.ndarray, hi: np.ndarray, lo: np.ndarray, shingles: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
        none, more = size == 0, len(shingles)
        join = lambda a, b: pa.concat_arrays([a, b])
        return pa.RecordBatch.from_arrays(
            [
                join(ids.cast(pa.int64()), pa.nulls(more, pa.int64())),
                join(pa.array(size), pa.nulls(more, pa.int64())),
                join(pa.array(hi, mask=none), pa.nulls(more, pa.int64())),
                join(pa.array(lo, mask=none), pa.nulls(more, pa.int64())),
                join(pa.nulls(len(size), pa.int64()), pa.array(shingles)),
                join(pa.nulls(len(size), pa.int64()), pa.array(texts.astype(np.int64))),
            ],
            names=["doc_id", "n_shingles", "key_hi", "key_lo", "shingle", "texts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        total, nothing = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            keys = np.zeros((batch.num_rows, 2), np.uint64)
            found = [nothing]
            for row, s in shingle_sets(batch.column(1), n):
                size[row] = len(s)
                if not len(s):
                    continue
                key = _set_key(s)
                keys[row, 0], keys[row, 1] = key
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    total += len(s)
                if total >= conf.counted:
                    found.append(frequent(held))
                    held, seen, total = [], set(), 0
            k = keys.view(np.int64)
            yield rows(batch.column(0), size, k[:, 0].copy(), k[:, 1].copy(), *(np.concatenate(x) for x in zip(*found, strict=True)))
        if held:
            zero = np.zeros(0, np.int64)
            yield rows(pa.array([], pa.int64()), zero, zero, zero, *frequent(held))

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key_hi long, key_lo long, shingle long, texts long")


class Order:
    """Ranks of shingles: 0, or for those of the table the binary logarithm of how many texts have it."""

    def __init__(self, shingles: np.ndarray, texts: np.ndarray):
        at = np.argsort(shingles)
        self.shingles, self.rank = shingles[at], np.log2(np.maximum(texts[at], 1)).astype(np.int64)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(shingles >> np.uint64(44)).astype(np.int64)] = True

    def first(self, s: np.ndarray, many: int) -> np.ndarray:
        """The first `many` of sorted shingles by rank, then value."""
        maybe = np.flatnonzero(self.hint[(s >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return s[:many]
        at = np.minimum(np.searchsorted(self.shingles, s[maybe]), len(self.shingles) - 1)
        rank = np.zeros(len(s), np.int64)
        rank[maybe] = np.where(self.shingles[at] == s[maybe], self.rank[at], 0)
        return s[np.argsort(rank, kind="stable")[:many]]


def points(docs: DataFrame, frequent: list, conf: CountTree) -> DataFrame:
    """doc_id, n_shingles, key_hi, key_lo, point (a byte for each coordinate), cells, of each text that has words."""
    table = docs.sparkSession.sparkContext.broadcast((np.array([r.shingle for r in frequent], np.int64).view(np.uint64), np.array([r.texts for r in frequent], np.int64)))
    n = conf.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*table.value)
        for batch in batches:
            at: list[int] = []
            size: list[int] = []
            hi: list[int] = []
            lo: list[int] = []
            point: list[bytes] = []
            cells: list[np.ndarray] = []
            for row, s in shingle_sets(batch.column(1), n):
                if not len(s):
                    continue
                g = conf.groups(len(s))
                # A byte overflows only where 256 shingles of a set meet in a coordinate that has `per_group` on average.
                counts = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
                if counts.max() > 255:
                    raise OverflowError("a coordinate counts more than 255 shingles")
                key = _set_key(s)
                at.append(row)
                size.append(len(s))
                hi.append(key[0])
                lo.append(key[1])
                point.append(counts.astype(np.uint8).tobytes())
                cells.append(order.first(s, conf.cells(len(s))))
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(cells).view(np.int64) if cells else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(_signed(hi)), pa.array(_signed(lo)), pa.array(point, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "key_hi", "key_lo", "point", "cells"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key_hi long, key_lo long, point binary, cells array<long>")


def survivors(reps: DataFrame, conf: CountTree, folder: str) -> DataFrame:
    """Links (u, v) that join, within each cell, all pairs that the trees' bounds leave. Cells of equal members count once."""
    # Dealt by cell once: what is counted of the cells, and the join that keeps those of several members, read the same exchange,
    # as long as both read the same columns.
    spread = reps.select("doc_id", F.octet_length("point").alias("width"), F.explode("cells").alias("cell")).filter("cell is not null")
    spread = spread.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    stats = spread.groupBy("cell").agg(F.count("*").alias("n"), F.sum("width").alias("total"), F.bit_xor(F.xxhash64("doc_id")).alias("members")).filter("n > 1")
    kept = stats.groupBy("n", "total", "members").agg(F.min("cell").alias("cell")).select("cell", "n", "total")
    n_blocks = _number_of_blocks(F.col("n"), conf.worth, conf.cell_spread, F.col("total"), conf.cell_block)
    members = spread.join(kept, "cell").select("cell", "doc_id", "width", F.inline(_blocks(n_blocks, F.col("doc_id"))))
    members = materialise(members, f"{folder}/members")
    rows = members.drop("width").join(reps.select("doc_id", "n_shingles", "point"), "doc_id")

    def cell(group: pa.Table) -> pa.RecordBatch | None:
        ids = group.column("doc_id").to_numpy()
        here = Cell(group.column("point").to_pylist(), group.column("n_shingles").to_numpy(), conf)
        u, v = _joins(len(ids), _first(group), here.linked)
        return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return map_sorted_groups(rows, ["cell", "i", "j"], ["second", "doc_id"], cell, "u long, v long", number=_turn("cell"))


def ngram_join(docs: DataFrame, conf: CountTree = CountTree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id: a row for each row of docs; component_id is the least id reachable over links.

    Null and empty texts have n_shingles 0 and are linked with nothing; texts of fewer words than a shingle have one shingle, all of
    their words. Repeated rows give repeated rows; a repeated id whose texts differ has a row for each text. A null id keeps a
    null component and is linked with nothing. Other columns of docs don't matter. An empty table gives no rows. A text is one
    task's work in memory, some 40 bytes for each byte of it at the most.
    """
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = materialise(sets(texts, conf), f"{folder}/sets")
    found = both.filter("shingle is null")
    frequent = both.filter("shingle is not null").groupBy("shingle").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= conf.frequent).orderBy(F.desc("texts"), "shingle").limit(conf.known).collect()
    classes = materialise(found.filter("key_hi is not null and doc_id is not null").groupBy("key_hi", "key_lo").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), f"{folder}/classes")
    stand = classes.select(F.col("rep").alias("doc_id"), "key_hi", "key_lo")
    reps = points(texts, frequent, conf).join(stand, ["doc_id", "key_hi", "key_lo"], "left_semi")
    reps = materialise(reps.select("doc_id", "n_shingles", "point", "cells"), f"{folder}/reps")
    links = materialise(survivors(reps, conf, folder), f"{folder}/survivors")
    families = components(links, folder, "families").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"))
    families = materialise(families.join(sizes, "doc_id"), f"{folder}/families")
    remove(spark, f"{folder}/reps", f"{folder}/members", f"{folder}/survivors")
    verified = materialise(confirmed(texts, families, conf.verify, folder), f"{folder}/links")
    joined = components(verified, folder, "joined").select(F.col("node").alias("rep"), "component")
    known = materialise(classes.join(joined, "rep", "left").select("key_hi", "key_lo", F.coalesce("component", "rep").alias("component")), f"{folder}/known")
    out = found.select("doc_id", "n_shingles", "key_hi", "key_lo").join(known, ["key_hi", "key_lo"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op11_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of all documents at 0.8, as `ngram_join` states."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sets of shingles, their shared ones by an equality join, and components as least reachable ids.
OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
f AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
e AS MATERIALIZED (SELECT u AS a, v AS b FROM f UNION ALL SELECT v, u FROM f),
r AS (
  SELECT a AS doc_id, b AS least FROM e WHERE b < a
  UNION SELECT e.a, r.least FROM r JOIN e ON e.b = r.doc_id WHERE r.least < e.a),
c AS (SELECT doc_id, min(least) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(c.least, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
