"""Near-duplicate components of documents by banded MinHash with sequential Bayesian verification.

1. One scan makes each text's set of distinct word shingles, a key of the whole set, MinHash values
   and their band hashes. Equal sets form a class; its least id stands for it from here on.
2. Classes that share a band hash form a bucket. Buckets with equal members count once. Within a bucket,
   signatures are compared a batch of positions at a time: a pair is dropped as soon as the posterior chance
   that its similarity reaches the threshold falls below the chosen miss probability. Pairs already
   joined within the bucket aren't compared again, so a bucket of m gives m - 1 links at most.
3. Those links' components are families. Each family's texts are brought together once, and links inside
   it are confirmed on the full sets, as sets of 64-bit hashes of shingles; the confirmed links' components are the result.

A bucket or family is cut into blocks, each pair of which is a group of its own: up to a few blocks for the work's sake,
so that one of thousands of members is many tasks' work and its rows move so many times at most, and more only where
memory asks for them. No pair is skipped. Chance of missing a pair at the threshold: (1 - t**rows)**bands for the
bands (1e-9 at 0.85, 4e-7 at 0.8) and `miss` for the pruning. Texts of no words are in no class.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.components import components
from sessionlake.llm.kernel import mix, shingle_sets
from sessionlake.llm.shared import columns, map_sorted_groups, materialise, remove, shared_folder


FILTER_BUCKETS = 1 << 20


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    #: Two texts are linked if 100 * |intersection| >= percent * |union|.
    percent: int = 85
    bands: int = 28
    rows: int = 4
    miss: float = 1e-6
    batch: int = 16
    #: Members that are worth a block of their own, and blocks of a bucket and of a family for the work's sake at most.
    worth: int = 128
    bucket_spread: int = 4
    family_spread: int = 16
    #: At most so many signatures in a block of a bucket, and shingles in a block of a family, for memory's sake.
    bucket_block: int = 20_000
    family_block: int = 1_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(85)
    return (r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], r.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def min_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of a * x + b modulo 2**32 over the upper halves of the hashes, for each (a, b)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        block = x[k : k + 1024] * a
        block += b
        np.minimum(least, block.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, conf: NearDup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, key_hi and key_lo (null without words), sig (16 bits a hash), bands."""
    n_bands, n_rows, n = conf.bands, conf.rows, conf.shingle

    def run(batches):
        a, b = _permutations(n_bands * n_rows)
        steps = np.random.default_rng(3).integers(1, 1 << 63, n_rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            rows = batch.num_rows
            size, key = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
            sig, bands = np.zeros((rows, n_bands * n_rows), np.uint16), np.zeros((rows, n_bands), np.uint64)
            for row, s in shingle_sets(batch.column(1), n):
                size[row] = len(s)
                if not len(s):
                    continue
                key[row, 0] = mix(s + np.uint64(1)).sum(dtype=np.uint64)
                key[row, 1] = np.bitwise_xor.reduce(mix(s + np.uint64(2)))
                m = min_hashes(s, a, b)
                sig[row] = (m ^ (m >> np.uint32(16))).astype(np.uint16)
                wide = m.astype(np.uint64).reshape(n_bands, n_rows)
                bands[row] = (wide * steps[:n_rows]).sum(axis=1, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64) * steps[n_rows]
            none = size == 0
            bands = mix(bands)
            width = sig.shape[1] * 2
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(size),
                    pa.array(key[:, 0].view(np.int64), mask=none),
                    pa.array(key[:, 1].view(np.int64), mask=none),
                    pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.py_buffer(sig.tobytes())]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * n_bands, n_bands, dtype=np.int32)), pa.array(bands.view(np.int64).ravel())),
                ],
                names=["doc_id", "n_shingles", "key_hi", "key_lo", "sig", "bands"],
            )

    schema = "doc_id long, n_shingles long, key_hi long, key_lo long, sig binary, bands array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def least_matches(conf: NearDup) -> list[int]:
    """For each batch: the least matches so far with which a pair may still reach the threshold.

    With a uniform prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1), and
    P(similarity >= t) is P(Binomial(n + 1, t) <= m). The miss probability is shared out among batches.
    """
    t, ends = conf.percent / 100, [min(k, conf.hashes) for k in range(conf.batch, conf.hashes + conf.batch, conf.batch)]
    out = []
    for n in ends:
        total, m = 0.0, -1
        while total < conf.miss / len(ends):
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def similar(sig: np.ndarray, one: np.ndarray, others: np.ndarray, batch: int, least: list[int]) -> np.ndarray:
    """Those of the others (row numbers) that the posterior bounds don't part from `one`."""
    found = np.zeros(len(others), np.int32)
    for k, m in enumerate(least):
        part = slice(k * batch, (k + 1) * batch)
        found += (sig[others, part] == one[part]).sum(axis=1, dtype=np.int32)
        stay = found >= m
        others, found = others[stay], found[stay]
        if not len(others):
            break
    return others


def _spread(rows: np.ndarray, linked) -> np.ndarray:
    """Each of the rows' component (a row of it), where linked(row, others) gives the others that it is linked with."""
    label, left, at = np.arange(rows[-1] + 1 if len(rows) else 0), rows, 0
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, at, left = [int(left[0])], int(left[0]), left[1:]
        got = linked(queue.pop(), left)
        if len(got):
            label[got] = at
            queue.extend(got.tolist())
            left = left[~np.isin(left, got, assume_unique=True)]
    return label[rows]


def _joins(n: int, first: int, linked) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and rows to link them to, that join the components of n rows.

    The first ones and the others may be two blocks, each of which another group joins by itself: then only what the two together
    join is given, from one row of each block's components.
    """
    label = _spread(np.arange(n), linked)
    if first in (0, n):
        rows = np.flatnonzero(label != np.arange(n))
        return rows, label[rows]
    heads = []
    for part in (np.arange(first), np.arange(first, n)):
        alone = _spread(part, linked)
        heads.append(part[alone == part])
    rows = np.concatenate(heads)
    # One head stands for each component of both.
    _, at, of = np.unique(label[rows], return_index=True, return_inverse=True)
    to = rows[at][of]
    return rows[rows != to], to[rows != to]


def _number_of_blocks(members: Column, worth: int, spread: int, size: Column, most: int) -> Column:
    of = lambda n, per: F.ceil(n / F.lit(per)).cast("long")
    return F.greatest(of(size, most), F.least(of(members, worth), F.lit(spread)), F.lit(1).cast("long"))


def _blocks(n_blocks: Column, doc: Column) -> Column:
    """The pairs of blocks that a document's own one is in: i and j, i not above j, and whether the own one is j alone."""
    own = F.pmod(F.xxhash64(doc, F.lit(11)), n_blocks)
    return F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own > k).alias("second")))


def _turn(key: str) -> Column:
    """A number for a pair of blocks of a group: its pairs follow one another, so they come to different tasks."""
    return F.shiftright(F.xxhash64(key), 2) + F.expr("j * (j + 1) div 2 + i")


def survivors(sigs: DataFrame, conf: NearDup, folder: str) -> DataFrame:
    """Links (u, v) that join, within each bucket, all pairs that the posterior bounds leave."""
    spread = sigs.select("doc_id", F.explode("bands").alias("bucket"))
    stats = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("members")).filter("n > 1")
    kept = stats.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    kept = materialise(kept, f"{folder}/buckets")
    n_blocks = _number_of_blocks(F.col("n"), conf.worth, conf.bucket_spread, F.col("n"), conf.bucket_block)
    pairs = _blocks(n_blocks, F.col("doc_id"))
    members = spread.join(kept, "bucket").select("bucket", "doc_id", F.inline(pairs))
    rows = members.join(sigs.select("doc_id", "sig"), "doc_id")
    batch, least, width = conf.batch, least_matches(conf), conf.hashes

    def bucket(group: pa.Table) -> pa.RecordBatch | None:
        ids = group.column("doc_id").to_numpy()
        data = group.column("sig").combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        _, offsets, raw = data.buffers()
        start = np.frombuffer(offsets, np.int32)[data.offset]
        sig = np.frombuffer(raw, np.uint16, len(ids) * width, start).reshape(len(ids), width)
        u, v = _joins(len(ids), _first(group), lambda r, others: similar(sig, sig[r], others, batch, least))
        return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return map_sorted_groups(rows, ["bucket", "i", "j"], ["second", "doc_id"], bucket, "u long, v long", number=_turn("bucket"))


def _first(group: pa.Table) -> int:
    """How many of a group's rows are of its first block."""
    return group.num_rows - int(group.column("second").combine_chunks().to_numpy(zero_copy_only=False).sum())


def _number(doc: str) -> Column:
    """One of FILTER_BUCKETS numbers for an id."""
    return F.pmod(F.xxhash64(F.col(f"`{doc}`").cast("long"), F.lit(5)), F.lit(FILTER_BUCKETS))


def confirmed(texts: DataFrame, families: DataFrame, conf: NearDup, folder: str) -> DataFrame:
    """Links (u, v) between texts of a family whose components are those of all links on full sets.

    texts: doc_id, text. families: doc_id, family, n_shingles.
    """
    size = materialise(families.groupBy("family").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("members")), f"{folder}/family-sizes")
    n_blocks = _number_of_blocks(F.col("members"), conf.worth, conf.family_spread, F.col("total"), conf.family_block)
    pairs = _blocks(n_blocks, F.col("doc_id"))
    # Texts outside of families mostly stay where they are: the broadcast side has at most FILTER_BUCKETS numbers at any scale.
    texts = texts.join(F.broadcast(families.select(_number("doc_id").alias("b")).distinct()), _number("doc_id") == F.col("b"), "left_semi")
    rows = families.join(size, "family").join(texts, "doc_id").select("family", F.inline(pairs), "doc_id", "text")
    percent, n = conf.percent, conf.shingle

    def family(group: pa.Table) -> pa.RecordBatch | None:
        ids = group.column("doc_id").to_numpy()
        sets = [s for _, s in shingle_sets(group.column("text"), n)]
        sizes = np.array([len(s) for s in sets], np.int64)
        every, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])

        def linked(r: int, others: np.ndarray) -> np.ndarray:
            a, b = sizes[r], sizes[others]
            others = others[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
            if not len(others):
                return others
            if len(others) < len(ids) // 8:
                parts = [sets[o] for o in others]
                flat, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes[others])])[:-1]
                shared = np.add.reduceat(_within(flat, sets[r]), at)
            else:
                shared = np.add.reduceat(_within(every, sets[r]), first[:-1])[others]
            return others[100 * shared >= percent * (a + sizes[others] - shared)]

        u, v = _joins(len(ids), _first(group), linked)
        return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return map_sorted_groups(rows, ["family", "i", "j"], ["second", "doc_id"], family, "u long, v long", number=_turn("family"))


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return (ordered[at] == x).astype(np.int64)


def near_duplicates(docs: DataFrame, conf: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    component_id is the least id reachable over links; kept is true where it is the row's own. Null and empty
    texts have n_shingles 0 and are linked with nothing. Repeated rows give repeated rows; a repeated id whose
    texts differ has a row for each text. A null id keeps a null
    component, kept false, and is linked with nothing. Other columns of docs don't matter. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = materialise(signatures(texts, conf), f"{folder}/signatures")
    classes = materialise(sigs.filter("key_hi is not null and doc_id is not null").groupBy("key_hi", "key_lo").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), f"{folder}/classes")
    stand = classes.select(F.col("rep").alias("doc_id"), "key_hi", "key_lo")
    reps = sigs.join(stand, ["doc_id", "key_hi", "key_lo"], "left_semi")
    reps = materialise(reps.select("doc_id", "sig", "bands"), f"{folder}/reps")
    links = materialise(survivors(reps, conf, folder), f"{folder}/survivors")
    families = components(links, folder, "families").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"))
    families = materialise(families.join(sizes, "doc_id"), f"{folder}/families")
    remove(spark, f"{folder}/reps", f"{folder}/buckets", f"{folder}/survivors")
    found = materialise(confirmed(texts, families, conf, folder), f"{folder}/links")
    joined = components(found, folder, "joined").select(F.col("node").alias("rep"), "component")
    known = materialise(classes.join(joined, "rep", "left").select("key_hi", "key_lo", F.coalesce("component", "rep").alias("component")), f"{folder}/known")
    out = sigs.select("doc_id", "n_shingles", "key_hi", "key_lo").join(known, ["key_hi", "key_lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sets of shingles, their shared ones by an equality join, and components as least reachable ids.
OP8_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
f AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS MATERIALIZED (SELECT u AS a, v AS b FROM f UNION ALL SELECT v, u FROM f),
r AS (
  SELECT a AS doc_id, b AS least FROM e WHERE b < a
  UNION SELECT e.a, r.least FROM r JOIN e ON e.b = r.doc_id WHERE r.least < e.a),
c AS (SELECT doc_id, min(least) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(c.least, d.doc_id), d.doc_id) AS component_id, coalesce(c.least, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


#: Where no contract says otherwise, texts are near-duplicates from a similarity of 0.8 on.
STAGE = NearDup(percent=80)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: one document of each component stays, that with the least id; all columns as they are.

    Equal rows stay or go together, as they share their id. Rows with a null id, and null or empty texts, stay. An empty table gives
    no rows; other columns may have any name.
    """
    found = near_duplicates(docs, STAGE)
    gone = found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    gone = materialise(gone, f"{shared_folder(spark)}/gone")
    # Documents ride in one column, so that no name of theirs can clash. Most are in no bucket of those that go, and stay
    # without being shuffled; the others meet the ids themselves.
    held = docs.select(F.struct(*columns(*docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    marks = F.broadcast(gone.select(_number("gone").alias("bucket")).distinct())  # at most FILTER_BUCKETS numbers
    here = _number("id") == F.col("bucket")
    unsure = held.join(marks, here, "left_semi").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return held.join(marks, here, "left_anti").unionByName(unsure).select("doc.*")
