"""The trie of conversation prefixes and totals of its subtrees, rolled up by bands of depth.

1. Turns are numbered within their conversation by one global sort: a row's number in the whole order less its
   conversation's first one. A conversation of any length is many tasks' work.
2. A prefix is known by the exclusive or of its turns' 128-bit hashes, each taken with the turn's place. Running ones are made in
   segments of bounded length and carried on from segment to segment.
3. A node's path within its band, at most `height` ancestors up to the band's root, is gathered from its conversation. Nodes add
   what they have to their band's root; roots alone are again a trie, `height` times flatter, and are rolled up in
   the same way. Then the roots' completed totals come down, a level at a time, and each node gives its own to its path. So
   a node explodes to `height` rows at most, and the rounds grow with the logarithm of the depth.
4. The ids that end at a node are one digest, which one task reads in order, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.shared import materialise, shared_folder

#: Turns of a segment, within which running values are made by one window.
SEGMENT = 4096
_PLACE = (1 << 33) - 1


def numbered(turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, a, b, chars) of each turn, at being its number in the whole order, and (conv_id, start, n) of each conversation.

    The order is by conv_id, turn (nulls first), role and text. What a task has sorted is numbered within the task; a table of the tasks' row
    counts, one row a task, makes these numbers whole.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null")
    # Equal rows are parted by chance, so that a range of the sort can end between them.
    rows = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text", F.rand(12))
    hashed = [F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in ((1, "a"), (2, "b"))]
    rows = materialise(rows.select("conv_id", F.monotonically_increasing_id().alias("id"), *hashed, F.length("text").cast("long").alias("chars")), f"{folder}/turns")
    task = F.shiftright("id", 33)
    tasks = rows.groupBy(task.alias("task")).agg(F.count("*").alias("rows"))
    before = tasks.select("task", (F.sum("rows").over(Window.orderBy("task")) - F.col("rows")).alias("before"))
    rows = rows.withColumn("task", task).join(F.broadcast(before), "task")  # a row for each task of the sort
    rows = rows.select("conv_id", (F.col("before") + F.col("id").bitwiseAND(F.lit(_PLACE))).alias("at"), "a", "b", "chars")
    return rows, materialise(rows.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n")), f"{folder}/conversations")


def grafted(turns: DataFrame, folder: str, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, a, b, chars) of rebuilt conversations, and (conv_id, turns) of each conversation, those without turns too.

    Conversation c begins with the first h turns of conversation c - c % every, or as many as that has, and goes on with its own
    turns after its first h; h is crc32 of c in decimals, modulo `most`. The remainder has c's sign.
    """
    rows, convs = numbered(turns, folder)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(base, "base", "left")
    convs = materialise(convs.withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0)))), f"{folder}/grafts")
    own = rows.join(convs.select("conv_id", "start", "h", "lead"), "conv_id").withColumn("index", F.col("at") - F.col("start"))
    own = own.filter("index >= h").select("conv_id", (F.col("index") - F.col("h") + F.col("lead")).alias("pos"), "a", "b", "chars")
    first = rows.filter(F.col("conv_id") % every == 0).join(convs.select("conv_id", "start"), "conv_id").select(F.col("conv_id").alias("base"), (F.col("at") - F.col("start")).alias("pos"), "a", "b", "chars").filter(F.col("pos") < most)
    lead = first.join(convs.select("base", "conv_id", "lead"), "base").filter("pos < lead").select("conv_id", "pos", "a", "b", "chars")
    sizes = convs.select("conv_id", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
    return own.unionByName(lead), sizes


def _key(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def prefixes(turns: DataFrame, folder: str) -> DataFrame:
    """(conv_id, depth, key, parent, chars) of each prefix that ends with a turn: keys of it and of the prefix without that turn.

    turns: conv_id, pos (from 0, without gaps), a, b, chars.
    """
    turns = turns.select("conv_id", "pos", F.floor(F.col("pos") / SEGMENT).alias("segment"), F.xxhash64("pos", "a").alias("a"), F.xxhash64("pos", "b").alias("b"), "chars")
    turns = materialise(turns, f"{folder}/rebuilt")
    whole = turns.groupBy("conv_id", "segment").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"))
    upto = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Only conversations of several segments carry anything on.
    carried = whole.join(whole.filter("segment > 0").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", (F.col("segment") + 1).alias("segment"), *(F.bit_xor(c).over(upto).alias(c) for c in ("ca", "cb")))
    here = Window.partitionBy("conv_id", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    rows = turns.withColumns({"xa": F.bit_xor("a").over(here), "xb": F.bit_xor("b").over(here)}).join(carried, ["conv_id", "segment"], "left")
    rows = rows.withColumns({"xa": F.col("xa").bitwiseXOR(F.coalesce("ca", zero)), "xb": F.col("xb").bitwiseXOR(F.coalesce("cb", zero))})
    parent = _key(F.col("xa").bitwiseXOR(F.col("a")), F.col("xb").bitwiseXOR(F.col("b")))
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), _key(F.col("xa"), F.col("xb")).alias("key"), parent.alias("parent"), "chars")


def _paths(rows: DataFrame, height: int) -> DataFrame:
    """rows with their path: the keys of their ancestors within the band, from the band's root on."""
    band = Window.partitionBy("conv_id", F.floor((F.col("depth") - 1) / height)).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("path", F.collect_list("parent").over(band))


def _nodes(rows: DataFrame) -> DataFrame:
    """key, depth, path of each node; its prefixes all have the same."""
    return rows.groupBy("key").agg(F.any_value("depth").alias("depth"), F.any_value("path").alias("path"))


def rollup(rows: DataFrame, own: DataFrame, values: list[str], height: int, folder: str) -> DataFrame:
    """key and the values' totals over the node's subtree, itself included.

    rows: conv_id, depth (from 1), key, parent of each prefix. own: key and the values of each node, the root (key 0, 0) included.
    """
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    levels, level = [], 0
    is_root = F.col("depth") % height == 0
    while True:
        rows = materialise(_paths(rows, height), f"{folder}/paths-{level}")
        nodes = materialise(_nodes(rows).join(own, "key"), f"{folder}/nodes-{level}")
        levels.append((nodes, own))
        if deepest <= height:
            break
        # Roots of bands, with what the nodes between them and the next roots have, are the next level's trie.
        inner = nodes.filter(~is_root).groupBy(F.col("path")[0].alias("key")).agg(*(F.sum(v).alias(f"more_{v}") for v in values))
        roots = nodes.filter(is_root).select("key").unionByName(own.filter(_is_top("key")).select("key"))
        own = own.join(roots, "key", "left_semi").join(inner, "key", "left").select("key", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
        own = materialise(own, f"{folder}/roots-{level}")
        rows = rows.filter(is_root).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "key", F.col("path")[0].alias("parent"))
        deepest, level = deepest // height, level + 1
    total = None
    for k in range(level, -1, -1):
        nodes, own = levels[k]
        if total is None:
            given = nodes.select("key", "path", *values)
            known, hide = own, F.lit(0)
        else:
            # A band's root has its whole total from above; the others sum what comes up within the band.
            done = total.select("key", *(F.col(v).alias(f"whole_{v}") for v in values))
            given = nodes.join(done, "key", "left").select("key", "path", *(F.coalesce(f"whole_{v}", v).alias(v) for v in values))
            known, hide = own.join(total.select("key"), "key", "left_anti"), F.lit(1)
        up = given.select(F.explode(F.slice("path", hide + 1, F.greatest(F.size("path") - hide, F.lit(0)))).alias("key"), *values)
        summed = known.select("key", *values).unionByName(up).groupBy("key").agg(*(F.sum(v).alias(v) for v in values))
        total = materialise(summed if total is None else summed.unionByName(total), f"{folder}/totals-{k}")
    return total


def _is_top(key: str) -> Column:
    return (F.col(f"{key}.a") == 0) & (F.col(f"{key}.b") == 0)


def end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256, of the ascending ids (conv_id) that end at each key, joined by commas. A key's ids pass one task in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != last:
                    if digest is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = (a, b), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "ends_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["a", "b", "ends_sha256"])

    rows = ends.select("key.a", "key.b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    return rows.mapInArrow(run, "a long, b long, ends_sha256 string").select(_key(F.col("a"), F.col("b")).alias("key"), "ends_sha256")


def prefix_trie(turns: DataFrame, sizes: DataFrame, folder: str, height: int = 8) -> DataFrame:
    """A row for each distinct prefix of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos, a, b, chars; sizes: conv_id and turns, of conversations without turns too: these are members of the root alone.
    No conversations give no rows, not even a root.
    """
    rows = materialise(prefixes(turns, folder), f"{folder}/prefixes")
    zero = F.lit(0).cast("long")
    top = _key(zero, zero)
    nodes = rows.groupBy("key").agg(F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.any_value("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(top.alias("key"), zero.alias("depth"), F.lit(None).cast("struct<a:long,b:long>").alias("parent"), zero.alias("chars"), "conv_id", "n_convs")
    nodes = nodes.unionByName(root)
    children = rows.select("parent", "key").distinct().groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialise(nodes, f"{folder}/trie")
    own = nodes.select("key", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rollup(rows.select("conv_id", "depth", "key", "parent"), own, ["n_leaves", "saved_tokens"], height, folder)
    # A conversation ends at its longest prefix.
    ends = rows.join(sizes.filter("turns > 0").select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"], "left_semi").select("key", "conv_id")
    ends = ends.unionByName(sizes.filter("turns = 0").select(top.alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent", "left").join(totals, "key").join(end_digests(ends), "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, every: int = 100, most: int = 6, height: int = 8) -> DataFrame:
    """The trie of rebuilt conversations (`grafted`); columns as `prefix_trie` gives them.

    conversations: conv_id, turn, role, text. Null roles and texts are empty; turns without a number come first; equal numbers go by role
    and text, so equal rows need no order. Repeated rows are turns of their own. Rows without a conv_id are in no conversation. Other
    columns don't matter. An empty table gives no rows.
    """
    folder = shared_folder(conversations.sparkSession)
    turns, sizes = grafted(conversations, folder, every, most)
    return prefix_trie(turns, sizes, folder, height)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, in bands of 8 turns, as `conversation_trie` states."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 by its table, a decimal at a time; prefixes as chained digests; each node meets its ancestors by its first conversation.
OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
byte AS MATERIALIZED (SELECT i, v FROM bits WHERE k = 8),
ids AS MATERIALIZED (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, s, 1 AS k, 4294967295::BIGINT AS v FROM ids
  UNION ALL SELECT c, s, k + 1, xor(b.v, crc.v >> 8) FROM crc JOIN byte b ON b.i = xor(crc.v & 255, ord(s[k])) WHERE k <= len(s)),
h AS MATERIALIZED (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = len(s) + 1),
t AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT h.c, 0 AS part, t.i, role, text FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i <= h.h
  UNION ALL SELECT h.c, 1, t.i, role, text FROM h JOIN t ON t.c = h.c AND t.i > h.h),
o AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, sha256(role || chr(0) || text) AS x, length(text) AS chars FROM r),
p AS MATERIALIZED (
  SELECT c, 0::BIGINT AS d, '' AS key, NULL::VARCHAR AS parent, 0::BIGINT AS chars FROM ids
  UNION ALL SELECT p.c, o.d, sha256(p.key || o.x), p.key, o.chars FROM p JOIN o ON o.c = p.c AND o.d = p.d + 1),
n AS MATERIALIZED (SELECT key, any_value(d) AS d, any_value(parent) AS parent, any_value(chars) AS chars, min(c) AS c, count(*) AS n_convs FROM p GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.key = n.key),
u AS (SELECT p.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens FROM m JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY p.key),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
e AS (SELECT key, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN l ON l.c = p.c AND l.d = p.d GROUP BY key)
SELECT m.c AS conv_id, m.d AS depth, q.c AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN u ON u.key = m.key LEFT JOIN m q ON q.key = m.parent LEFT JOIN e ON e.key = m.key
"""
