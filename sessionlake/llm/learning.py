"""What the two classifiers share: which labelled rows they learn from, and training in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_MOD = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; such rows are never learnt from. A null id isn't held out, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """y, at, text of at most about max_rows labelled documents that aren't held out, those with the least hashes of their ids.

    Ids with several labels count once, with the greatest; ids with several texts give each text once.
    The bound holds in expectation within a few per cent: the hash is compared with max_rows / labels. These bounded labels are
    broadcast, so a text is read where it lies, and moves only if it is learnt from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    at = F.xxhash64(F.col("doc_id"), F.lit(29))
    known = known.withColumn("at", at).filter(F.col("at") < F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("y", "at", F.coalesce("text", F.lit("")).alias("text"))


def train(sample: DataFrame, order: list[Column], fit: Callable[[Iterator[pa.RecordBatch]], bytes]) -> bytes:
    """The model that fit makes of the sample's rows, read in order by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([fit(batches)], pa.binary())], names=["model"])

    row = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").first()
    return bytes(row.model) if row else fit(iter(()))  # without rows no task runs
