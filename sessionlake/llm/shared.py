"""What the operators of this subpackage share: the folder all machines see, and streaming over sorted groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.session import ship


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a folder of this machine serves, for local runs only."""
    ship(spark)
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="sessionlake-")
    return f"{top.rstrip('/')}/sessionlake-{uuid.uuid4().hex}"


def columns(*names: str) -> list[Column]:
    """The columns of these names, whatever characters are in them."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def unused(name: str, names: list[str]) -> str:
    """The name, or one like it that no column has."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends at files that outlive an executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes shared files that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new key begins, the first row included."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by integer keys without nulls; one group is in memory at a time."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        at = [*_runs(columns).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, partitions: int | None = None, number: Column | None = None) -> DataFrame:
    """fn over each group of keys, whose rows come in the given order. fn gives a batch of the schema or None.

    The rows' bytes say little of the work in them, so the number of tasks is fixed: partitions, else the session's number
    of shuffle partitions. With number, a whole number that depends on the keys alone, groups are dealt by it in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for group in sorted_groups(batches, keys):
            got = fn(group)
            if got is not None and got.num_rows:
                out.append(got)
                rows += got.num_rows
            if rows >= 4096 or len(out) >= 1024:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, rows = [], 0
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, *keys) if number is None else df.repartitionById(n, F.pmod(number, F.lit(n)).cast("int"))
    return df.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
