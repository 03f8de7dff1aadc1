"""Paths, typed CSV scans, and small sinks. Archives are in `archives`."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def resolve_path(explicit: str | None, variable: str, default: str, what: str, must_exist: bool = True) -> str:
    """The given path, else the environment variable's, else the default."""
    path = explicit or os.environ.get(variable) or default
    if must_exist and "://" not in path and not Path(path).exists():
        raise FileNotFoundError(f"{what} isn't at {path}; give a path or set {variable}")
    return path


def read_text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column as text, empty cells as empty texts, a byte order mark dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_event_csv(spark: SparkSession, path: str | list[str], table: str, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """pid, event_time, event_table and the asked columns; rows without a pid or a valid time are dropped, bad numbers are null."""
    return typed_events(read_text_csv(spark, path), F.lit(table), numbers, texts)


def typed_events(raw: DataFrame, table: Column, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """What `read_event_csv` gives, of a table of texts; table: the event table of a row."""
    keep: list[Column] = [F.col("pid"), F.try_to_timestamp("Time_utc").alias("event_time"), table.alias("event_table")]
    keep += [F.col(c) if c in raw.columns else F.lit("").alias(c) for c in texts]
    keep += [F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c) for c in numbers]
    return raw.select(*keep).filter((F.col("pid") != "") & F.col("event_time").isNotNull())


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def union_by_name(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, folder: str, bom: bool = False) -> None:
    """A folder of CSV parts with headers. bom: for spreadsheet readers, each part begins with a byte order mark; an empty table leaves no part with rows."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_small_csv(df: DataFrame, path: str, limit: int = 100_000) -> None:
    """One local file with a byte order mark, for report tables of bounded size; no rows give an empty file."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has more than {limit} rows; write it with write_csv")
    import csv

    with open(path, "w", encoding="utf-8-sig" if rows else "utf-8", newline="") as f:
        if rows:
            w = csv.writer(f)
            w.writerow(df.columns)
            w.writerows(rows)


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """A small result as a Markdown table; a last line says where rows beyond the limit were left out."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    rows = df.limit(limit + 1).collect()
    lines += ["| " + " | ".join(map(show, r)) + " |" for r in rows[:limit]]
    return "\n".join(lines + [f"\nOnly the first {limit} rows are shown."] * (len(rows) > limit))


def report(title: str, sections: dict[str, DataFrame], facts: dict[str, object] | None = None) -> str:
    """A Markdown report of small results."""
    parts = [f"# {title}", ""]
    parts += [f"- {k}: {json.dumps(v, default=str)}" for k, v in (facts or {}).items()]
    for name, df in sections.items():
        parts += ["", f"## {name}", "", markdown_table(df)]
    return "\n".join(parts) + "\n"


def typed_empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
