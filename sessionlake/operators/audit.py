"""Audits of raw event tables: one aggregate over all tables for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import is_missing


def table_audit(tele: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, players, first and last times of each table, and its fields' largest share of missing values."""
    shares = [F.count_if(is_missing(F.col(c))) * 100.0 / F.count("*") for c in fields]
    return tele.groupBy("event_table").agg(
        F.count("*").alias("rows"),
        F.countDistinct("pid").alias("players"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        F.greatest(*shares).alias("max_missing_pct"),
    )


def bad_times(raw: DataFrame, time: Column) -> DataFrame:
    """Rows of a raw text table whose time doesn't parse."""
    return raw.agg(F.count("*").alias("rows"), F.count_if(F.try_to_timestamp(time).isNull()).alias("bad_times"))


def column_missingness(tele: DataFrame, fields: list[str]) -> DataFrame:
    """Missing values of each table's fields, a row for each."""
    counts = tele.groupBy("event_table").agg(F.count("*").alias("rows"), *[F.count_if(is_missing(F.col(c))).alias(c) for c in fields])
    return counts.unpivot(["event_table", "rows"], fields, "column", "missing").withColumn("missing_pct", F.col("missing") * 100.0 / F.col("rows"))


def duplicate_excess(tele: DataFrame) -> DataFrame:
    """Rows beyond the first of each (player, time) in a table."""
    return tele.groupBy("event_table", "pid", "event_time").count().groupBy("event_table").agg(F.sum(F.col("count") - 1).alias("duplicate_rows"))


def player_coverage(tele: DataFrame) -> DataFrame:
    """Players over all tables, and how many of them each table has."""
    seen = tele.select("pid", "event_table").distinct()
    return seen.groupBy("pid").agg(F.count("*").alias("tables")).groupBy("tables").agg(F.count("*").alias("players"))


def event_name_counts(tele: DataFrame) -> DataFrame:
    """Each table's modes and their counts as a JSON text, names ascending."""
    counts = tele.filter("game_mode is not null").groupBy("event_table", "game_mode").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("game_mode").alias("name"), F.col("n"))))  # as many as there are modes
    return counts.groupBy("event_table").agg(F.to_json(listed).alias("event_names"))
