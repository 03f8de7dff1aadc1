"""Telemetry: one row for each event, in the columns that the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import normalize_missing

LOGIN, EXIT = "player_logged_in", "exited_game"
#: Tables whose events are assigned to sessions, and which of them have which column.
EVENT_TABLES = ("job_started", "job_resumed", "job_exited", "job_completed", "task_completed", "item_purchased", EXIT)
MODE_TABLES = ("job_started", "job_resumed", "job_exited", "job_completed", EXIT)
LEVEL_TABLES = ("job_resumed", "job_exited", "task_completed", EXIT)
CAMPAIGN_TABLES = ("job_completed", "item_purchased", EXIT)
#: Names that the adapter gives modes. Fixed values.
MODES = ("Career", "FreePlay", "Special", "Challenge")


def telemetry(events: DataFrame) -> DataFrame:
    """event_id, pid, event_time, event_table, game_mode, level_progress, campaign_progress from the table `events`.

    Rows without a player or time are dropped. Views are logins and errors are exits; sign-ups, clicks and purchases
    stand for jobs, tasks and items, told apart by the number k in props.
    """
    k = F.expr("""try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT)""")
    kind = F.col("event_type")
    table: Column = (
        F.when(kind == "view", LOGIN)
        .when(kind == "error", EXIT)
        .when((kind == "signup") & (F.col("k") < 50), "job_started")
        .when(kind == "signup", "job_resumed")
        .when((kind == "click") & (F.col("k") < 70), "task_completed")
        .when((kind == "click") & (F.col("k") < 85), "job_completed")
        .when(kind == "click", "job_exited")
        .when(kind == "purchase", "item_purchased")
    )
    mode = F.when(F.col("k") % 10 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, MODES)), F.col("k") % 4 + 1))
    has = lambda tables, c: F.when(F.col("event_table").isin(*tables), c)
    return (
        events.select("event_id", F.col("user_id").cast("string").alias("pid"), F.col("ts").cast("timestamp").alias("event_time"), "event_type", "value", k.alias("k"))
        .filter("pid is not null and pid <> '' and event_time is not null")
        .withColumn("event_table", table)
        .filter("event_table is not null")
        .select(
            "event_id",
            "pid",
            "event_time",
            "event_table",
            has(MODE_TABLES, normalize_missing(mode)).alias("game_mode"),
            has(LEVEL_TABLES, F.col("value") / 100.0).alias("level_progress"),
            has(CAMPAIGN_TABLES, F.col("k") / 100.0).alias("campaign_progress"),
        )
    )
