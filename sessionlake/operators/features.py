"""Session features: counts, ratios, modes and gains of the events within each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import clip, ratio
from sessionlake.functions.quantiles import exact_quantiles, with_quantiles
from sessionlake.operators.sessions import session_events, session_stream, with_session_columns
from sessionlake.sources.telemetry import CAMPAIGN_TABLES, EXIT, LEVEL_TABLES, MODE_TABLES

#: Event table to the name of its count.
COUNTS = {
    "job_started": "jobs_started",
    "job_resumed": "jobs_resumed",
    "job_completed": "jobs_completed",
    "job_exited": "jobs_exited",
    "task_completed": "tasks_completed",
    "item_purchased": "items_purchased",
    EXIT: "exit_events_matched",
}

NUMERIC = ("duration_minutes", "days_since_previous_session", "player_lifetime_days", "jobs_started", "jobs_resumed", "jobs_completed", "jobs_exited", "tasks_completed", "items_purchased", "job_completion_ratio", "job_exit_ratio", "progression_gain", "campaign_progression_gain", "mode_diversity")
ACTIVITY = ("jobs_started", "jobs_resumed", "jobs_completed", "jobs_exited", "tasks_completed", "items_purchased")


def event_counts(assigned: DataFrame) -> DataFrame:
    """Events of each table in each session: conditional sums in one aggregate, which keeps the partitioning by player."""
    table = F.col("event_table")
    return session_events(assigned).groupBy("pid", "session_index").agg(*[F.count_if(table == t).alias(c) for t, c in COUNTS.items()])


def session_features(tele: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """A row for each session with 23 columns. Pairing, assignment, counts and gaps share one scan and one exchange by player."""
    table = F.col("event_table")
    mode = F.when(table.isin(*MODE_TABLES), F.nullif("game_mode", F.lit("")))
    span = lambda c, tables: F.max(F.when(table.isin(*tables), c)) - F.min(F.when(table.isin(*tables), c))
    grouped = (
        session_stream(tele, hot)
        .groupBy("pid", "session_index")
        .agg(
            F.min(F.when(F.col("starts"), F.col("event_time"))).alias("login_time"),
            F.max("exit_time").alias("exit_time"),
            *[F.count_if(table == t).alias(c) for t, c in COUNTS.items()],
            F.coalesce(F.mode(mode, True), F.lit("")).alias("primary_game_mode"),
            F.size(F.collect_set(mode)).cast("long").alias("mode_diversity"),  # as many as there are modes
            span(F.col("level_progress"), LEVEL_TABLES).alias("progression_gain"),
            span(F.col("campaign_progress"), CAMPAIGN_TABLES).alias("campaign_progression_gain"),
        )
    )
    begun = F.col("jobs_started") + F.col("jobs_resumed")
    return (
        with_session_columns(grouped, hot=hot)
        .select(
            "session_id", "pid", "session_index", "login_time", "exit_time", "duration_minutes", "days_since_previous_session", "player_lifetime_days",
            *COUNTS.values(), "progression_gain", "campaign_progression_gain", "primary_game_mode", "mode_diversity", "is_zero_duration", "is_long",
        )
        .withColumns({"job_completion_ratio": ratio(F.col("jobs_completed"), begun), "job_exit_ratio": ratio(F.col("jobs_exited"), begun)})
    )


def total(columns: tuple[str, ...]) -> Column:
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out + F.col(c)
    return out


def feature_sanity(features: DataFrame) -> DataFrame:
    """One row of counts and quantiles that a look at the table begins with."""
    per_player = F.percentile("n", F.lit(0.95))  # of numbers of sessions, few of which differ
    each = features.groupBy("pid").agg(F.count("*").alias("n")).agg(F.count("*").alias("players"), F.max("n").alias("max_sessions_per_player"), per_player.alias("p95_sessions_per_player"))
    out = features.agg(
        F.count("*").alias("sessions"),
        F.count_if("is_zero_duration").alias("zero_duration_sessions"),
        F.count_if("is_long").alias("long_sessions"),
        F.count_if(F.col("jobs_started") + F.col("jobs_resumed") == 0).alias("sessions_without_job"),
        F.count_if(F.col("primary_game_mode") == "").alias("sessions_without_mode"),
        F.count_if(F.col("items_purchased") > 0).alias("sessions_with_purchase"),
        F.count_if(F.col("job_completion_ratio") > 1).alias("completion_ratio_above_1"),
        F.count_if(F.col("days_since_previous_session") < 0).alias("negative_gaps"),
        F.max("duration_minutes").alias("duration_max"),
    )
    wanted = {"duration_p50": ("duration_minutes", 0.5), "duration_p95": ("duration_minutes", 0.95), "gap_days_p50": ("days_since_previous_session", 0.5)}
    return with_quantiles(out, features, [], wanted).crossJoin(each)  # one row each


#: Column to the feature it makes: winsorised at the 99th percentile, nulls 0, log1p.
WINSORISED = {
    "duration_minutes": "log_duration_minutes",
    "days_since_previous_session": "log_gap_days",
    "jobs_started": "log_jobs_started",
    "jobs_resumed": "log_jobs_resumed",
    "tasks_completed": "log_tasks_completed",
}
DISCOVERY = ("first_session", "no_started_or_resumed_job", *WINSORISED.values(), "purchase_any", "job_completion_ratio_capped", "job_exit_ratio_capped", "progression_gain", "mode_diversity")


def discovery_input(features: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Session keys and 12 numbers for finding states. The caps are exact quantiles over all rows, found first, in bounded memory."""
    caps = {c: q[0] for c, q in exact_quantiles(features, {c: [quantile] for c in (*WINSORISED, "progression_gain")}).items()}
    capped = lambda c: F.coalesce(clip(F.col(c).cast("double"), 0.0, caps[c]), F.lit(0.0))
    return features.select(
        "session_id", "pid", "session_index",
        F.col("days_since_previous_session").isNull().cast("int").alias("first_session"),
        (F.col("jobs_started") + F.col("jobs_resumed") == 0).cast("int").alias("no_started_or_resumed_job"),
        *[F.log1p(capped(c)).alias(name) for c, name in WINSORISED.items()],
        (F.col("items_purchased") > 0).cast("int").alias("purchase_any"),
        F.coalesce(clip(F.col("job_completion_ratio"), 0, 1), F.lit(0.0)).alias("job_completion_ratio_capped"),
        F.coalesce(clip(F.col("job_exit_ratio"), 0, 1), F.lit(0.0)).alias("job_exit_ratio_capped"),
        capped("progression_gain").alias("progression_gain"),
        F.col("mode_diversity").cast("double").alias("mode_diversity"),
    )


def discovery_sidecar(features: DataFrame) -> DataFrame:
    """What profiles need and state discovery doesn't see."""
    above = lambda c: F.coalesce(F.col(c) > 1, F.lit(False)).alias(f"{c}_gt_1")
    return features.select("session_id", "pid", "session_index", "player_lifetime_days", "jobs_completed", "jobs_exited", "items_purchased", "campaign_progression_gain", "primary_game_mode", "is_zero_duration", "is_long", above("job_completion_ratio"), above("job_exit_ratio"))


def transform_validation(features: DataFrame, discovery: DataFrame, tolerance: float = 1e-10, expected_rows: int | None = None) -> DataFrame:
    """A row for each of the 12 transforms: the largest difference to a recomputation, joined by session; and of the table: repeated keys, nulls, bounds."""
    again = discovery_input(features)
    both = discovery.select("session_id", *[F.col(c).cast("double").alias(c) for c in DISCOVERY]).join(again.select("session_id", *[F.col(c).cast("double").alias(f"again_{c}") for c in DISCOVERY]), "session_id", "full")
    gap = lambda c: F.max(F.abs(F.col(c) - F.col(f"again_{c}"))).alias(c)
    diffs = both.agg(*[gap(c) for c in DISCOVERY]).unpivot([], list(DISCOVERY), "check", "value")
    table = discovery.agg(
        (F.count("*") - F.count_distinct("session_id")).cast("double").alias("repeated_sessions"),
        sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in DISCOVERY), F.lit(0)).cast("double").alias("nulls"),
        F.count_if((F.col("job_completion_ratio_capped") > 1) | (F.col("job_exit_ratio_capped") > 1)).cast("double").alias("out_of_bounds"),
        *([F.abs(F.count("*") - expected_rows).cast("double").alias("row_count_gap")] if expected_rows is not None else []),
    )
    rows = table.unpivot([], table.columns, "check", "value")
    return diffs.unionByName(rows).withColumn("passed", F.coalesce(F.col("value") <= tolerance, F.lit(False)))


#: What becomes of each feature in state discovery, and why. The decisions are fixed values.
DECISIONS = (
    ("duration_minutes", "use_log1p_winsorized", "long tail"),
    ("days_since_previous_session", "use_log1p_with_first_session_indicator", "null is the first session"),
    ("player_lifetime_days", "exclude_from_main_discovery_use_for_interpretation", "describes the player, not the session"),
    ("jobs_started", "use_log1p_winsorized", "long tail"),
    ("jobs_resumed", "use_log1p_winsorized", "long tail"),
    ("jobs_completed", "drop_or_keep_only_for_completion_variant", "overlaps with tasks and the completion ratio"),
    ("jobs_exited", "drop_or_keep_only_for_exit_variant", "overlaps with the exit ratio"),
    ("tasks_completed", "use_log1p_winsorized", "long tail"),
    ("items_purchased", "use_binary_or_log1p_winsorized", "few sessions have any"),
    ("job_completion_ratio", "use_with_no_job_indicator", "null without jobs"),
    ("job_exit_ratio", "use_with_no_job_indicator", "null without jobs"),
    ("progression_gain", "use_winsorized", "long tail"),
    ("campaign_progression_gain", "drop_initially", "mostly missing"),
    ("primary_game_mode", "exclude_from_unsupervised_numeric_state_discovery", "a category"),
    ("mode_diversity", "use", "a small count"),
)
