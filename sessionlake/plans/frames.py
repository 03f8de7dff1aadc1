"""The chain of frames that the registered queries start from, each a lazy plan over the `events` table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions.segments import hot_keys
from sessionlake.operators import censoring, features, recovery, rigidity, sequences, sessions, transitions
from sessionlake.sources.files import read_parquet
from sessionlake.sources.telemetry import telemetry


class Frames:
    def __init__(self, spark: SparkSession, folder: str, conf: Config = Config()):  # noqa: B008
        self.spark, self.folder, self.conf = spark, folder, conf

    def table(self, name: str) -> DataFrame:
        return read_parquet(self.spark, self.folder, name)

    @cached_property
    def tele(self) -> DataFrame:
        return telemetry(self.table("events"))

    @cached_property
    def hot(self) -> DataFrame | None:
        """Players of too many events for one task, and where their events are cut. Counts the events when first asked for."""
        return hot_keys(self.table("events").select(F.col("user_id").cast("string").alias("pid"), F.col("ts").cast("timestamp").alias("event_time")), "pid", "event_time")

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.pair_sessions(self.tele, hot=self.hot)

    @cached_property
    def assigned(self) -> DataFrame:
        return sessions.assign_events(self.tele, self.sessions, self.hot)

    @cached_property
    def features(self) -> DataFrame:
        return features.session_features(self.tele, self.hot)

    @cached_property
    def discovery(self) -> DataFrame:
        return features.discovery_input(self.features)

    @cached_property
    def assignments(self) -> DataFrame:
        return sequences.state_assignments(sequences.with_rule_states(self.features), None, self.conf, hot=self.hot)

    @cached_property
    def edges(self) -> DataFrame:
        return transitions.edges(self.assignments, self.hot)

    @cached_property
    def edges_without_window(self) -> DataFrame:
        """The window's sessions go first, so edges bridge over them."""
        return transitions.edges(self.assignments.filter(~F.col("is_window")), self.hot)

    @cached_property
    def labels(self) -> DataFrame:
        return censoring.disengagement_labels(self.assignments, self.conf, self.hot)

    @cached_property
    def origins(self) -> DataFrame:
        return recovery.focal_origins(self.labels, self.conf, self.hot)

    @cached_property
    def focal(self) -> DataFrame:
        return recovery.focal_frame(self.labels, self.conf, self.hot)

    @cached_property
    def rolling(self) -> DataFrame:
        return sequences.rolling_metrics(self.assignments, self.conf, self.hot)

    @cached_property
    def anchors(self) -> DataFrame:
        return rigidity.terminal_anchors(self.labels, self.conf)

    @cached_property
    def before(self) -> DataFrame:
        return rigidity.before_anchors(self.rolling, self.anchors)

    @cached_property
    def anchor_frame(self) -> DataFrame:
        return rigidity.anchor_frame(self.labels, self.conf, hot=self.hot)

    @cached_property
    def clustered(self) -> DataFrame:
        """Features with the rule's state as a cluster, neighbours and places."""
        from sessionlake.operators.clusters import with_neighbours

        return with_neighbours(sequences.with_rule_states(self.features).withColumn("cluster", F.col("state_id")), hot=self.hot)

    @cached_property
    def embedding_points(self) -> DataFrame:
        from sessionlake.operators.clusters import vector_points

        return vector_points(self.table("embeddings"), "vec_id", "embedding")

    @cached_property
    def order_edges(self) -> DataFrame:
        """A second domain of sequences: a customer's orders with the price third as state; days tie, keys decide."""
        o = self.table("orders").select(F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("login_time"), F.col("o_totalprice").alias("price"), "o_orderkey")
        from pyspark.sql import Window

        w = Window.partitionBy("pid").orderBy("login_time", "o_orderkey")
        state = F.when(F.col("price") < 100_000, 0).when(F.col("price") < 200_000, 1).when(F.col("price") < 300_000, 2).when(F.col("price") < 400_000, 3).otherwise(4)
        rows = o.select("pid", "session_id", "login_time", F.col("login_time").alias("exit_time"), state.alias("state_id"), F.row_number().over(w).alias("session_index"), F.lit(False).alias("is_window"), F.lit(False).alias("is_purchase_anomaly"))
        return transitions.edges(rows)
