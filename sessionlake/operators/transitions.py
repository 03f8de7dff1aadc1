"""Transitions between successive states: edges, matrices and their comparison, in long form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import Config
from sessionlake.functions.columns import days_between, ratio
from sessionlake.functions.quantiles import with_quantiles
from sessionlake.functions.segments import lead, scan, without_ranges


def edges(assignments: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """A row for each session that has a next one. Rows that were filtered out before are bridged: filter first, or not, with care."""
    ahead = {c: lead(F.col(s)) for c, s in (("to_session_id", "session_id"), ("to_state", "state_id"), ("to_login", "login_time"))}
    return (
        without_ranges(scan(assignments, "pid", "login_time", ["session_index"], ahead, hot))
        .filter("to_session_id is not null")
        .select("pid", "session_index", F.col("session_id").alias("from_session_id"), "to_session_id", F.col("state_id").alias("from_state"), "to_state", days_between("to_login", "exit_time").alias("gap_days"), "is_window", "is_purchase_anomaly")
    )


def grid(df: DataFrame, n: int) -> DataFrame:
    """All n * n state pairs: a fixed, small table."""
    states = lambda name: df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))
    return states("from_state").crossJoin(states("to_state"))  # n * n rows


def transition_matrix(e: DataFrame, n: int) -> DataFrame:
    """Count and row-wise share of each state pair; shares are null in rows without transitions."""
    counts = e.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    full = grid(e, n).join(F.broadcast(counts), ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # at most n * n rows
    return full.withColumn("probability", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("from_state"))))


def balanced_matrix(e: DataFrame, n: int) -> DataFrame:
    """Each player's row-wise shares, averaged over the players who leave the state at all: active players don't dominate.

    A player's zero cells count, so the mean is the sum of shares over the number of such players.
    """
    each = e.groupBy("pid", "from_state", "to_state").agg(F.count("*").alias("n"))
    shares = each.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("pid", "from_state")))
    players = shares.groupBy("from_state").agg(F.count_distinct("pid").alias("players"))
    sums = shares.groupBy("from_state", "to_state").agg(F.sum("p").alias("p"))
    full = grid(e, n).join(F.broadcast(sums), ["from_state", "to_state"], "left").join(F.broadcast(players), "from_state", "left")
    return full.select("from_state", "to_state", F.coalesce("players", F.lit(0)).alias("players"), F.when(F.col("players") > 0, F.coalesce("p", F.lit(0.0)) / F.col("players")).alias("probability"))


def players_with_outgoing(e: DataFrame) -> DataFrame:
    return e.groupBy("pid").agg(F.count("*").alias("transitions"), F.count_distinct("from_state").alias("states_with_outgoing"))


def wide_matrix(matrix: DataFrame, n: int) -> DataFrame:
    return matrix.groupBy("from_state").pivot("to_state", list(range(n))).agg(F.first("probability")).select("from_state", *[F.col(str(k)).alias(f"to_{k}") for k in range(n)])


def named(matrices: dict[str, DataFrame]) -> DataFrame:
    parts = [m.select(F.lit(name).alias("matrix"), "from_state", "to_state", "probability") for name, m in matrices.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_matrices(long: DataFrame, names: list[str]) -> DataFrame:
    """Largest and mean absolute difference and Frobenius norm of each pair of matrices, over cells that both have."""
    pairs = F.array(*[F.struct(F.lit(a).alias("matrix_a"), F.lit(b).alias("matrix_b")) for a, b in combinations(names, 2)])
    cells = long.groupBy("from_state", "to_state").agg(F.map_from_entries(F.collect_list(F.struct("matrix", "probability"))).alias("p"))  # as many as there are matrices
    gaps = cells.select("from_state", "to_state", "p", F.inline(pairs)).withColumn("gap", F.col("p")[F.col("matrix_a")] - F.col("p")[F.col("matrix_b")])
    return gaps.groupBy("matrix_a", "matrix_b").agg(F.max(F.abs("gap")).alias("max_abs_diff"), F.avg(F.abs("gap")).alias("mean_abs_diff"), F.sqrt(F.sum(F.col("gap") * F.col("gap"))).alias("frobenius_norm"))


def transition_features(long: DataFrame, conf: Config) -> DataFrame:
    """Of each matrix and state: the share that stays, the likeliest next state (ties to the smaller), and shares to the recovery states."""
    to, p = F.col("to_state"), F.col("probability")
    top = F.max(F.when(p.isNotNull(), F.struct(p, (-to).alias("minus"))))
    a, b = conf.recovery_states
    at = lambda s: F.max(F.when(to == s, p))
    return long.groupBy("matrix", F.col("from_state").alias("state")).agg(
        F.max(F.when(to == F.col("from_state"), p)).alias("self_transition"),
        (-top["minus"]).alias("top_state"),
        top["probability"].alias("top_probability"),
        at(a).alias("to_s1"),
        at(b).alias("to_s2"),
        (at(a) + at(b)).alias("to_recovery"),
    )


def transition_relations(long: DataFrame) -> DataFrame:
    """The relations between states that robustness looks at, a row for each matrix."""
    cell = lambda i, j: F.max(F.when((F.col("from_state") == i) & (F.col("to_state") == j), F.col("probability")))
    top0 = F.max(F.when((F.col("from_state") == 0) & F.col("probability").isNotNull(), F.struct("probability", (-F.col("to_state")).alias("minus"))))
    return long.groupBy("matrix").agg(
        cell(0, 1).alias("s0_to_s1"),
        (top0["minus"] == -1).alias("s0_top_is_s1"),
        cell(1, 2).alias("s1_to_s2"),
        cell(2, 1).alias("s2_to_s1"),
        (cell(1, 2) + cell(2, 1)).alias("s1_s2_sum"),
        (cell(3, 1) + cell(3, 2)).alias("s3_to_s1_or_s2"),
        cell(4, 4).alias("s4_self"),
        (cell(4, 1) + cell(4, 2)).alias("s4_to_s1_or_s2"),
    )


def robustness_gate(relations: DataFrame) -> DataFrame:
    """One row: whether the relations hold in every matrix."""
    return relations.select(
        F.lit(1).alias("one"), "*"
    ).groupBy("one").agg(
        F.bool_and("s0_top_is_s1").alias("s0_top_is_s1"),
        (F.min("s1_s2_sum") > 0.60).alias("s1_s2_exchange"),
        (F.min("s3_to_s1_or_s2") > 0.60).alias("s3_returns"),
        (F.min("s4_to_s1_or_s2") > 0.35).alias("s4_recovers"),
        (F.min("s4_self") > 0.25).alias("s4_persists"),
    ).drop("one").withColumn("robust", F.col("s0_top_is_s1") & F.col("s1_s2_exchange") & F.col("s3_returns") & F.col("s4_recovers") & F.col("s4_persists"))


def state_summary(assignments: DataFrame) -> DataFrame:
    """Sessions, players, starts, ends, and transitions in and out of each state."""
    prev, nxt, s = F.col("prev_state_id"), F.col("next_state_id"), F.col("state_id")
    n_out = F.count(nxt)
    out = assignments.groupBy("state_id").agg(
        F.count("*").alias("sessions"),
        F.count_distinct("pid").alias("players"),
        F.count_if(prev.isNull()).alias("starts"),
        F.count_if(nxt.isNull()).alias("ends"),
        F.count(prev).alias("incoming"),
        n_out.alias("outgoing"),
        F.count_if(nxt == s).alias("self_transitions"),
        F.try_divide(F.count_if(nxt == s).cast("double"), n_out).alias("self_probability"),
    )
    return with_quantiles(out, assignments, ["state_id"], {"median_duration_minutes": ("duration_minutes", 0.5)})
