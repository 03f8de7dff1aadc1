"""Sessions from logins and exits, events within sessions, and what pairing left over.

All of it is ordered work within a player: one exchange by player serves pairing, numbering and gaps. Players of very many events
are scanned in ranges of time (`functions/segments.py`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import days_between, micros, ratio, session_key
from sessionlake.functions.quantiles import with_quantiles
from sessionlake.functions.segments import before, coming, lag, last, lead, least, scan, total, without_ranges
from sessionlake.sources.telemetry import EVENT_TABLES, EXIT, LOGIN


def login_exit_stream(tele: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Logins and exits with the kind and time of the player's next one. At equal times logins come first, then the order of event_id.

    hot, here and below: players of too many events for one task, as `segments.hot_keys` gives them by event_time.
    """
    marks = tele.filter(F.col("event_table").isin(LOGIN, EXIT)).select("event_id", "pid", "event_time", (F.col("event_table") == EXIT).cast("int").alias("kind"))
    return without_ranges(scan(marks, "pid", "event_time", ["event_time", "kind", "event_id"], {"next_kind": lead(F.col("kind")), "next_time": lead(F.col("event_time"))}, hot))


def pair_sessions(tele: DataFrame, long_hours: int = 12, hot: DataFrame | None = None) -> DataFrame:
    """A session is a login whose very next mark is an exit; a later login before the exit replaces it, an exit without a login is left over."""
    paired = login_exit_stream(tele, hot).filter("kind = 0 and next_kind = 1").select("pid", "event_id", F.col("event_time").alias("login_time"), F.col("next_time").alias("exit_time"))
    paired = scan(paired, "pid", "login_time", ["login_time", "event_id"], {"session_index": before(F.lit(1))}, hot)
    return with_session_columns(paired.withColumn("session_index", (F.col("session_index") + 1).cast("int")), long_hours, hot).drop("event_id")


def with_session_columns(sessions: DataFrame, long_hours: int = 12, hot: DataFrame | None = None) -> DataFrame:
    """Adds the key, durations, the gap to the previous session and the time since the first; in a player's order, without another exchange."""
    seconds = (micros("exit_time") - micros("login_time")) / F.lit(1e6)
    around = scan(sessions, "pid", "login_time", ["session_index"], {"previous_exit": lag(F.col("exit_time")), "first_login": least(F.col("login_time"))}, hot)
    return (
        without_ranges(around)
        .withColumns(
            {
                "session_id": session_key(F.col("pid"), F.col("session_index")),
                "duration_seconds": seconds,
                "duration_minutes": seconds / 60.0,
                "days_since_previous_session": days_between("login_time", "previous_exit"),
                "player_lifetime_days": days_between("login_time", "first_login"),
                "is_zero_duration": seconds == 0,
                "is_long": seconds > long_hours * 3600,
            }
        )
        .drop("previous_exit", "first_login")
    )


def assign_events(tele: DataFrame, sessions: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Events with the session they lie in, both ends included; session_id is null outside.

    Sessions of a player don't overlap, so the last login up to an event decides: a running value over the union of both,
    linear in events, where a range join would compare all of a player's events with all of their sessions.
    """
    marks = sessions.select("pid", F.col("login_time").alias("event_time"), F.lit(0).alias("kind"), F.struct("session_id", "session_index", "exit_time").alias("s"))
    events = tele.filter(F.col("event_table").isin(*EVENT_TABLES)).withColumn("kind", F.lit(1))
    both = scan(events.unionByName(marks, allowMissingColumns=True), "pid", "event_time", ["event_time", "kind"], {"s": last(F.col("s"))}, hot)
    inside = F.col("event_time") <= F.col("s.exit_time")
    return both.filter("kind = 1").select(*[c for c in events.columns if c != "kind"], F.when(inside, F.col("s.session_id")).alias("session_id"), F.when(inside, F.col("s.session_index")).alias("session_index"))


def session_stream(tele: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every event that lies in a session, and the login that begins it, with the session's number and exit: pairing and assignment at once.

    One scan, one exchange by player and two sorts. Backwards, each row learns the next mark; forwards, the last login that an exit
    follows decides. `starts` is true for the logins.
    """
    login, exit_ = F.col("event_table") == LOGIN, F.col("event_table") == EXIT
    rows = tele.filter(F.col("event_table").isin(LOGIN, *EVENT_TABLES)).withColumn("kind", F.when(login, 0).otherwise(1))
    order = ["event_time", "kind", "event_id"]
    rows = scan(rows, "pid", "event_time", order, {"next": coming(F.when(login | exit_, F.struct("kind", "event_time")))}, hot)
    rows = rows.withColumn("starts", login & F.coalesce(F.col("next.kind") == 1, F.lit(False)))
    begun = F.col("starts").cast("int")
    rows = scan(rows, "pid", "event_time", order, {"session_index": before(begun), "exit_time": last(F.when(F.col("starts"), F.col("next.event_time")))}, hot)
    rows = rows.withColumn("session_index", (F.col("session_index") + begun).cast("int"))
    return without_ranges(rows).filter((F.col("event_time") <= F.col("exit_time")) & (F.col("starts") | ~login)).drop("kind", "next")


def assignment_summary(assigned: DataFrame) -> DataFrame:
    """Valid, assigned and unassigned events of each table."""
    n, hit = F.count("*"), F.count("session_id")
    return assigned.groupBy("event_table").agg(n.alias("valid_events"), hit.alias("assigned_events"), (n - hit).alias("unassigned_events"), F.try_divide(hit * 100.0, n).alias("assigned_pct"))


def pairing_by_player(tele: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Logins, exits, pairs and what is left over for each player; an overlap is a login that a later one replaced before an exit."""
    # Exits ahead are all but those so far: linear in a player's marks.
    marks = scan(login_exit_stream(tele, hot), "pid", "event_time", ["event_time", "kind", "event_id"], {"exits": total(F.col("kind")), "exits_before": before(F.col("kind"))}, hot)
    marks = without_ranges(marks).withColumn("exits_ahead", F.col("exits") - F.col("exits_before") - F.col("kind"))
    login, exit_ = F.col("kind") == 0, F.col("kind") == 1
    return (
        marks.groupBy("pid")
        .agg(
            F.count_if(login).alias("logins"),
            F.count_if(exit_).alias("exits"),
            F.count_if(login & (F.col("next_kind") == 1)).alias("paired_sessions"),
            F.count_if(login & (F.col("next_kind") == 0) & (F.col("exits_ahead") > 0)).alias("overlapping_logins"),
            F.min(F.when(login, F.col("event_time"))).alias("first_login"),
            F.max(F.when(exit_, F.col("event_time"))).alias("last_exit"),
        )
        .withColumns({"unmatched_logins": F.col("logins") - F.col("paired_sessions"), "unmatched_exits": F.col("exits") - F.col("paired_sessions")})
    )


def pairing_summary(tele: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row: totals, players all of whose marks paired, and quantiles of durations."""
    clean = (F.col("unmatched_logins") == 0) & (F.col("unmatched_exits") == 0) & (F.col("overlapping_logins") == 0)
    players = pairing_by_player(tele, hot).agg(
        F.count("*").alias("players"),
        *[F.sum(c).alias(c) for c in ("logins", "exits", "paired_sessions", "unmatched_logins", "unmatched_exits", "overlapping_logins")],
        F.count_if(clean).alias("clean_players"),
    )
    paired = pair_sessions(tele, hot=hot)
    s = paired.agg(F.count_if("is_long").alias("long_sessions"), F.count_if("is_zero_duration").alias("zero_sessions"))
    s = with_quantiles(s, paired, [], {"duration_minutes_p50": ("duration_minutes", 0.5), "duration_minutes_p95": ("duration_minutes", 0.95)})
    return players.crossJoin(s).withColumn("clean_player_pct", ratio(F.col("clean_players") * 100, F.col("players")))  # one row each


def duration_against_reported(sessions: DataFrame, reported: DataFrame, seconds_col: str = "reported_seconds") -> DataFrame:
    """duration_minus_reported_minutes for sessions whose exit event reports a length. reported: pid, exit_time, seconds_col."""
    return sessions.join(reported, ["pid", "exit_time"], "left").withColumn("duration_minus_reported_minutes", F.col("duration_minutes") - F.col(seconds_col) / 60.0)


def session_events(assigned: DataFrame) -> DataFrame:
    return assigned.filter("session_id is not null")
