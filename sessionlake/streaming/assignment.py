"""Events of a stream assigned to the sessions they lie in, as `operators.sessions.assign_events` does for tables.

A player's state is the open login, the events since it, and the rows that the watermark hasn't passed yet. Once the watermark has passed
a time, its rows are taken together: logins, then exits, then events. An exit closes the open session and gives out its events with it; a login
that replaces an open one gives out the events since that without a session; an event of no open session is given out without one. State ends
when no session is open and nothing waits. What an open session holds grows until the player exits or logs in again; rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionlake.session import ship
from sessionlake.sources.telemetry import EVENT_TABLES, EXIT, LOGIN

ASSIGNED = "event_id long, pid string, event_table string, event_time timestamp, login_time timestamp, exit_time timestamp"
_ROWS = ("times", "kinds", "ids", "tables")
STATE = "open_us long, seen_us long, since long, times array<long>, kinds array<int>, ids array<long>, tables array<string>"

#: time, kind (0 login, 1 exit, 2 other), id, event table
Mark = tuple[int, int, int, str]


def assign(open_us: int | None, since: list[Mark], rows: list[Mark]) -> tuple[int | None, list[Mark], list[tuple[Mark, int | None, int | None]]]:
    """The open login and the events since it after more rows, whole times in order; and the events given out, each with its session's login and exit."""
    out: list[tuple[Mark, int | None, int | None]] = []
    for t, here in groupby(sorted(rows), lambda m: m[0]):
        same = list(here)
        events = [m for m in same if m[1] > 0]
        if same[0][1] == 0:  # a login: what came since an open one lies in no session
            out += [(m, None, None) for m in since]
            open_us, since = t, []
        if open_us is None:
            out += [(m, None, None) for m in events]
        elif any(m[1] == 1 for m in events):
            out += [(m, open_us, t) for m in since + events]
            open_us, since = None, []
        else:
            since = since + events
    return open_us, since, out


def advance(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One step of a player's state. `since` counts how many of the state's rows are events of the open session; the rest wait for the watermark."""
    open_us, seen, n, *held = state.get if state.exists else (None, -(2**62), 0, [], [], [], [])
    rows: list[Mark] = list(zip(*held, strict=True))
    since, waiting = rows[:n], rows[n:]
    for p in parts:
        new = zip(p["t"].tolist(), p["kind"].tolist(), p["event_id"].tolist(), p["event_table"].tolist(), strict=True)
        waiting += [m for m in new if m[0] >= seen]
    mark = state.getCurrentWatermarkMs() * 1000
    open_us, since, out = assign(open_us, since, [m for m in waiting if m[0] < mark])
    waiting = [m for m in waiting if m[0] >= mark]
    if open_us is not None or waiting:
        columns = zip(*since, *waiting, strict=True) if since or waiting else [[]] * len(_ROWS)
        state.update((open_us, max(seen, mark), len(since), *map(list, columns)))
        if waiting:
            state.setTimeoutTimestamp(max(min(m[0] for m in waiting), mark) // 1000 + 1)
    elif state.exists:
        state.remove()
    if out:
        at = lambda us: pd.to_datetime(pd.Series(us, dtype="Int64"), unit="us")
        marks, logins, exits = zip(*out, strict=True)
        times, _, ids, tables = zip(*marks, strict=True)
        yield pd.DataFrame({"event_id": ids, "pid": key[0], "event_table": tables, "event_time": at(times), "login_time": at(logins), "exit_time": at(exits)})


def stream_assignments(tele: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """event_id, pid, event_table, event_time and the session's login_time and exit_time (null outside) from a streaming telemetry table, append-only.

    Rows may come late by `delay`. An event is given out once the watermark has passed it and what decides about it: the exit or login after it.
    The result is the batch operator's, but for dropped late rows and the events of sessions still open.
    """
    ship(tele.sparkSession)
    rows = tele.filter(F.col("event_table").isin(LOGIN, *EVENT_TABLES)).withWatermark("event_time", delay)
    kind = F.when(F.col("event_table") == LOGIN, 0).when(F.col("event_table") == EXIT, 1).otherwise(2)
    rows = rows.select("pid", "event_time", "event_id", "event_table", F.unix_micros("event_time").alias("t"), kind.alias("kind"))
    return rows.groupBy("pid").applyInPandasWithState(advance, ASSIGNED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
