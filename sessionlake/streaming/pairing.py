"""Sessions from a stream of logins and exits.

A player's state is the last login, if no exit followed, and the marks that the watermark hasn't passed yet; a player with
neither has no state. Once the watermark has passed them, marks are taken in the order of the batch operator: a login replaces an open one, an exit closes it. Marks behind the watermark
when they come are dropped, by Spark for a player without state. The result is append-only and, but for dropped marks, the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionlake.session import ship
from sessionlake.sources.telemetry import EXIT, LOGIN

SESSIONS = "pid string, login_time timestamp, exit_time timestamp"
STATE = "open_us long, seen_us long, times array<long>, kinds array<int>, ids array<long>"


def step(open_us: int | None, marks: list[tuple[int, int, int]]) -> tuple[int | None, list[tuple[int, int]]]:
    """The open login after the marks (time, kind, id), and the sessions that they close."""
    out = []
    for t, kind, _ in sorted(marks):
        if kind == 0:
            open_us = t
        elif open_us is not None:
            out.append((open_us, t))
            open_us = None
    return open_us, out


def advance(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_us, seen, times, kinds, ids = state.get if state.exists else (None, -(2**62), [], [], [])
    held = list(zip(times, kinds, ids, strict=True))
    for p in parts:
        new = zip(p["t"].tolist(), p["kind"].tolist(), p["event_id"].tolist(), strict=True)
        held += [m for m in new if m[0] >= seen]
    mark = state.getCurrentWatermarkMs() * 1000
    open_us, closed = step(open_us, [m for m in held if m[0] < mark])
    held = [m for m in held if m[0] >= mark]
    if open_us is not None or held:
        state.update((open_us, max(seen, mark), *map(list, zip(*held, strict=True))) if held else (open_us, max(seen, mark), [], [], []))
    elif state.exists:
        state.remove()
    if held:
        state.setTimeoutTimestamp(max(min(m[0] for m in held), mark) // 1000 + 1)
    if closed:
        to = lambda us: pd.to_datetime(us, unit="us")
        yield pd.DataFrame({"pid": [key[0]] * len(closed), "login_time": [to(a) for a, _ in closed], "exit_time": [to(b) for _, b in closed]})


def stream_sessions(tele: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """pid, login_time, exit_time from a streaming telemetry table; marks may come late by `delay`."""
    ship(tele.sparkSession)
    marks = tele.filter(F.col("event_table").isin(LOGIN, EXIT)).withWatermark("event_time", delay)
    marks = marks.select("pid", "event_time", "event_id", F.unix_micros("event_time").alias("t"), (F.col("event_table") == EXIT).cast("int").alias("kind"))
    return marks.groupBy("pid").applyInPandasWithState(advance, SESSIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
