"""Streaming twins of the telemetry operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timeout(expire: bool) -> str:
    """State that expires needs a query that runs on; a replay of what there is ends only without."""
    return GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout


def throttled(events: DataFrame, seconds: int = 300, hint: int = 2, reduce: int = 4, block: int = 6, group: int = 10, expire: bool = True) -> DataFrame:
    """event_id, session, calls, searches and level of a stream of events (session, tool, path, us, event_id, search), as
    telemetry.throttle() has them. State holds a session's calls within the window only, and ends when they have passed."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        rows = []
        for r in pd.concat(list(parts)).sort_values(["us", "event_id"]).itertuples(index=False):
            call = f"{r.tool}\0{r.path}"
            held = [h for h in held if h[1] > r.us - seconds * 1_000_000] + [(call, r.us, bool(r.search))]
            n, searches = sum(h[0] == call for h in held), sum(h[2] for h in held)
            level = "block" if r.search and searches >= group or n >= block else "reduce" if n >= reduce else "hint" if n >= hint else "normal"
            rows.append((r.event_id, key[0], n, searches, level))
        state.update(tuple(map(list, zip(*held, strict=True))))
        if expire:
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame(rows, columns=["event_id", "session", "calls", "searches", "level"])

    return events.groupBy("session").applyInPandasWithState(step, "event_id long, session long, calls long, searches long, level string", "calls array<string>, times array<long>, search array<boolean>", "append", _timeout(expire))


def counted(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and value for each tool and time window (ts, tool, value); rows later than the watermark are left out."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "tool").agg(F.count("*").alias("calls"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "tool", "calls", "value")


def session_gaps(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of events (ts, session) that end after a gap."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def debounced(changes: DataFrame, quiet_ms: int = 500, most_ms: int = 5000, expire: bool = True) -> DataFrame:
    """key, first and last change and number of changes (key, us) of each burst: a burst ends after a quiet time, or at the
    greatest delay from its start."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        rows = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], first, last, n)], columns=["key", "first", "last", "n"])
            return
        for us in sorted(int(x) for d in parts for x in d.us):
            if n and (us - last > quiet_ms * 1000 or us - first > most_ms * 1000):
                rows.append((key[0], first, last, n))
                first, n = None, 0
            first, last, n = us if not n else first, us, n + 1
        state.update((first, last, n))
        if expire:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(rows, columns=["key", "first", "last", "n"])

    return changes.groupBy("key").applyInPandasWithState(step, "key string, first long, last long, n long", "first long, last long, n long", "append", _timeout(expire))


def upsert_each(stream: DataFrame, apply, checkpoint: str):
    """Starts a sink that applies each micro-batch to a table by a function of (DataFrame, batch id)."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
