"""Spans kept in a stream's state while they may still grow: one state for each thread, event-time timers, late events that join two open spans.

A span is final once the watermark has passed its end by more than the idle time: whatever comes later begins another one. Final spans go out once, in
order, and leave the state, so a thread's state is the spans that the watermark has not passed. A thread of one event has no span; its event waits, without
a timer, for a second one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.scalars import make_id
from tidemark.operators.spans import IDLE_MS, attended
from tidemark.schema import SIGNIFICANT
from tidemark.streaming.reader import STORE

_OUT = "thread_id string, session_id string, is_subagent boolean, span_no long, started_at long, ended_at long, event_count long, first_kind string"


def new() -> dict:
    """open: spans by start, as [start, end, events, first significant event (ts, event_id, kind) or null]; events and closed: of the thread so far."""
    return {"open": [], "events": 0, "closed": 0}


def add(state: dict, events: list[tuple], idle_ms: int) -> None:
    """Put events (ts, event_id, kind), in any order, into the open spans; spans no further apart than idle_ms become one."""
    state["events"] += len(events)
    parts = [*state["open"], *([ts, ts, 1, [ts, i, kind] if kind in SIGNIFICANT else None] for ts, i, kind in events)]
    joined: list[list] = []
    for start, end, n, first in sorted(parts, key=lambda p: p[:2]):
        if joined and start - joined[-1][1] <= idle_ms:
            last = joined[-1]
            last[1], last[2] = max(last[1], end), last[2] + n
            last[3] = min((f for f in (last[3], first) if f), key=lambda f: f[:2], default=None)
        else:
            joined.append([start, end, n, first])
    state["open"] = joined


def close(state: dict, watermark: int, idle_ms: int) -> list[tuple]:
    """Take the final spans out: (span_no, start, end, events, kind of the first significant event)."""
    if state["events"] < 2:
        return []
    out = []
    while state["open"] and state["open"][0][1] + idle_ms < watermark:
        start, end, n, first = state["open"].pop(0)
        out.append((state["closed"], start, end, n, first and first[2]))
        state["closed"] += 1
    return out


class _Spans(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("spans", "json string")

    def _done(self, key, state: dict, watermark: int) -> Iterator[pd.DataFrame]:
        rows = close(state, watermark, self.idle_ms)
        self.state.update((json.dumps(state),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state["open"] and state["events"] > 1:
            self.handle.registerTimer(state["open"][0][1] + self.idle_ms + 1)
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in _OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else new()
        add(state, [(int(ts), str(i), kind) for df in rows for ts, i, kind in df[["ts", "event_id", "kind"]].itertuples(index=False, name=None)], self.idle_ms)
        yield from self._done(key, state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._done(key, json.loads(self.state.get()[0]), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_spans(events: DataFrame, late: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """The final spans of a stream of events (event_id, each once, session_id, thread_id, is_subagent, ts, kind) that come at most `late` (an interval) after newer ones; later ones are dropped."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ids = [F.col(c).cast("string").alias(c) for c in ("thread_id", "session_id")]
    rows = events.select(*ids, "is_subagent", "ts", F.col("event_id").cast("string").alias("event_id"), "kind", F.timestamp_millis("ts").alias("at")).withWatermark("at", late)
    out = rows.groupBy("thread_id", "session_id", "is_subagent").transformWithStateInPandas(_Spans(idle_ms), _OUT, "Append", "EventTime")
    return out.withColumn("attended", attended(F.col("first_kind"))).withColumn("span_id", make_id(F.col("thread_id"), F.col("started_at"))).withColumn("ms", F.col("ended_at") - F.col("started_at")).drop("first_kind")
