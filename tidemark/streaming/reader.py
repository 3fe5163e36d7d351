"""Growing logs as a stream of events: one state for each file holds what later lines need of the earlier ones.

`tail` gives the new lines of all files; Spark parses them; a state machine keyed by file bills their usage; the rest of an event is
built by the same expressions as in a batch, so the stream's events are those of one pass over the whole files, wherever they are cut.

A file's state is small: the response that is open and its highest output, the agent's name, or the first session_meta line, the last total, and the
requests of compactions. What cannot be decided yet is held back: lines of an agent before its file's head has named it, and lines of a thread before
its session_meta. They go out when the head is decided, or HOLD_MS after the last line came, as they are. A file that starts again from 0 starts with a new
state. The machines see typed columns, no JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.sources import message_log, thread_log
from tidemark.sources.tail import Tail

#: How long undecided lines are held back after a file's last line.
HOLD_MS = 60_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a usage, in the order of the thread log's structs.
_PARTS = tuple(thread_log.COUNTS)


class MessageMachine:
    """Bills a message log's lines in order. A line is a dict of `columns`; step() returns those decided, with `answers` filled."""

    columns = "at long, value string, whole boolean, ts long, response_id string, request_id string, output_tokens long, usage_line boolean, name string, in_agent boolean"
    answers = "line long, first boolean, billed_output long, agent_name string"

    @staticmethod
    def new() -> dict:
        return {"n": 0, "name": None, "agent": False, "head": None, "key": None, "top": None, "held": []}

    @staticmethod
    def step(state: dict, lines: list[dict], settled: bool = False) -> list[dict]:
        held = state["held"]
        for line in lines:
            line["line"], state["n"] = state["n"], state["n"] + 1
            if not line["whole"]:
                continue
            if state["head"] is None:
                state["head"] = line["line"]
            state["agent"] |= line["in_agent"]
            if state["name"] is None and line["name"] is not None and line["line"] - state["head"] < message_log.HEAD_LINES:
                state["name"] = line["name"]
            line["first"], line["billed_output"] = None, None
            if line["usage_line"]:
                key, output = [line["response_id"], line["request_id"]], line["output_tokens"] if line["ts"] is not None else None
                line["first"] = key != state["key"]
                if line["first"]:
                    state["key"], state["top"] = key, None
                line["billed_output"] = None if output is None else max(output - (state["top"] or 0), 0)
                state["top"] = output if state["top"] is None else state["top"] if output is None else max(output, state["top"])
            held.append(line)
        decided = state["name"] is not None or state["head"] is not None and state["n"] - state["head"] >= message_log.HEAD_LINES
        if state["agent"] and not decided and not settled:
            return []
        state["held"] = []
        return [{**line, "agent_name": state["name"]} for line in held]


def _clamped(u: list[int]) -> list[int]:
    of = dict(zip(_PARTS, u))
    of["cached"] = min(of["cached"], of["input"])
    of["write"] = min(of["write"], max(of["input"] - of["cached"], 0))
    return [of[k] for k in _PARTS]


def _any(u: list[int] | None) -> bool:
    return u is not None and any(x > 0 for k, x in zip(_PARTS, u) if k != "total")


class ThreadMachine:
    """Bills a thread log's lines in order, as thread_log.ledger does over whole files. Usages are lists in the order of _PARTS."""

    columns = "at long, value string, whole boolean, ts long, type string, rid string, is_report boolean, total array<long>, last array<long>, own array<long>, thread array<long>"
    answers = "line long, counted array<long>, meta string"

    @staticmethod
    def new() -> dict:
        return {"n": 0, "meta": None, "prior": None, "requests": {}, "latest": None, "reported": None, "billed": None, "held": []}

    @staticmethod
    def step(state: dict, lines: list[dict], settled: bool = False) -> list[dict]:
        held = state["held"]
        for line in lines:
            if line["whole"]:
                state["n"] += 1
                if state["meta"] is None and line["type"] == "session_meta":
                    state["meta"] = line["value"]
                line["line"], line["counted"] = state["n"], _billed(state, line, state["n"])
                held.append(line)
        if state["meta"] is None and not settled:
            return []
        state["held"] = []
        return [{**line, "meta": state["meta"]} for line in held]


def _billed(state: dict, line: dict, n: int) -> list[int] | None:
    """The usage that a line bills; state moves on. A request: its first record (own, thread), that record's line, its compacted line, the line that bills it, whether a report covers it."""
    if line["is_report"]:
        return _report(state, line, n)
    if line["rid"] is None:
        return None
    request = state["requests"].setdefault(line["rid"], {"own": None, "thread": None, "recorded": None, "compacted": None, "billed": None, "covered": False})
    record = line["type"] == "token_usage_record" and line["ts"] is not None and _any(line["own"])
    if record and request["recorded"] is None:
        request |= {"own": line["own"], "thread": line["thread"], "recorded": n}
    if line["type"] == "compacted" and request["compacted"] is None:
        request["compacted"] = n
    if record and request["billed"] is None:
        state["latest"] = line["rid"]
    if request["billed"] is None and request["recorded"] is not None and request["compacted"] is not None:
        request["billed"] = state["billed"] = n
        return None if request["covered"] else request["own"]
    return None


def _report(state: dict, line: dict, n: int) -> list[int] | None:
    total, last, prior = line["total"], line["last"], state["prior"]
    moved = total is None or total != prior
    used = last if last is not None and moved else None if total is None else _clamped([max(a - b, 0) for a, b in zip(total, prior or [0] * len(total))])
    used = used if _any(used) else None
    counts, again = used is not None and moved, False
    latest = state["requests"].get(state["latest"])
    if counts and latest and (latest["own"] == used or latest["thread"] is not None and latest["thread"] == total):
        if latest["billed"] is None:
            latest["covered"] = True
        else:
            again = state["billed"] == latest["billed"] and (state["reported"] is None or state["reported"] < state["billed"])
    if total is not None:
        state["prior"] = total
    if counts:
        state["reported"] = n
    return None if again else used


class _Reader(StatefulProcessor):
    """A machine for each file; its state is one JSON text."""

    def __init__(self, machine: type, timers: bool):
        self.machine, self.timers = machine, timers
        self.fields = [c.split()[0] for c in f"{machine.columns}, {machine.answers}".split(", ")]

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "json string")

    def _out(self, key, state: dict, rows: list[dict]) -> Iterator[pd.DataFrame]:
        self.state.update((json.dumps(state),))
        if rows:
            frame = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in self.fields})
            frame.insert(0, "file_path", key[0])
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.new()
        columns = [c.split()[0] for c in self.machine.columns.split(", ")]
        lines = sorted((dict(zip(columns, map(_plain, r))) for df in rows for r in df[columns].itertuples(index=False, name=None)), key=lambda r: r["at"])
        if lines and lines[0]["at"] == 0 and state["n"]:  # the file starts again
            state = self.machine.new()
        out = self.machine.step(state, lines)
        for t in list(self.handle.listTimers()) if self.timers else ():
            self.handle.deleteTimer(t)
        if self.timers and state["held"]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + HOLD_MS)
        yield from self._out(key, state, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0])
        yield from self._out(key, state, self.machine.step(state, [], settled=True))

    def close(self) -> None:
        pass


def _plain(x):
    """A value of a pandas frame as JSON knows it."""
    if x is None or isinstance(x, (str, bool)):
        return x
    if hasattr(x, "tolist"):
        return x.tolist()
    if isinstance(x, (list, tuple)):
        return [int(v) for v in x]
    return None if x != x else int(x) if isinstance(x, float) else x


def _stated(rows: DataFrame, machine: type, timers: bool) -> DataFrame:
    """rows (file_path and the machine's columns) through the machine, each file in one state. Without timers nothing that is held back goes out by time; a query
    that is to end with its input (availableNow over files) needs that, as one with timers goes on for them."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the one that keeps such states
    types = f"file_path string, {machine.columns}, {machine.answers}"
    return rows.groupBy("file_path").transformWithStateInPandas(_Reader(machine, timers), types, "Append", "ProcessingTime" if timers else "None")


def message_lines(lines: DataFrame, timers: bool = True) -> DataFrame:
    """Lines (file_path, at, value) of a stream as billed lines, to be made events by message_events() batch by batch."""
    read = message_log.prepared(lines)
    return _stated(read.select("file_path", *(c.split()[0] for c in MessageMachine.columns.split(", "))), MessageMachine, timers)


def message_events(billed: DataFrame) -> DataFrame:
    """message_lines() as events."""
    rows = message_log.prepared(billed.select("file_path", "line", "value", "first", "billed_output", "agent_name"))
    return message_log.shaped(message_log.once(rows))


def _list(usage: str):
    return F.when(F.col(usage).isNotNull(), F.array(*(F.col(f"{usage}.{k}") for k in _PARTS)))


def thread_lines(lines: DataFrame, timers: bool = True) -> DataFrame:
    """Lines (file_path, at, value) of a stream as billed lines, to be made events by thread_events() batch by batch."""
    read = thread_log.prepared(lines.withColumn("place", F.col("at"))).withColumn("at", F.col("place"))
    read = read.withColumn("is_report", F.col("p.type").eqNullSafe("token_count") & F.col("ts").isNotNull()).select("file_path", "at", "value", "whole", "ts", "type", "rid", "is_report", *(_list(c).alias(c) for c in ("total", "last", "own", "thread")))
    return _stated(read, ThreadMachine, timers)


def thread_events(billed: DataFrame) -> DataFrame:
    """thread_lines() as events."""
    rows = thread_log.prepared(billed.select("file_path", F.col("line").alias("place"), "value", "counted", "meta"), "counted", "meta")
    counted = F.when(F.col("counted").isNotNull(), F.struct(*(F.col("counted")[i].alias(k) for i, k in enumerate(_PARTS))))
    return thread_log.shaped(rows.withColumn("line", F.col("place")).withColumn("counted", counted).withColumn("m", thread_log.meta_of(F.col("meta"))))


#: By kind of log: the stream of billed lines, and their events.
READERS = {"messages": (message_lines, message_events), "threads": (thread_lines, thread_events)}


def tailed(spark: SparkSession, pattern: str) -> DataFrame:
    """The stream of new lines of the files that match, and of the errors of those that cannot be read (value null)."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", pattern).load()


def watch(spark: SparkSession, kind: str, pattern: str, then, checkpoint: str, **trigger):
    """Follow the logs of a kind ("messages", "threads"): then(events, batch number) for each micro-batch; returns the running query."""
    lines_of, events_of = READERS[kind]
    billed = lines_of(tailed(spark, pattern).where("error IS NULL").select("file_path", "at", "value"))
    return billed.writeStream.foreachBatch(lambda df, n: then(events_of(df), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()
