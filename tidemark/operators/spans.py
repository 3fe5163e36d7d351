"""Active spans by gap sessionization, one thread at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import make_id
from tidemark.schema import SIGNIFICANT

IDLE_MS = 300_000


def with_span(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """events (thread_id, ts, event_id, ...) plus span_no: a gap over idle_ms starts a new span; threads of one event have none.

    One shuffle on thread_id serves the gaps, the running number and the count.
    """
    order = W.partitionBy("thread_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") - F.lag("ts").over(order) > idle_ms, 1).otherwise(0)
    return (
        events.withColumn("_gap", gap)
        .withColumn("span_no", F.sum("_gap").over(order))
        .withColumn("_n", F.count("*").over(W.partitionBy("thread_id")))
        .where("_n >= 2")
        .drop("_gap", "_n")
    )


def attended(first_kind: Column) -> Column:
    """A subagent's span is never attended; a root's is if a prompt comes first, and unknowable in the thread's first span."""
    return F.when(F.col("is_subagent"), False).when(first_kind == "user_prompt", True).when(F.col("span_no") == 0, F.lit(None).cast("boolean")).otherwise(False)


def spans(events: DataFrame, idle_ms: int = IDLE_MS, keep: tuple[str, ...] = ("session_id", "source", "project_id", "group_id", "is_subagent")) -> DataFrame:
    """One row per span: its bounds, events, attendance and the columns of `keep`, which are the same in a whole thread."""
    at = F.struct("ts", "event_id")
    first = F.min_by(F.when(F.col("kind").isin(*SIGNIFICANT), F.col("kind")), F.when(F.col("kind").isin(*SIGNIFICANT), at))
    grouped = with_span(events, idle_ms).groupBy("thread_id", "span_no").agg(
        *(F.first(c).alias(c) for c in keep), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("event_count"), first.alias("_first")
    )
    return grouped.withColumn("attended", attended(F.col("_first"))).withColumn("span_id", make_id(F.col("thread_id"), F.col("started_at"))).withColumn("ms", F.col("ended_at") - F.col("started_at")).drop("_first")


def spans_by_session_window(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same spans by the built-in session window, which also works on a stream with a watermark."""
    w = F.session_window(F.timestamp_millis("ts"), F.lit(f"{idle_ms} milliseconds"))
    out = events.groupBy("thread_id", w).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("event_count"))
    many = events.groupBy("thread_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("thread_id")
    return out.join(many, "thread_id", "left_semi").drop("session_window")
