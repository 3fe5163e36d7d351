"""Aggregates and rankings over the span star."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import role


def bounds(events: DataFrame, *keys: str) -> DataFrame:
    """First and last event and their number, rebuilt from the events."""
    return events.groupBy(*keys).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("event_count"))


def rollup(events: DataFrame, key: str, idle_ms: int) -> DataFrame:
    """bounds() plus active_ms: a span is as long as its gaps, so the gaps of at most idle_ms inside threads sum to the active time."""
    gap = F.col("ts") - F.lag("ts").over(W.partitionBy("thread_id").orderBy("ts"))
    timed = events.select("thread_id", "ts", key).withColumn("gap", gap)
    return timed.groupBy(key).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("event_count"), F.coalesce(F.sum(F.when(F.col("gap") <= idle_ms, F.col("gap"))), F.lit(0)).alias("active_ms"))


def active_ms(entities: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """entities plus active_ms, 0 for those without spans."""
    sums = spans.groupBy(key).agg(F.sum("ms").alias("_ms"))
    return entities.join(sums, key, "left").withColumn("active_ms", F.coalesce("_ms", F.lit(0))).drop("_ms")


def latest_non_null(events: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Per key, each column's value in the last row that has one."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first one offered."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def totals(spans: DataFrame, *keys: str) -> DataFrame:
    return spans.groupBy(*keys).agg(F.count("*").alias("spans"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("thread_id").alias("threads"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), F.coalesce(F.sum("ms"), F.lit(0)).alias("active_ms"))


def by_role(spans: DataFrame) -> DataFrame:
    """Active time in the three buckets that make up the whole."""
    return spans.groupBy(role(F.col("is_subagent"), F.col("attended")).alias("role")).agg(F.count("*").alias("spans"), F.sum("ms").alias("active_ms"))


def ranking(spans: DataFrame, key: str, costs: DataFrame | None = None) -> DataFrame:
    """Per key: time, sessions, threads, first and last; costs are summed apart and joined, so neither multiplies the other."""
    out = spans.groupBy(key).agg(F.sum("ms").alias("active_ms"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("thread_id").alias("threads"), F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"))
    if costs is None:
        return out
    money = costs.groupBy(F.col(key).alias("_k")).agg(F.sum("total_nano").alias("cost_nano"))
    return out.join(money, out[key].eqNullSafe(money["_k"]), "left").withColumn("cost_nano", F.coalesce("cost_nano", F.lit(0))).drop("_k")


def roster(dimension: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Every key of the dimension with its active time, zeros kept."""
    return active_ms(dimension, spans, key)


def top_with_rest(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n largest keys and one row `other` for all others. The ranking picks n rows by a bounded sort; the rest is summed where it lies."""
    top = rows.orderBy(F.desc(value), key).limit(n).select(F.col(key).alias("_top"))
    name = F.when(F.col("_top").isNotNull(), F.col(key).cast("string")).otherwise("other")
    return rows.join(F.broadcast(top), F.col(key) == F.col("_top"), "left").groupBy(name.alias("key")).agg(F.sum(value).alias(value), F.count("*").alias("members"))  # n rows


def share(rows: DataFrame, value: str) -> DataFrame:
    """rows plus their share of the whole (4 digits; 0 if the whole is 0)."""
    whole = rows.agg(F.coalesce(F.sum(value), F.lit(0)).alias("_whole"))
    return rows.crossJoin(F.broadcast(whole)).withColumn("share", F.when(F.col("_whole") > 0, F.round(F.col(value) / F.col("_whole"), 4)).otherwise(F.lit(0.0))).drop("_whole")  # one row


def widest(spans: DataFrame, n: int = 4000) -> DataFrame:
    """At most n spans: the widest, ties by start and id; rows plus truncated."""
    total = spans.agg((F.count("*") > n).alias("truncated"))
    return spans.orderBy(F.desc("ms"), "started_at", "span_id").limit(n).crossJoin(F.broadcast(total))  # one row


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, n: int) -> DataFrame:
    """The n rows that follow a composite key."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, after))))
    return rows.orderBy(*keys).limit(n)


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows and an order-insensitive digest, computed without a sort or a gather: the sum of the rows' hashes modulo 2^64, as a signed number, so that no table is too large."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    part = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    turn = F.lit(Decimal(2**64))
    whole = F.pmod(F.coalesce(F.sum(part.cast("decimal(20,0)")), F.lit(0)), turn)
    return rows.agg(F.count("*").alias("n"), F.when(whole < turn / 2, whole).otherwise(whole - turn).cast("long").alias("digest"))


def covered(known: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(known / total, 4)).otherwise(F.lit(0.0))
