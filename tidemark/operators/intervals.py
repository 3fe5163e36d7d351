"""Interval algebra over (started_at, ended_at) in epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def levels(spans: DataFrame, *keys: str, bucket_ms: int = 86_400_000) -> DataFrame:
    """Sweep line: (keys, t, level, ms) for each instant at which the number of open spans may change.

    Points are summed to one row per instant first. The running sum is taken inside time buckets, and a bucket starts from the
    sum of those before it, so the order of all instants is never needed in one task.
    """
    points = spans.select(*keys, F.explode(F.array(F.struct(F.col("started_at").alias("t"), F.lit(1).alias("d")), F.struct(F.col("ended_at").alias("t"), F.lit(-1).alias("d")))).alias("p")).select(*keys, "p.t", "p.d")
    instants = points.groupBy(*keys, "t").agg(F.sum("d").alias("d")).withColumn("_b", F.floor(F.col("t") / bucket_ms))
    per = instants.groupBy(*keys, "_b").agg(F.sum("d").alias("_d"), F.min("t").alias("_first"))
    over = W.partitionBy(*keys).orderBy("_b") if keys else W.orderBy("_b")
    starts = per.select(*keys, "_b", F.coalesce(F.sum("_d").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("_first").over(over).alias("_next"))
    joined = instants.join(starts, [*keys, "_b"])
    order = W.partitionBy(*keys, "_b").orderBy("t")
    level = F.col("_base") + F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0))
    until = F.coalesce(F.lead("t").over(order), F.col("_next"))
    return joined.select(*keys, "t", level.alias("level"), F.coalesce(until - F.col("t"), F.lit(0)).alias("ms"))


def time_at_level(spans: DataFrame, *keys: str) -> DataFrame:
    return levels(spans, *keys).where("level > 0 AND ms > 0").groupBy(*keys, "level").agg(F.sum("ms").alias("ms"))


def _covered() -> Column:
    return F.coalesce(F.sum(F.when(F.col("level") > 0, F.col("ms"))), F.lit(0))


def _area() -> Column:
    """The sum of all spans' lengths is the area under the sweep."""
    return F.coalesce(F.sum(F.col("level") * F.col("ms")), F.lit(0))


def concurrency(spans: DataFrame, *keys: str) -> DataFrame:
    """Peak, first time of the peak (null if 0), wall clock, active time and their ratio (4 digits), all from one sweep."""
    swept = levels(spans, *keys).groupBy(*keys).agg(F.max("level").alias("peak"), F.min_by("t", F.struct(-F.col("level"), "t")).alias("at"), _covered().alias("wall_ms"), _area().alias("active_ms"))
    ratio = F.when(F.col("wall_ms") > 0, F.round(F.col("active_ms") / F.col("wall_ms"), 4)).otherwise(F.lit(0.0))
    return swept.select(*keys, "peak", F.when(F.col("peak") > 0, F.col("at")).alias("peak_at"), "wall_ms", "active_ms", ratio.alias("multiplier"))


def union_length(spans: DataFrame, *keys: str) -> DataFrame:
    """Milliseconds covered by at least one span."""
    return levels(spans, *keys).groupBy(*keys).agg(_covered().alias("wall_ms"))


def split(spans: DataFrame, unit: str) -> DataFrame:
    """spans cut at the session zone's DAY or HOUR boundaries: bucket (timestamp), piece_start, piece_end (ms). A span without duration keeps one piece."""
    a, b = F.timestamp_millis("started_at"), F.timestamp_millis("ended_at")
    step = F.expr(f"INTERVAL 1 {unit}")
    buckets = spans.select("*", F.explode(F.sequence(F.date_trunc(unit, a), b, step)).alias("bucket"))
    start = F.unix_millis("bucket")
    end = F.unix_millis(F.col("bucket") + step)
    cut = buckets.withColumn("piece_start", F.greatest("started_at", start)).withColumn("piece_end", F.least("ended_at", end))
    return cut.where((F.col("piece_start") < F.col("piece_end")) | (F.col("started_at") == F.col("ended_at")))


def daily(spans: DataFrame, *keys: str) -> DataFrame:
    """Active time and wall clock of each local day that has a span."""
    pieces = split(spans, "DAY").select(*keys, F.to_date("bucket").alias("day"), F.col("piece_start").alias("started_at"), F.col("piece_end").alias("ended_at"))
    return levels(pieces, *keys, "day").groupBy(*keys, "day").agg(_area().alias("active_ms"), _covered().alias("wall_ms"))


def fill_days(days: DataFrame, **zero: Column) -> DataFrame:
    """Every day from the first to the last one in days; missing ones get the given values."""
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo IS NOT NULL")
    calendar = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(days, "day", "left").select("day", *(F.coalesce(c, v).alias(c) for c, v in zero.items()))


def heatmap(spans: DataFrame) -> DataFrame:
    """Milliseconds by weekday (Monday 0) and hour, touched cells only."""
    pieces = split(spans, "HOUR")
    return pieces.groupBy(F.weekday("bucket").alias("weekday"), F.hour("bucket").alias("hour")).agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("ms"))


def weekly(days: DataFrame) -> DataFrame:
    """From daily(): Monday weeks with the surplus of active time over wall clock."""
    week = F.to_date(F.date_trunc("WEEK", "day")).alias("week")
    out = days.groupBy(week).agg(F.sum("active_ms").alias("active_ms"), F.sum("wall_ms").alias("wall_ms"))
    return out.withColumn("surplus_ms", F.greatest(F.lit(0), F.col("active_ms") - F.col("wall_ms")))


def clip(spans: DataFrame, start: int, end: int) -> DataFrame:
    """Spans that overlap the window, cut to it."""
    inside = spans.where((F.col("ended_at") > start) & (F.col("started_at") < end))
    return inside.withColumn("started_at", F.greatest("started_at", F.lit(start))).withColumn("ended_at", F.least("ended_at", F.lit(end)))
