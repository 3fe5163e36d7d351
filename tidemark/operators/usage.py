"""Token usage as the logs repeat it: responses billed once, cumulative totals turned to increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bill_once(lines: DataFrame, file: str, order: str, key: list[str], output: str) -> DataFrame:
    """lines plus first (the line that keeps the usage) and billed_output: later lines of a run of the same key
    count only what they add to the highest output so far."""
    w = W.partitionBy(file).orderBy(order)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    change = F.when(F.lag(order).over(w).isNull() | ~same, 1).otherwise(0)
    numbered = lines.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    r = W.partitionBy(file, "run").orderBy(order)
    before = F.max(output).over(r.rowsBetween(W.unboundedPreceding, -1))
    return numbered.withColumn("first", F.row_number().over(r) == 1).withColumn("billed_output", F.greatest(F.col(output) - F.coalesce(before, F.lit(0)), F.lit(0))).drop("_c")


def increments(rows: DataFrame, key: str, order: list[str], total: str) -> DataFrame:
    """rows plus delta: what a cumulative total added, never negative."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("delta", F.greatest(F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0)), F.lit(0)))


def advanced_only(rows: DataFrame, key: str, order: list[str], total: str, last: str) -> DataFrame:
    """rows plus counted: the event's own usage where the total advanced; a repeated total counts nothing."""
    w = W.partitionBy(key).orderBy(*order)
    top = F.max(total).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("counted", F.when(top.isNull() | (F.col(total) > top), F.col(last)).otherwise(F.lit(0)))


def fork_replay(child: DataFrame, parent: DataFrame) -> DataFrame:
    """child (thread_id, parent_id, at, usage) without the leading rows that repeat the parent's (thread_id, at, usage) in order.

    The match is a join on the position; only an unbroken run from the start is a replay.
    """
    p = parent.select(F.col("thread_id").alias("_t"), F.col("at").alias("_at"), F.col("usage").alias("_u"))
    joined = child.join(p, (child["parent_id"] == p["_t"]) & (child["at"] == p["_at"]), "left")
    match = F.coalesce(F.col("usage") == F.col("_u"), F.lit(False)).cast("int")
    w = W.partitionBy("thread_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn("_m", F.min(match).over(w)).where("_m = 0").select(*child.columns)
