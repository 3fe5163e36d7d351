"""Threads and the threads that started them: depth, cycles, and an order in which children follow their parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import work_dir


def _kept(df: DataFrame) -> DataFrame:
    """df written and read back, so that a loop's plan does not grow."""
    path = work_dir(df.sparkSession, "parents")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _doubled(up: DataFrame, by: list[str], joined: dict[str, Column]) -> DataFrame:
    """up (by, id, up, ...) with pointers doubled until none that ends still moves: up is null but on and below cycles.

    joined: how a column grows by the same one of the row pointed to, which is there as far_<column>. After k rounds every chain of 2^k threads
    is resolved; a round that resolves none has met cycles alone, as threads deeper than 2^k stand below others of every smaller depth.
    """
    moving, ended, left = _kept(up), [], None
    while (now := moving.where("up IS NOT NULL").count()) and now != left:
        left = now
        # rows that have ended are joined to, but join nothing: their null pointers would all meet in one task
        ended.append(moving.where("up IS NULL"))
        moving = moving.where("up IS NOT NULL")
        far = reduce(DataFrame.union, ended, moving).select(*by, F.col("id").alias("up"), F.col("up").alias("far_up"), *(F.col(c).alias(f"far_{c}") for c in joined))
        moving = _kept(moving.join(far, [*by, "up"]).select(*by, "id", F.col("far_up").alias("up"), *(how.alias(c) for c, how in joined.items())))
    return reduce(DataFrame.union, ended, moving)


def _pointed(threads: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """threads plus up: the parent, if ids (by, parent_id, distinct) has it. Threads without a parent are not joined: their nulls would all meet in one task."""
    joined = threads.where("parent_id IS NOT NULL").join(ids.withColumn("known", F.lit(True)), [*by, "parent_id"], "left")
    found = joined.select(*threads.columns, F.when(F.col("known"), F.col("parent_id")).alias("up"))
    return found.union(threads.where("parent_id IS NULL").withColumn("up", F.col("parent_id")))


def depths(threads: DataFrame) -> DataFrame:
    """threads (id, parent_id) plus depth: parents above it among the threads, 0 for a root or an unknown parent, null on or below a cycle. Chains may have any length."""
    own = threads.select("id", "parent_id")
    up = _pointed(own, own.select(F.col("id").alias("parent_id")).distinct(), []).select("id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"))
    up = _doubled(up, [], {"depth": F.col("depth") + F.col("far_depth")})
    return threads.join(up.select("id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth")), "id")


def cycles(threads: DataFrame) -> DataFrame:
    """(id, cycle) of the threads on a cycle of parents; cycle: the smallest id on it. Threads below a cycle are not on it."""
    stuck = depths(threads).where("depth IS NULL").select("id", F.col("parent_id").alias("up"))
    # as often as pointers must be doubled to pass every thread: then they all lie on cycles, and every thread of a cycle is pointed to
    rounds = max(1, stuck.count().bit_length())
    far = _kept(stuck)
    for _ in range(rounds):
        far = _kept(far.join(far.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")))
    on = stuck.join(far.select(F.col("up").alias("id")).distinct(), "id")
    low = _kept(on.withColumn("cycle", F.least("id", "up")))
    for _ in range(rounds):
        far = low.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("cycle").alias("more"))
        low = _kept(low.join(far, "up").select("id", F.col("far").alias("up"), F.least("cycle", "more").alias("cycle")))
    return low.select("id", "cycle")


def lanes(threads: DataFrame, spans: DataFrame, per: str = "session_id") -> DataFrame:
    """Threads (id, parent_id, is_subagent, session) with a span, numbered in each session: every thread before its children, these by their first start.

    A parent counts only if it has a span in the same session. Threads without one: roots first (depth 0), then subagents whose parent is not there
    (depth 1), each by first start, then id. Threads on or below a cycle come last, without depth.
    """
    first = spans.groupBy("thread_id").agg(F.min("started_at").alias("first_at"))
    own = _kept(threads.join(first, threads["id"] == first["thread_id"]).select("id", per, "parent_id", "is_subagent", "first_at"))
    placed = _pointed(own, own.select(per, F.col("id").alias("parent_id")).distinct(), [per])
    root, sub = F.col("up").isNull(), F.col("is_subagent")
    key = F.struct((root & sub).alias("orphan"), "first_at", "id")
    up = placed.select(per, "id", "up", F.when(root & ~sub, 0).otherwise(1).alias("depth"), F.array(key).alias("path"))
    done = _doubled(up, [per], {"depth": F.col("depth") + F.col("far_depth"), "path": F.concat("far_path", "path")})
    done = done.select(per, "id", F.col("up").isNotNull().alias("stuck"), "depth", "path")
    order = W.partitionBy(per).orderBy("stuck", F.when(~F.col("stuck"), F.col("path")), "first_at", "id")
    out = own.join(done, [per, "id"])
    return out.select("id", per, "parent_id", F.when(~F.col("stuck"), F.col("depth")).alias("depth"), "first_at", F.row_number().over(order).alias("lane"))


def existence(projects: DataFrame, by: str) -> DataFrame:
    """Live, gone and unknown projects (path_exists true, false, null) and the time of those gone; the three are never merged."""
    return projects.groupBy(by).agg(F.count_if("path_exists").alias("live"), F.count_if(~F.col("path_exists")).alias("gone"), F.count_if(F.col("path_exists").isNull()).alias("unknown"), F.coalesce(F.sum(F.when(~F.col("path_exists"), F.col("active_ms"))), F.lit(0)).alias("gone_ms"))
