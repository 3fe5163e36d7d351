"""Merge rules of the sinks, as joins of the stored rows with the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new that are really new."""
    return new.join(stored, keys, "left_anti").dropDuplicates(keys)


def coalesce_upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored updated by new: a null in new keeps the old value."""
    values = [c for c in stored.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in values))
    return stored.join(n, keys, "full_outer").select(*keys, *(F.coalesce(f"_n_{c}", c).alias(c) for c in values))


def merge_hosts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Earliest first_seen, latest last_seen, other values from the later row unless null."""
    both = stored.unionByName(new)
    rest = [c for c in stored.columns if c not in ("host_id", "first_seen", "last_seen")]
    later = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("last_seen"))).alias(c) for c in rest]
    return both.groupBy("host_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *later)


def merge_projects(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A pinned group survives; otherwise the new row wins."""
    n = new.select("project_id", F.col("group_id").alias("_g"), F.col("group_pinned").alias("_p"), F.lit(True).alias("_new"))
    pinned = F.coalesce(F.col("group_pinned"), F.lit(False))
    group = F.when(pinned | F.col("_new").isNull(), F.col("group_id")).otherwise(F.col("_g"))
    return stored.join(n, "project_id", "full_outer").select("project_id", group.alias("group_id"), (pinned | F.coalesce(F.col("_p"), F.lit(False))).alias("group_pinned"))


def guarded_parents(threads: DataFrame, links: DataFrame) -> DataFrame:
    """threads (id) with parent_thread_id from links, only where the parent exists and is not the thread itself."""
    known = threads.select(F.col("id").alias("_p")).distinct()
    wanted = links.select(F.col("id").alias("_c"), F.col("parent_thread_id").alias("_want"))
    out = threads.join(wanted, threads["id"] == wanted["_c"], "left").join(known, (F.col("_want") == F.col("_p")) & (F.col("_p") != F.col("id")), "left")
    return out.withColumn("parent_thread_id", F.col("_p")).drop("_c", "_want", "_p")


def backfill(stored: DataFrame, reparsed: DataFrame, key: str, column: str) -> DataFrame:
    """Fill nulls of one column; never insert, never overwrite."""
    n = reparsed.groupBy(F.col(key).alias("_k")).agg(F.max(column).alias("_v"))
    return stored.join(n, stored[key] == n["_k"], "left").withColumn(column, F.coalesce(column, "_v")).drop("_k", "_v")
