"""Applying a new grouping: one table of actions on groups, made by one full join, and what it leaves.

A planned group is created or refreshed: what is known of its repository follows the plan, its name stays as it is, as a person may have given it. Projects go
where the plan has them, or out of every group; a pinned project never moves, and a plan that would move one is refused before anything is written. Automatic groups
that nobody is in any more are swept; groups made by hand stay, also when empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import make_id

MANUAL = "manual"
#: What a plan knows of a group's repository.
META = ("remote_url", "forge", "owner", "repo", "web_url")


class Refused(RuntimeError):
    """Nothing was changed."""


def placed(projects: DataFrame, assignments: DataFrame) -> DataFrame:
    """projects (project_id, group_id, group_pinned, ...) with the group_id that assignments (project_id, group_id) give them; pinned ones keep theirs."""
    to = assignments.select(F.col("project_id").alias("_p"), F.col("group_id").alias("_to"), F.lit(True).alias("_told"))
    both = projects.join(to, F.col("project_id") == F.col("_p"), "left")
    moves = both.where("group_pinned AND _told AND NOT group_id <=> _to").select("project_id").limit(20).collect()
    if moves:
        raise Refused(f"pinned projects would move: {', '.join(str(r.project_id) for r in moves)}")
    return both.select(*(F.when(F.col("group_pinned"), F.col("group_id")).otherwise(F.col("_to")).alias(c) if c == "group_id" else F.col(c) for c in projects.columns))


def actions(groups: DataFrame, plans: DataFrame, after: DataFrame) -> DataFrame:
    """(group_id, action) of every group there is or is planned: create, refresh (the repository's data differ), sweep (automatic and empty after the move), or keep."""
    held = after.select(F.col("group_id").alias("_held")).where("_held IS NOT NULL").distinct()
    old = groups.select(F.col("group_id").alias("_old"), F.col("origin").alias("_was"), F.struct(*META).alias("_has"))
    new = plans.select(F.col("group_id").alias("_new"), F.struct(*META).alias("_gets"))
    both = old.join(new, F.col("_old") == F.col("_new"), "full").withColumn("group_id", F.coalesce("_old", "_new")).join(held, F.col("group_id") == F.col("_held"), "left")
    origin = F.coalesce("_was", F.lit(""))
    action = (
        F.when(F.col("_held").isNull() & F.col("_old").isNotNull() & (origin != MANUAL), "sweep")
        .when(F.col("_held").isNull() & F.col("_old").isNull(), "skip")  # planned, but nobody would be in it: never made
        .when(F.col("_old").isNull(), "create")
        .when(F.col("_new").isNotNull() & ~F.col("_has").eqNullSafe(F.col("_gets")), "refresh")
        .otherwise("keep")
    )
    return both.select("group_id", action.alias("action"))


def applied(groups: DataFrame, projects: DataFrame, plans: DataFrame, assignments: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(groups, projects) after the plan. The same plan again changes nothing."""
    after = placed(projects, assignments)
    done = actions(groups, plans, after)
    stamp = F.lit(now).cast("long")
    made = plans.join(done.where("action = 'create'"), "group_id").withColumns({"created_at": stamp, "updated_at": stamp}).select(groups.columns)
    fresh = plans.select("group_id", F.struct(*META).alias("_gets"))
    kept = groups.join(done.where("action IN ('refresh', 'keep')"), "group_id").join(fresh, "group_id", "left")
    moved = F.col("action") == "refresh"
    kept = kept.select(*(F.when(moved, F.col(f"_gets.{c}")).otherwise(F.col(c)).alias(c) if c in META else F.when(moved, stamp).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in groups.columns))
    return kept.unionByName(made), after


def renamed(groups: DataFrame, group_id: str, name: str, now: int) -> DataFrame:
    own = F.col("group_id") == group_id
    return groups.withColumns({"name": F.when(own, F.lit(name)).otherwise(F.col("name")), "updated_at": F.when(own, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})


def by_hand(groups: DataFrame, projects: DataFrame, project_ids: list[str], name: str, now: int) -> tuple[DataFrame, DataFrame]:
    """(groups, projects) with the projects pinned to a group of that name made by hand, which is made if there is none."""
    spark = groups.sparkSession
    made = spark.range(1).select(make_id(F.lit(MANUAL), F.lower(F.lit(name))).alias("group_id"), F.lit(name).alias("name"), F.lit(MANUAL).alias("origin"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    fresh = made.join(groups.select("group_id"), "group_id", "left_anti")
    own = F.col("project_id").isin(*project_ids)
    to = made.first().group_id
    return groups.unionByName(fresh, allowMissingColumns=True), projects.withColumns({"group_id": F.when(own, F.lit(to)).otherwise(F.col("group_id")), "group_pinned": own | F.col("group_pinned")})


def released(projects: DataFrame, project_ids: list[str]) -> DataFrame:
    """projects whose pin is taken off: the next plan places them."""
    return projects.withColumn("group_pinned", F.col("group_pinned") & ~F.col("project_id").isin(*project_ids))
