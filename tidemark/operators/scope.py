"""What an account may read of what a team published, and the reads inside that scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.redact import visible


@dataclass(frozen=True)
class Scope:
    """full (repo_id): repositories with all their rows; own (repo_id, account_id): rows of these accounts alone; via (repo_id, reasons)."""

    full: DataFrame
    own: DataFrame
    via: DataFrame

    def repos(self) -> DataFrame:
        return self.full.union(self.own.select("repo_id")).distinct()

    def narrowed(self, requested: list[str] | None) -> Scope:
        """The part of the scope that was asked for. What lies outside is dropped, not refused: an error would tell that it exists."""
        if not requested:
            return self
        asked = lambda df: df.where(F.col("repo_id").isin(*requested))
        return Scope(asked(self.full), asked(self.own), asked(self.via))

    def rows(self, published: DataFrame) -> DataFrame:
        return visible(published, self.full, self.own)


def resolve(account: str, access: DataFrame, members: DataFrame, roster: DataFrame, sessions: DataFrame, repos: DataFrame) -> Scope:
    """access (account_id, repo_id), members (team_id, account_id), roster (team_id, repo_id, added_by), sessions (account_id, repo_id), repos (repo_id).

    Forge access opens a repository. A team's roster opens what its adder had: all of it with access, else the adder's own rows. What an account
    published itself it may read back. Repositories that nobody published to are left out.
    """
    forge = access.where(F.col("account_id") == account).select("repo_id").distinct()
    teams = members.where(F.col("account_id") == account).select("team_id").distinct()
    verified = access.select(F.col("account_id").alias("added_by"), "repo_id").distinct().withColumn("verified", F.lit(True))
    listed = roster.join(teams, "team_id", "left_semi").join(verified, ["added_by", "repo_id"], "left")
    mine = sessions.where(F.col("account_id") == account).select("repo_id").distinct()
    via = forge.select("repo_id", F.lit("forge").alias("reason"))
    via = via.union(listed.select("repo_id", F.concat(F.lit("team:"), F.col("team_id").cast("string")))).union(mine.select("repo_id", F.lit("published")))
    known = repos.select("repo_id").distinct()
    full = forge.union(listed.where("verified").select("repo_id")).distinct().join(known, "repo_id", "left_semi")
    own = listed.where("verified IS NULL AND added_by IS NOT NULL").select("repo_id", F.col("added_by").alias("account_id")).union(mine.select("repo_id", F.lit(account).alias("account_id")))
    return Scope(full, own.distinct().join(known, "repo_id", "left_semi"), via.groupBy("repo_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).join(known, "repo_id", "left_semi"))


def team_filter(spans: DataFrame, actors: list | None = None, sources: list | None = None, role: str | None = None, ts_from: int | None = None, ts_to: int | None = None) -> DataFrame:
    """Published spans (account_id, source, role, started_at) by actor, source, role and a half-open range on the start."""
    for column, values in (("account_id", actors), ("source", sources), ("role", [role] if role else None)):
        if values:
            spans = spans.where(F.col(column).isin(*values))
    if ts_from is not None:
        spans = spans.where(F.col("started_at") >= ts_from)
    return spans if ts_to is None else spans.where(F.col("started_at") < ts_to)


def team_summary(spans: DataFrame) -> DataFrame:
    part = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("ms"))), F.lit(0)).alias(f"{r}_ms")
    return spans.agg(F.countDistinct("repo_id").alias("repos"), F.countDistinct("account_id").alias("actors"), F.count("*").alias("spans"), F.coalesce(F.sum("ms"), F.lit(0)).alias("active_ms"), *map(part, ("human", "autonomous", "unattended_root")))


def team_actors(spans: DataFrame) -> DataFrame:
    return spans.groupBy("account_id").agg(F.sum("ms").alias("active_ms"), F.countDistinct("repo_id").alias("repos"), F.max("ended_at").alias("last_at"))


def team_repos(scope: Scope, spans: DataFrame) -> DataFrame:
    """Every repository of the scope with its time, zeros kept."""
    sums = spans.groupBy("repo_id").agg(F.sum("ms").alias("ms"), F.countDistinct("account_id").alias("actors"))
    return scope.repos().join(sums, "repo_id", "left").select("repo_id", F.coalesce("ms", F.lit(0)).alias("active_ms"), F.coalesce("actors", F.lit(0)).alias("actors"))


def team_daily(spans: DataFrame, day_ms: int = 86_400_000) -> DataFrame:
    """By the UTC day of the start and repository."""
    return spans.groupBy(F.floor(F.col("started_at") / day_ms).alias("day_no"), "repo_id").agg(F.sum("ms").alias("active_ms"))
