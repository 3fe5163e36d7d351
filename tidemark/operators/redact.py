"""What a team may see: publication by cleared columns, row scope, and an audit for leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import role, tokens_of

#: What may leave a machine. A column that is not named here does not.
PUBLIC = {
    "session": ("session_id", "source", "started_at", "ended_at", "event_count"),
    "span": ("span_id", "session_id", "thread_id", "started_at", "ended_at", "event_count"),
}


def unclassified(df: DataFrame, public: set[str], private: set[str]) -> tuple[set[str], set[str]]:
    """(columns in neither list, listed columns that are gone); both must be empty before anything is published."""
    return set(df.columns) - public - private, (public | private) - set(df.columns)


def publish_spans(spans: DataFrame, repos: DataFrame) -> DataFrame:
    """Spans of publishable projects, cleared columns only, with the repository and the role."""
    r = repos.select(F.col("project_id").alias("_pid"), "repo_id").distinct()  # a repository listed twice publishes once
    return spans.join(r, F.col("project_id") == F.col("_pid")).select(*PUBLIC["span"], "repo_id", role(F.col("is_subagent"), F.col("attended")).alias("role"))


def withheld(spans: DataFrame, repos: DataFrame) -> DataFrame:
    """Time and projects that are not published: the exact complement."""
    r = repos.select(F.col("project_id").alias("_pid")).distinct()
    rest = spans.join(r, F.col("project_id") == F.col("_pid"), "left_anti")
    return rest.agg(F.coalesce(F.sum("ms"), F.lit(0)).alias("withheld_ms"), F.countDistinct("project_id").alias("withheld_projects"))


def visible(rows: DataFrame, full_repos: DataFrame, own_rows: DataFrame) -> DataFrame:
    """rows (repo_id, account_id, ...) whose repository is fully visible, or whose (repository, account) pair is."""
    full = full_repos.select(F.col("repo_id").alias("_r"), F.lit(True).alias("_full")).distinct()
    own = own_rows.select(F.col("repo_id").alias("_or"), F.col("account_id").alias("_oa"), F.lit(True).alias("_own")).distinct()
    out = rows.join(full, F.col("repo_id") == F.col("_r"), "left").join(own, (F.col("repo_id") == F.col("_or")) & (F.col("account_id") == F.col("_oa")), "left")
    return out.where(F.coalesce("_full", "_own")).drop("_r", "_full", "_or", "_oa", "_own")


def branch_suppressed(flags: DataFrame, teams: DataFrame) -> DataFrame:
    """Per repository: off wins; the caller's own teams decide where there are any, else any team."""
    mine = flags.join(teams.select(F.col("team_id").alias("_t"), F.lit(True).alias("_mine")).distinct(), F.col("team_id") == F.col("_t"), "left")
    per = mine.groupBy("repo_id").agg(F.bool_or(F.when(F.col("_mine"), F.col("suppress"))).alias("_own"), F.bool_or("suppress").alias("_any"))
    return per.select("repo_id", F.coalesce("_own", "_any").alias("suppressed"))


def audit(published: DataFrame, text: str, secrets: DataFrame) -> DataFrame:
    """(secret, n) for each secret word found among the tokens of a published text column; an equality join on tokens, not pairs."""
    words = published.select(F.explode(tokens_of(F.col(text))).alias("word"))
    wanted = secrets.select("secret", F.lower("secret").alias("word"))
    return wanted.join(words.groupBy("word").agg(F.count("*").alias("n")), "word", "left").select("secret", F.coalesce("n", F.lit(0)).alias("n"))
