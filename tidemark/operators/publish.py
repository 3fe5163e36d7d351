"""Publication: what of the store may leave a machine, where each published column comes from, and an audit of the published text.

Nothing is sent that was not looked at three times. Every column of every table has a verdict, and one without stops publication. The
published columns' origins are read off their plans: a copy must be of a public column, a computed column may also read derived ones, none may touch
a private one. And all published text is searched for what this machine knows about itself: local paths and path-derived ids anywhere in it,
names of people and machines as whole words, and names of withheld projects, which are only a warning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import basename, forge, normalize_remote, role, tokens_of
from tidemark.operators.lineage import UNKNOWN, origins
from tidemark.operators.needles import found

#: The verdict on every column. Public ones may be copied, derived ones only be computed from, private ones stay.
PUBLIC = {
    "host": "os",
    "project_group": "name origin remote_url forge owner repo web_url",
    "session": "id source git_branch started_at ended_at event_count active_ms",
    "thread": "id session_id parent_thread_id started_at ended_at event_count active_ms",
    "span": "id session_id thread_id started_at ended_at event_count",
    "model_price": "model input_mtok output_mtok cache_read_mtok cache_write_1h_mtok cache_write_mtok currency effective_from",
}
DERIVED = {
    "host": "host_id account_id",
    "project": "group_id",
    "project_group": "group_id",
    "session": "host_id project_id",
    "thread": "is_subagent",
    "span": "attended",
}
PRIVATE = {
    "host": "hostname first_seen last_seen",
    "project": "project_id root_path name group_pinned",
    "project_group": "match_key created_at updated_at",
    "project_probe": "project_id host_id git_remote git_common_dir path_exists detected_at",
    "session": "native_id cwd cli_version",
    "thread": "native_id agent_name",
    "event": "id session_id thread_id native_event_id ts ordinal kind model tool_name tool_use_id input_tokens output_tokens cache_read_tokens cache_write_tokens cache_write_1h_tokens",
    "model_price": "origin matched_id note updated_at",
}
#: Words of which every path and address is made, which name nobody.
STRUCTURAL = frozenset(
    "http https www com org net io dev git github gitlab src lib app main master users home root var tmp opt usr etc bin new old test tests doc docs local localhost".split()
)
#: Shortest text that is looked for; most bytes of the bitmap of what is looked for.
LEAST, FILTER_BYTES = 3, 32 << 20


class Unsafe(RuntimeError):
    """Nothing was sent."""


def verdict(table: str, column: str) -> str | None:
    return next((v for v, by in (("public", PUBLIC), ("derived", DERIVED), ("private", PRIVATE)) if column in by.get(table, "").split()), None)


def unruled(tables: dict[str, DataFrame]) -> list[str]:
    """Columns that nobody has ruled on."""
    return sorted(f"{t}.{c}" for t, df in tables.items() for c in df.columns if verdict(t, c) is None)


def faults(published: dict[str, DataFrame], tables: dict[str, DataFrame], given: frozenset[str] = frozenset({"actor"})) -> list[str]:
    """What each published column must not be made of; given: columns that come from elsewhere (the actor from the account)."""
    out = []
    for name, df in published.items():
        for column, origin in origins(df, tables).items():
            for table, source in sorted(origin.sources):
                v = None if table == UNKNOWN else verdict(table, source)
                if column in given and table == UNKNOWN:
                    continue
                if v is None:
                    out.append(f"{name}.{column} comes from {table}.{source}, which has no verdict")
                elif v == "private" or v == "derived" and not origin.computed:
                    out.append(f"{name}.{column} {'is computed from' if origin.computed else 'copies'} {table}.{source}, which is {v}")
    return out


def repositories(groups: DataFrame) -> DataFrame:
    """project_group rows whose remote can say who may see them, with everything parsed anew from the remote, and repo_id, its hash."""
    r = groups.select("group_id", "name", normalize_remote(F.col("remote_url")).alias("remote_url")).where("remote_url <> ''")
    parts = forge(F.col("remote_url"))
    web = F.when(F.startswith("remote_url", F.lit("https://")), F.col("remote_url"))
    return r.select("group_id", F.sha2("remote_url", 256).alias("repo_id"), "remote_url", parts["host"].alias("forge"), parts["owner"].alias("owner"), parts["repo"].alias("repo"), web.alias("web_url"), "name")


def publication(tables: dict[str, DataFrame], actor: str, host_id: str | None = None) -> dict[str, DataFrame]:
    """repo, session and span as they may leave, of one machine's sessions or of all."""
    repos = repositories(tables["project_group"])
    sessions = tables["session"] if host_id is None else tables["session"].where(F.col("host_id") == host_id)
    s, p = sessions.alias("s"), tables["project"].alias("p")
    placed = s.join(p, F.col("s.project_id") == F.col("p.project_id")).join(repos.alias("r"), F.col("p.group_id") == F.col("r.group_id"))
    keep = [F.col(f"s.{c}") for c in ("source", "git_branch", "started_at", "ended_at", "active_ms", "event_count")]
    # the repository is found by way of the project, and is computed from the remote alone
    session = placed.select(F.col("s.id").alias("session_id"), F.col("r.repo_id").alias("repo_id"), F.lit(actor).alias("actor"), *keep)
    x, t = tables["span"].alias("x"), tables["thread"].alias("t")
    told = x.join(t, F.col("t.id") == F.col("x.thread_id")).join(session.select("session_id").alias("k"), F.col("k.session_id") == F.col("x.session_id"), "left_semi")
    span = told.select(F.col("x.id").alias("span_id"), F.col("x.session_id").alias("session_id"), role(F.col("t.is_subagent"), F.col("x.attended")).alias("thread_role"), *(F.col(f"x.{c}") for c in ("started_at", "ended_at", "event_count")))
    return {"repo": repos.drop("group_id"), "session": session, "span": span}


def withheld(tables: dict[str, DataFrame], published: dict[str, DataFrame], host_id: str | None = None) -> DataFrame:
    """One row: published_ms, withheld_ms (all time but the published, so that the two are the whole) and withheld_projects."""
    own = tables["session"] if host_id is None else tables["session"].where(F.col("host_id") == host_id)
    spent = lambda df, name: df.agg(F.coalesce(F.sum(F.col("ended_at") - F.col("started_at")), F.lit(0)).alias(name))
    every = spent(tables["span"].join(own.select(F.col("id").alias("session_id")), "session_id", "left_semi"), "all_ms")
    groups = repositories(tables["project_group"]).select("group_id")
    loose = tables["project"].join(groups, "group_id", "left_anti").agg(F.count("*").alias("withheld_projects"))
    both = spent(published["span"], "published_ms").crossJoin(every).crossJoin(loose)  # a row each
    return both.select("published_ms", (F.col("all_ms") - F.col("published_ms")).alias("withheld_ms"), "withheld_projects")


def secrets(tables: dict[str, DataFrame], home: str, user: str) -> DataFrame:
    """(kind, secret): paths and path-derived ids, people and machines, and the folders' names of withheld projects."""
    p, groups = tables["project"], repositories(tables["project_group"]).select("group_id")
    spark = p.sparkSession
    paths = p.select(F.col("root_path").alias("secret")).union(p.select("project_id")).union(tables["session"].select("cwd")).union(spark.createDataFrame([(home,)], "secret string"))
    people = tables["host"].select(F.col("hostname").alias("secret")).union(spark.createDataFrame([(user,), (home.rstrip("/").rsplit("/", 1)[-1],)], "secret string"))
    people = people.select(F.explode(F.array_append(tokens_of(F.col("secret")), F.lower("secret"))).alias("secret"))
    names = p.join(groups, "group_id", "left_anti").select(basename(F.regexp_replace("root_path", r"[/\\]+$", "")).alias("secret"))
    told = [df.select(F.lit(kind).alias("kind"), "secret") for kind, df in (("path", paths), ("identity", people), ("name", names))]
    return reduce(DataFrame.union, told).where(F.length("secret") >= LEAST).distinct()


def _texts(published: dict[str, DataFrame]) -> DataFrame:
    """(field, value) of all published text."""
    out = []
    for name, df in published.items():
        columns = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        fields = F.explode(F.array(*(F.struct(F.lit(f"{name}.{c}").alias("field"), F.col(c).alias("value")) for c in columns)))
        out.append(df.select(fields.alias("f")).select("f.field", "f.value"))
    return reduce(DataFrame.union, out).where("value IS NOT NULL")


def audit(published: dict[str, DataFrame], known: DataFrame, actor: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(severity, kind, field, value, secret): leaks, and warnings for names of withheld projects.

    Whole words that the viewer has anyway are exempt: the actor, and what a repository's own address and name say.
    """
    texts, spark = _texts(published), known.sparkSession
    paths = known.where("kind = 'path'").where(F.length("secret") >= LEAST).groupBy(F.lower("secret").alias("low")).agg(F.min("secret").alias("secret"), F.lit("path").alias("kind"), F.lit(False).alias("word"))
    own = published["repo"].select(F.explode(F.array(*(c for c in ("owner", "repo", "name", "remote_url", "web_url")))).alias("x")).where("x IS NOT NULL")
    exempt = own.union(spark.createDataFrame([(actor,), *((w,) for w in sorted(STRUCTURAL))], "x string")).select(F.explode(tokens_of(F.col("x"))).alias("low")).distinct()
    words = known.where("kind <> 'path'").groupBy(F.lower("secret").alias("low")).agg(F.min("kind").alias("kind"))  # who is a person is not a project
    words = words.where("low <> ''").join(exempt, "low", "left_anti").select("low", F.col("low").alias("secret"), "kind", F.lit(True).alias("word"))
    severity = F.when(F.col("kind") == "name", "warning").otherwise("leak")
    return found(texts, paths.unionByName(words), filter_bytes).select(severity.alias("severity"), "kind", "field", "value", "secret")


def publish(tables: dict[str, DataFrame], published: dict[str, DataFrame], known: DataFrame, actor: str, send: Callable[[str, DataFrame], None]) -> None:
    """send(name, rows) for each published table, after nothing was found against it; raises Unsafe before the first one otherwise."""
    against = [f"{c} has no verdict" for c in unruled(tables)] or faults(published, tables)
    if not against:
        against = [f"{r.field} holds {r.secret!r}: {r.value!r}" for r in audit(published, known, actor).where("severity = 'leak'").limit(20).collect()]
    if against:
        raise Unsafe("; ".join(against))
    for name, df in published.items():
        send(name, df)
