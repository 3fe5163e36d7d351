"""Publication and its audit over the driver's tables seen as a store, beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import publish as P
from tidemark.operators import regroup as R
from tidemark.plans.queries import query, w
from tidemark.plans.views import read

ACTOR = "alice"
#: The tables in SQL: nations are groups, customers projects, orders sessions of one thread, line items spans.
STORE = """
grp AS (SELECT CAST(n_nationkey AS VARCHAR) AS group_id, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN concat('https://forge.example/org', n_regionkey, '/', n_name) END AS remote FROM nation),
proj AS (SELECT c_custkey, concat('/home/u', c_custkey % 7, '/', c_name) AS root_path, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS group_id FROM customer),
sess AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderpriority AS source, CASE WHEN o_orderkey % 50 = 0 THEN concat('wip', root_path) WHEN o_orderkey % 50 = 1 THEN concat('fix/box', o_custkey % 3) ELSE concat('feat/', o_orderstatus) END AS git_branch,
  epoch_us(o_orderdate) // 1000 AS started_at, remote, sha256(remote) AS repo_id, c_custkey, root_path, o_orderstatus <> 'O' AS sub FROM orders JOIN proj ON c_custkey = o_custkey LEFT JOIN grp USING (group_id)),
pub AS (SELECT * FROM sess WHERE remote IS NOT NULL)"""


def store(spark, d) -> dict:
    nation, customer, orders, lines = (read(spark, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    remote = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("git@Forge.Example:org"), F.col("n_regionkey"), F.lit("/"), F.col("n_name"), F.lit(".git")))
    root = F.concat(F.lit("/home/u"), F.col("c_custkey") % 7, F.lit("/"), F.col("c_name"))
    project = customer.select(F.sha2(root, 256).alias("project_id"), root.alias("root_path"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("group_id"), F.col("c_custkey").alias("_custkey"))
    branch = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("wip"), "root_path")).when(F.col("o_orderkey") % 50 == 1, F.concat(F.lit("fix/box"), F.col("o_custkey") % 3)).otherwise(F.concat(F.lit("feat/"), "o_orderstatus"))
    at, key = F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey").cast("string")
    session = orders.join(project, F.col("o_custkey") == F.col("_custkey")).select(
        key.alias("id"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("box"), F.col("o_custkey") % 3).alias("host_id"), "project_id", F.col("root_path").alias("cwd"),
        branch.alias("git_branch"), at.alias("started_at"), at.alias("ended_at"), F.lit(2).cast("long").alias("event_count"), F.lit(0).cast("long").alias("active_ms"),
    )
    thread = orders.select(key.alias("id"), key.alias("session_id"), (F.col("o_orderstatus") != "O").alias("is_subagent"))
    start = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    span = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_orderkey").cast("string").alias("thread_id"),
        start.alias("started_at"), (start + F.col("l_linenumber") * 1000).alias("ended_at"), F.lit(2).cast("long").alias("event_count"), (F.col("l_returnflag") == "R").alias("attended"),
    )
    host = orders.select((F.col("o_custkey") % 3).alias("k")).distinct().select(F.concat(F.lit("box"), "k").alias("host_id"), F.concat(F.lit("box"), "k").alias("hostname"))
    # each table is written down as the store would hold it, so that origins end at its columns
    made = {"project_group": nation.select(F.col("n_nationkey").cast("string").alias("group_id"), F.col("n_name").alias("name"), remote.alias("remote_url")), "project": project.drop("_custkey"), "session": session, "thread": thread, "span": span, "host": host}
    return {name: df.sparkSession.createDataFrame([], df.schema).union(df) for name, df in made.items()}


@query(w(STORE, "SELECT sha256(remote) AS repo_id, remote AS remote_url, 'forge.example' AS forge, split_part(remote, '/', 4) AS owner, split_part(remote, '/', 5) AS repo, remote AS web_url, name FROM grp WHERE remote IS NOT NULL"))
def publication_repos(spark, d):
    return P.publication(store(spark, d), ACTOR)["repo"]


@query(w(STORE, f"SELECT session_id, repo_id, '{ACTOR}' AS actor, source, git_branch, started_at FROM pub"))
def publication_session_rows(spark, d):
    return P.publication(store(spark, d), ACTOR)["session"].select("session_id", "repo_id", "actor", "source", "git_branch", "started_at")


@query(w(STORE, "SELECT concat(l_orderkey, '-', l_linenumber) AS span_id, session_id, CASE WHEN sub THEN 'autonomous' WHEN l_returnflag = 'R' THEN 'human' ELSE 'unattended_root' END AS thread_role, epoch_us(l_shipdate) // 1000 AS started_at FROM lineitem JOIN pub ON session_id = CAST(l_orderkey AS VARCHAR)"))
def publication_span_rows(spark, d):
    return P.publication(store(spark, d), ACTOR)["span"].select("span_id", "session_id", "thread_role", "started_at")


@query(w(STORE, "SELECT CAST(sum(l_linenumber * 1000) FILTER (remote IS NOT NULL) AS BIGINT) AS published_ms, CAST(sum(l_linenumber * 1000) FILTER (remote IS NULL) AS BIGINT) AS withheld_ms, (SELECT count(*) FROM proj LEFT JOIN grp USING (group_id) WHERE remote IS NULL) AS withheld_projects FROM lineitem JOIN sess ON session_id = CAST(l_orderkey AS VARCHAR)"))
def publication_withheld(spark, d):
    tables = store(spark, d)
    return P.withheld(tables, P.publication(tables, ACTOR))


@query(w(STORE, ", branch AS (SELECT DISTINCT git_branch, lower(git_branch) AS low FROM pub), hits AS (SELECT 'path' AS kind, root_path AS secret, git_branch FROM branch JOIN proj ON contains(low, lower(root_path)) UNION ALL SELECT 'path', '/home/u1', git_branch FROM branch WHERE contains(low, '/home/u1') UNION ALL SELECT 'identity', 'box' || k, git_branch FROM branch, range(3) r(k) WHERE regexp_matches(low, '(^|[^a-z0-9])box' || k || '([^a-z0-9]|$)')) SELECT 'leak' AS severity, kind, 'session.git_branch' AS field, secret, count(*) AS n FROM hits GROUP BY kind, secret"))
def publication_audit(spark, d):
    """Leaks only: customers' names are in one word with their number, so that no name of a withheld project is a word of its own."""
    tables = store(spark, d)
    known = P.secrets(tables, "/home/u1", "u1")
    return P.audit(P.publication(tables, ACTOR), known.where("NOT (kind = 'identity' AND secret = 'u1') AND kind <> 'name'"), ACTOR).groupBy("severity", "kind", "field", "secret").agg(F.count("*").alias("n"))


_REGROUP = """
grp AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'manual' ELSE 'remote' END AS origin, CASE WHEN n_nationkey % 3 = 0 THEN 'old' ELSE concat('u', n_nationkey) END AS url FROM nation WHERE n_nationkey % 4 <> 3),
plan AS (SELECT n_nationkey AS k, concat('u', n_nationkey) AS url FROM nation WHERE n_nationkey % 4 <> 1 AND n_nationkey <> 2),
proj AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN g.k WHEN c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 THEN p.k END AS k FROM customer LEFT JOIN grp g ON g.k = c_nationkey LEFT JOIN plan p ON p.k = c_nationkey)"""


def _regrouped(spark, d):
    nation, customer, k = read(spark, d, "nation"), read(spark, d, "customer"), F.col("n_nationkey")
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    group = lambda url, origin: [k.cast("string").alias("group_id"), F.col("n_name").alias("name"), origin.alias("origin"), F.lit("k").alias("match_key"), url.alias("remote_url"), *none("forge", "owner", "repo", "web_url")]
    u = F.concat(F.lit("u"), k)
    groups = nation.where(k % 4 != 3).select(*group(F.when(k % 3 == 0, "old").otherwise(u), F.when(k % 5 == 0, "manual").otherwise("remote")), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    plans = nation.where((k % 4 != 1) & (k != 2)).select(*group(u, F.lit("remote")))
    home, key = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    projects = customer.join(groups.select(F.col("group_id").alias("_g")), home == F.col("_g"), "left").select(key.cast("string").alias("project_id"), F.col("_g").alias("group_id"), (key % 10 == 0).alias("group_pinned"))
    to = customer.where((key % 10 != 0) & (key % 7 != 0) & (key % 3 != 0)).join(plans.select(F.col("group_id").alias("_g")), home == F.col("_g")).select(key.cast("string").alias("project_id"), F.col("_g").alias("group_id"))
    return R.applied(groups, projects, plans, to, 9)


@query(w(_REGROUP, "SELECT CAST(coalesce(g.k, p.k) AS VARCHAR) AS group_id, coalesce(g.name, n_name) AS name, coalesce(g.origin, 'remote') AS origin, coalesce(p.url, g.url) AS remote_url, CAST(CASE WHEN g.k IS NULL OR p.k IS NOT NULL AND p.url <> g.url THEN 9 ELSE 1 END AS BIGINT) AS updated_at FROM grp g FULL JOIN plan p ON p.k = g.k JOIN nation ON n_nationkey = coalesce(g.k, p.k) WHERE coalesce(g.origin, '') = 'manual' OR coalesce(g.k, p.k) IN (SELECT k FROM proj WHERE k IS NOT NULL)"))
def regroup_groups(spark, d):
    return _regrouped(spark, d)[0].select("group_id", "name", "origin", "remote_url", "updated_at")


@query(w(_REGROUP, "SELECT CAST(c_custkey AS VARCHAR) AS project_id, CAST(k AS VARCHAR) AS group_id FROM proj"))
def regroup_projects(spark, d):
    return _regrouped(spark, d)[1].select("project_id", "group_id")
