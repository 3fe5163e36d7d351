"""Team reads, thread order, project upkeep and price upkeep as catalogue queries beside their SQL; imported for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import path_key
from tidemark.operators import cost as C
from tidemark.operators import grouping as G
from tidemark.operators import intervals as I
from tidemark.operators import parents as PA
from tidemark.operators import pricing as P
from tidemark.operators import scope as SC
from tidemark.plans.queries import SWEEP, _I, query, w
from tidemark.plans.views import COST, SPANS, V2, act_event, act_span, iv_span, prices, read

_ME = "7"
_TEAM = f"""access AS (SELECT CAST(s_suppkey % 50 AS VARCHAR) AS account_id, CAST(s_nationkey AS VARCHAR) AS repo_id FROM supplier),
members AS (SELECT CAST(c_custkey % 10 AS VARCHAR) AS team_id, CAST(c_custkey % 50 AS VARCHAR) AS account_id FROM customer WHERE c_custkey % 3 = 0),
roster AS (SELECT CAST(p_size % 10 AS VARCHAR) AS team_id, CAST(p_partkey % 25 AS VARCHAR) AS repo_id, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 50 AS VARCHAR) END AS added_by FROM part WHERE p_partkey % 7 = 0),
sessions AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS account_id, CAST(o_custkey % 25 AS VARCHAR) AS repo_id FROM orders WHERE o_orderstatus = 'F'),
repos AS (SELECT CAST(n_nationkey AS VARCHAR) AS repo_id FROM nation WHERE n_nationkey % 6 <> 0),
listed AS (SELECT r.*, EXISTS (SELECT 1 FROM access a WHERE a.account_id = r.added_by AND a.repo_id = r.repo_id) AS verified FROM roster r WHERE team_id IN (SELECT team_id FROM members WHERE account_id = '{_ME}')),
full_repo AS (SELECT * FROM (SELECT repo_id FROM access WHERE account_id = '{_ME}' UNION SELECT repo_id FROM listed WHERE verified) WHERE repo_id IN (SELECT repo_id FROM repos)),
own_row AS (SELECT * FROM (SELECT repo_id, added_by AS account_id FROM listed WHERE NOT verified AND added_by IS NOT NULL UNION SELECT repo_id, account_id FROM sessions WHERE account_id = '{_ME}') WHERE repo_id IN (SELECT repo_id FROM repos)),
via AS (SELECT * FROM (SELECT repo_id, 'forge' AS reason FROM access WHERE account_id = '{_ME}' UNION SELECT repo_id, concat('team:', team_id) FROM listed UNION SELECT repo_id, 'published' FROM sessions WHERE account_id = '{_ME}') WHERE repo_id IN (SELECT repo_id FROM repos)),
pub AS (SELECT CAST(project_id AS VARCHAR) AS repo_id, CAST(session_id % 50 AS VARCHAR) AS account_id, source, CASE WHEN is_subagent THEN 'autonomous' WHEN thread_id % 2 = 0 THEN 'human' ELSE 'unattended_root' END AS role, started_at, ended_at, ms FROM iv_span),
seen AS (SELECT * FROM pub WHERE repo_id IN (SELECT repo_id FROM full_repo) OR (repo_id, account_id) IN (SELECT repo_id, account_id FROM own_row))"""


def _scope(spark, d) -> SC.Scope:
    text = lambda c: F.expr(c).cast("string")
    access = read(spark, d, "supplier").select(text("s_suppkey % 50").alias("account_id"), text("s_nationkey").alias("repo_id"))
    members = read(spark, d, "customer").where("c_custkey % 3 = 0").select(text("c_custkey % 10").alias("team_id"), text("c_custkey % 50").alias("account_id"))
    roster = read(spark, d, "part").where("p_partkey % 7 = 0").select(text("p_size % 10").alias("team_id"), text("p_partkey % 25").alias("repo_id"), F.when(F.expr("p_partkey % 4 <> 0"), text("p_partkey % 50")).alias("added_by"))
    sessions = read(spark, d, "orders").where("o_orderstatus = 'F'").select(text("o_custkey % 50").alias("account_id"), text("o_custkey % 25").alias("repo_id"))
    return SC.resolve(_ME, access, members, roster, sessions, read(spark, d, "nation").where("n_nationkey % 6 <> 0").select(text("n_nationkey").alias("repo_id")))


def _published(spark, d):
    role = F.when(F.col("is_subagent"), "autonomous").when(F.col("thread_id") % 2 == 0, "human").otherwise("unattended_root")
    return iv_span(spark, d).select(F.col("project_id").cast("string").alias("repo_id"), F.expr("session_id % 50").cast("string").alias("account_id"), "source", role.alias("role"), "started_at", "ended_at", "ms")


def _seen(spark, d, repos=None, **f):
    return SC.team_filter(_scope(spark, d).narrowed(repos).rows(_published(spark, d)), **f)


@query(w(_TEAM.split(",\npub AS")[0], "SELECT repo_id, NULL AS account_id FROM full_repo UNION ALL SELECT repo_id, account_id FROM own_row"))
def scope_resolve(spark, d):
    s = _scope(spark, d)
    return s.full.select("repo_id", F.lit(None).cast("string").alias("account_id")).union(s.own.select("repo_id", "account_id"))


@query(w(_TEAM.split(",\npub AS")[0], "SELECT repo_id, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM via GROUP BY repo_id"))
def scope_via(spark, d):
    return _scope(spark, d).via.select("repo_id", F.array_join("reasons", ",").alias("reasons"))


_PARTS = ", ".join(f"CAST(coalesce(sum(ms) FILTER (WHERE role = '{r}'), 0) AS BIGINT) AS {r}_ms" for r in ("human", "autonomous", "unattended_root"))
_SUM = f"SELECT count(DISTINCT repo_id) AS repos, count(DISTINCT account_id) AS actors, count(*) AS spans, {_I('coalesce(sum(ms), 0)')} AS active_ms, {_PARTS} FROM"


@query(w(f"{V2}, {_TEAM}", f"{_SUM} seen"))
def team_summary(spark, d):
    return SC.team_summary(_seen(spark, d))


@query(w(f"{V2}, {_TEAM}", f"{_SUM} (SELECT * FROM seen WHERE repo_id IN ('1', '2', '3', '7', '24') AND source IN ('1-URGENT', '2-HIGH') AND role = 'human' AND started_at >= 820454400000)"))
def team_summary_filtered(spark, d):
    return SC.team_summary(_seen(spark, d, ["1", "2", "3", "7", "24"], sources=["1-URGENT", "2-HIGH"], role="human", ts_from=820454400000))


@query(w(f"{V2}, {_TEAM}", f"SELECT account_id, {_I('sum(ms)')} AS active_ms, count(DISTINCT repo_id) AS repos, max(ended_at) AS last_at FROM seen GROUP BY account_id"))
def team_actors(spark, d):
    return SC.team_actors(_seen(spark, d))


@query(w(f"{V2}, {_TEAM}", f"SELECT repo_id, coalesce({_I('sum(ms)')}, 0) AS active_ms, count(DISTINCT account_id) AS actors FROM (SELECT repo_id FROM full_repo UNION SELECT repo_id FROM own_row) r LEFT JOIN seen USING (repo_id) GROUP BY repo_id"))
def team_repos(spark, d):
    s = _scope(spark, d)
    return SC.team_repos(s, s.rows(_published(spark, d)))


@query(w(f"{V2}, {_TEAM}", f"SELECT started_at // 86400000 AS day_no, repo_id, {_I('sum(ms)')} AS active_ms FROM seen GROUP BY 1, 2"))
def team_daily(spark, d):
    return SC.team_daily(_seen(spark, d))


# --- threads and their parents: an order's parent is an earlier order of the same priority

_TREE = """th AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 3 END AS parent_id, o_custkey AS session_id FROM orders),
dep AS (SELECT id, 0 AS depth FROM th WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM th) UNION ALL SELECT th.id, depth + 1 FROM th JOIN dep ON th.parent_id = dep.id)"""


def _threads(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.expr("o_orderkey % 3 <> 0"), F.expr("o_orderkey DIV 3")).alias("parent_id"), F.col("o_custkey").alias("session_id"))


@query(f"WITH RECURSIVE {_TREE} SELECT id, depth FROM dep")
def parent_depths(spark, d):
    return PA.depths(_threads(spark, d)).select("id", "depth")


_LANES = """lane_of AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 3 END AS parent_id, o_custkey % 3 AS session_id, o_orderstatus <> 'O' AS sub, started_at AS first_at
  FROM orders JOIN iv_span ON thread_id = o_orderkey),
walk(id, session_id, depth, path) AS (
  SELECT id, session_id, CASE WHEN sub THEN 1 ELSE 0 END, [{'orphan': sub, 'at': first_at, 'id': id}] FROM lane_of t WHERE NOT EXISTS (SELECT 1 FROM lane_of p WHERE p.id = t.parent_id AND p.session_id = t.session_id)
  UNION ALL SELECT t.id, t.session_id, w.depth + 1, list_append(w.path, {'orphan': false, 'at': t.first_at, 'id': t.id}) FROM lane_of t JOIN walk w ON w.id = t.parent_id AND w.session_id = t.session_id)"""


@query(f"WITH RECURSIVE {V2}, {_LANES} SELECT id, depth, CAST(row_number() OVER (PARTITION BY session_id ORDER BY path) AS INTEGER) AS lane FROM walk")
def lanes(spark, d):
    threads = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.expr("o_orderkey % 3 <> 0"), F.expr("o_orderkey DIV 3")).alias("parent_id"), (F.col("o_custkey") % 3).alias("session_id"), (F.col("o_orderstatus") != "O").alias("is_subagent"))
    return PA.lanes(threads, iv_span(spark, d)).select("id", "depth", "lane")


# --- cost, prices and projects

_N = ("input", "output", "cache_read", "cache_write", "cache_write_1h")


@query(w(COST, "SELECT cm AS model, " + ", ".join(f"{_I(f'coalesce(sum({c}_tokens), 0)')} AS {c}" for c in _N) + " FROM carried GROUP BY cm"))
def tokens_by_carried_model(spark, d):
    return C.carry_model(act_event(spark, d)).groupBy(F.col("carried").alias("model")).agg(*(F.coalesce(F.sum(f"{c}_tokens"), F.lit(0)).alias(c) for c in _N))


@query(w(COST, f"SELECT source, round({_I('sum(total)')} / 1e9::DOUBLE, 6) AS cost FROM ledger GROUP BY source"))
def cost_in_units(spark, d):
    return C.cost_ledger(act_event(spark, d), prices(spark)).groupBy("source").agg(F.round(F.sum("total_nano") / 1e9, 6).alias("cost"))


@query(w(SPANS, f", {SWEEP('span')}, p AS (SELECT CASE WHEN max(level) > 0 THEN arg_min(t, (-level, t)) END AS pk FROM lev) SELECT CAST(CAST(make_timestamp(pk * 1000) AS DATE) AS VARCHAR) AS day FROM p WHERE pk IS NOT NULL"))
def peak_day(spark, d):
    return I.concurrency(act_span(spark, d)).where("peak_at IS NOT NULL").select(F.to_date(F.timestamp_millis("peak_at")).cast("string").alias("day"))


@query(w(V2, f"SELECT group_id, count(*) FILTER (WHERE e) AS live, count(*) FILTER (WHERE NOT e) AS gone, count(*) FILTER (WHERE e IS NULL) AS unknown, {_I('coalesce(sum(ms) FILTER (WHERE NOT e), 0)')} AS gone_ms FROM (SELECT group_id, project_id, CASE project_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS e, sum(ms) AS ms FROM iv_span GROUP BY ALL) GROUP BY group_id"))
def existence_tally(spark, d):
    p = iv_span(spark, d).groupBy("group_id", "project_id").agg(F.sum("ms").alias("active_ms")).withColumn("path_exists", F.when(F.col("project_id") % 3 == 0, True).when(F.col("project_id") % 3 == 1, False))
    return PA.existence(p, "group_id")


def _cat(spark, d):
    return read(spark, d, "part").select(F.lower("p_name").alias("model"), F.when(F.expr("p_partkey % 5 = 0"), "manual").otherwise("litellm").alias("origin"), F.concat(F.lit("litellm:acme/"), F.lower("p_name"), F.when(F.expr("p_partkey % 3 = 0"), "-20260101").when(F.expr("p_partkey % 3 = 1"), "-more").otherwise("")).alias("matched_id"))


@query("SELECT DISTINCT lower(p_name) AS model, concat('litellm:acme/', lower(p_name), '-more') AS matched_id FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 = 1")
def price_approximations(spark, d):
    return P.approximations(_cat(spark, d))


@query("SELECT p_partkey, CAST(printf('%.9e', CAST(p_retailprice AS DOUBLE) / 1e9 * 1e6) AS DOUBLE) AS per_million FROM part")
def per_million_rates(spark, d):
    return read(spark, d, "part").select("p_partkey", P.per_million(F.col("p_retailprice").cast("double") / 1e9).alias("per_million"))


@query("""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS g FROM customer), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END END AS g FROM customer),
m AS (SELECT count(*) FILTER (WHERE a.g IS NULL AND b.g IS NOT NULL) AS grouped, count(*) FILTER (WHERE a.g <> b.g) AS moved, count(*) FILTER (WHERE a.g IS NOT NULL AND b.g IS NULL) AS ungrouped FROM a FULL JOIN b USING (id))
SELECT *, (SELECT count(DISTINCT g) FROM b WHERE g IS NOT NULL AND g NOT IN (SELECT g FROM a WHERE g IS NOT NULL)) AS created, (SELECT count(DISTINCT g) FROM a WHERE g IS NOT NULL AND g NOT IN (SELECT g FROM b WHERE g IS NOT NULL)) AS emptied FROM m""")
def grouping_changes(spark, d):
    c, nation = read(spark, d, "customer"), F.col("c_nationkey").cast("string")
    before = c.select(F.col("c_custkey").alias("project_id"), F.when(F.expr("c_custkey % 3 <> 0"), nation).alias("group_id"))
    return G.changes(before, c.select(F.col("c_custkey").alias("project_id"), F.when(F.expr("c_custkey % 5 <> 0"), F.when(F.expr("c_custkey % 7 = 0"), "99").otherwise(nation)).alias("group_id")))


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'n_1')")
def find_by_substring(spark, d):
    return G.find(read(spark, d, "nation").select("n_nationkey", "n_name"), "N_1", "n_name")


_ROOT = "CASE c_custkey % 6 WHEN 0 THEN '/home/u' WHEN 1 THEN '/' WHEN 2 THEN concat('/home/u/', c_nationkey) WHEN 3 THEN concat('/home/u/', c_nationkey, '/.claude/worktrees/w') WHEN 4 THEN concat('/home/u/.t3/worktrees/', c_nationkey, '/x') ELSE concat('/srv/', c_nationkey) END"


@query(f"SELECT c_custkey, c_custkey % 6 >= 2 AS anchors, c_custkey % 6 IN (3, 4) AS is_worktree, CASE c_custkey % 6 WHEN 3 THEN CAST(c_nationkey AS VARCHAR) WHEN 4 THEN CAST(c_nationkey AS VARCHAR) END AS repo, replace({_ROOT}, '/home/u', '~') AS shown FROM customer")
def path_shapes(spark, d):
    p = read(spark, d, "customer").select("c_custkey", F.expr(_ROOT).alias("root")).withColumn("key", path_key(F.col("root")))
    return p.select("c_custkey", G.anchorable(F.col("key")).alias("anchors"), G.is_worktree(F.col("root")).alias("is_worktree"), G.worktree(F.col("key"))["repo"].alias("repo"), G.abbreviate_home(F.col("root"), "/home/u").alias("shown"))
