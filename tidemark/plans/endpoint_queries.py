"""The endpoints as catalogue queries, unfiltered and filtered, beside their SQL; imported for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.filters import Filters
from tidemark.plans import endpoints as E
from tidemark.plans.queries import DAY, SPAN_ONLY, SWEEP, _DAILY, _I, query, w
from tidemark.plans.views import COST, corpus

_N = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
_TS = 1_705_000_000_000
#: The filtered variants: their name, the filters, and the same as SQL on spans.
VARIANTS = (
    ("all", E.NO_FILTER, "TRUE"),
    ("filtered", Filters(projects=(1, 5), groups=(2,), sources=("src_a", "src_b"), ts_from=_TS), f"(coalesce(project_id IN (1, 5), FALSE) OR coalesce(group_id IN (2), FALSE)) AND source IN ('src_a', 'src_b') AND started_at >= {_TS}"),
    ("human", Filters(role="human", ts_to=_TS + 20 * DAY), f"NOT is_subagent AND started_at < {_TS + 20 * DAY}"),
)

_DIMS = """project AS (SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_name AS name, concat('/srv/', lower(n_name)) AS root_path, CASE WHEN n_nationkey <> 5 THEN CAST(n_nationkey % 3 AS BIGINT) END AS group_id,
  n_nationkey % 4 = 0 AS group_pinned, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey % 2 = 0 END AS path_exists FROM nation),
grp AS (SELECT CAST(r_regionkey AS BIGINT) AS group_id, r_name AS name, 'git_remote' AS origin FROM region)"""
_AGENT = "CASE WHEN is_subagent THEN CASE WHEN source = 'src_b' THEN 'src_b agents' ELSE concat('agent-', thread_id % 5) END END AS agent_name"


def _with(where: str, sql: str) -> str:
    """span and ledgers cut to the selected spans, under the names that the shared SQL uses."""
    spans = SPAN_ONLY.replace("\nspan AS (", "\nspan_all AS (", 1)
    inside = lambda rows: f"SELECT x.*, s.started_at FROM {rows} x JOIN span s ON s.thread_id = x.thread_id AND x.ts BETWEEN s.started_at AND s.ended_at"
    un = "SELECT u.*, e.thread_id, e.ts FROM unpriced u JOIN ev e USING (event_id)"
    return w(COST, f", {spans}, span AS (SELECT *, {_AGENT} FROM span_all WHERE {where}), {_DIMS}, led AS ({inside('ledger')}), unp AS ({inside(f'({un})')}) {sql}")


_ALL = " + ".join(f"n{i}" for i in range(1, 6))
_TOTALS = ", ".join(["CAST(coalesce(sum(total), 0) AS BIGINT) AS cost_nano", *(f"CAST(coalesce(sum(n{i + 1}), 0) AS BIGINT) AS {c}_nano" for i, c in enumerate(_N)), "count(*) AS priced_events", "count(*) FILTER (WHERE attributed) AS attributed_events"])
_COSTS = f"SELECT * FROM (SELECT {_TOTALS} FROM led), (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS unpriced_tokens FROM unp)"
_PART = lambda when: f"CAST(coalesce(sum(ms) FILTER (WHERE {when}), 0) AS BIGINT)"
_RANK = f"{_I('sum(ms)')} AS active_ms, count(DISTINCT session_id) AS sessions, count(DISTINCT thread_id) AS threads"

SQL = {
    "summary": f"""SELECT * FROM (SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT thread_id) AS threads, {_I('coalesce(sum(event_count), 0)')} AS events, count(*) AS spans, {_I('coalesce(sum(ms), 0)')} AS active_ms,
{_PART('NOT is_subagent AND attended')} AS human_initiated_ms, {_PART('is_subagent')} AS autonomous_ms, {_PART('NOT is_subagent AND attended IS NOT TRUE')} AS unattended_root_ms FROM span),
(SELECT {', '.join(f"CAST(coalesce(sum({c}_tokens), 0) AS BIGINT) AS {c}_tokens" for c in _N)} FROM ev x JOIN span s ON s.thread_id = x.thread_id AND x.ts BETWEEN s.started_at AND s.ended_at), ({_COSTS})""",
    "timeline": """SELECT span_id, thread_id, session_id, s.project_id, p.name AS project_name, s.group_id, g.name AS group_name, source, agent_name, is_subagent, attended, started_at, ended_at, (SELECT count(*) FROM span) > 4000 AS truncated
FROM (SELECT * FROM span ORDER BY ms DESC, started_at, span_id LIMIT 4000) s LEFT JOIN project p USING (project_id) LEFT JOIN grp g ON g.group_id = s.group_id""",
    "daily": f"""{{WITH}}, {_DAILY}, money AS (SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, {_I('sum(total)')} AS cost_nano FROM led GROUP BY 1),
dm AS (SELECT coalesce(dly.day, money.day) AS day, active_ms, wall_ms, cost_nano FROM dly FULL JOIN money ON dly.day = money.day)
SELECT CAST(CAST(c.day AS DATE) AS VARCHAR) AS day, coalesce(active_ms, 0) AS active_ms, coalesce(wall_ms, 0) AS wall_ms, coalesce(cost_nano, 0) AS cost_nano FROM (SELECT unnest(generate_series((SELECT min(day) FROM dm), (SELECT max(day) FROM dm), INTERVAL 1 DAY)) AS day) c LEFT JOIN dm ON dm.day = CAST(c.day AS DATE)""",
    "concurrency": f"""{{WITH}}, {SWEEP('span')}, c AS (SELECT coalesce(max(level), 0) AS peak, CASE WHEN max(level) > 0 THEN arg_min(t, (-level, t)) END AS peak_at, CAST(coalesce(sum(ms) FILTER (WHERE level > 0), 0) AS BIGINT) AS wall_ms FROM lev),
a AS (SELECT {_I('coalesce(sum(ms), 0)')} AS active_ms FROM span) SELECT *, CASE WHEN wall_ms > 0 THEN round(active_ms / wall_ms, 4) ELSE 0.0 END AS multiplier FROM c, a""",
    "projects": f"""SELECT r.project_id, p.name, p.root_path, p.group_id, g.name AS group_name, p.group_pinned, p.path_exists, active_ms, sessions, threads, first_at, last_at, coalesce(cost_nano, 0) AS cost_nano
FROM (SELECT project_id, {_RANK}, min(started_at) AS first_at, max(ended_at) AS last_at FROM span WHERE project_id IS NOT NULL GROUP BY 1) r JOIN project p USING (project_id) LEFT JOIN grp g ON g.group_id = p.group_id
LEFT JOIN (SELECT project_id, {_I('sum(total)')} AS cost_nano FROM led GROUP BY 1) m ON m.project_id = r.project_id""",
    "groups": f"""SELECT r.*, g.name, g.origin FROM (SELECT s.group_id, {_RANK}, count(DISTINCT s.project_id) AS projects, count(DISTINCT CASE WHEN p.group_pinned THEN p.project_id END) AS pinned_projects, min(started_at) AS first_at, max(ended_at) AS last_at
FROM span s LEFT JOIN project p USING (project_id) GROUP BY 1) r LEFT JOIN grp g ON g.group_id = r.group_id""",
    "agents": f"SELECT agent_name, source, count(DISTINCT thread_id) AS threads, {_I('sum(ms)')} AS active_ms FROM span WHERE agent_name IS NOT NULL GROUP BY 1, 2",
    "heatmap": f"""{{WITH}}, hrs AS (SELECT *, unnest(generate_series(started_at // 3600000, ended_at // 3600000)) AS hn FROM span),
hp AS (SELECT hn, greatest(started_at, hn * 3600000) AS a, least(ended_at, (hn + 1) * 3600000) AS b, started_at = ended_at AS z FROM hrs)
SELECT CAST(isodow(make_timestamp(hn * 3600000000)) - 1 AS INTEGER) AS weekday, CAST(hour(make_timestamp(hn * 3600000000)) AS INTEGER) AS hour, {_I('sum(b - a)')} AS active_ms FROM hp WHERE a < b OR z GROUP BY 1, 2""",
    "cost": _COSTS,
}
PARTS = {
    "by_model": f"SELECT model, {_I('sum(total)')} AS cost_nano, count(*) AS events, count(*) FILTER (WHERE attributed) AS attributed FROM led GROUP BY 1",
    "by_source": f"SELECT source, {_I('sum(total)')} AS cost_nano FROM led GROUP BY 1",
    "daily": f"SELECT CAST(CAST(make_timestamp(ts * 1000) AS DATE) AS VARCHAR) AS day, {_I('sum(total)')} AS cost_nano FROM led GROUP BY 1",
    "unpriced": f"SELECT model, reason, {_I('sum(tokens)')} AS tokens, count(*) AS events FROM unp GROUP BY 1, 2",
    "currency": "SELECT DISTINCT currency FROM led",
}
META = {
    "bounds": "SELECT min(ts) AS first_ts, max(ts) AS last_ts, CAST(21600000 AS BIGINT) AS idle_ms FROM ev",
    "models": "SELECT DISTINCT model FROM ev WHERE model IS NOT NULL",
    "unpriced_models": "SELECT DISTINCT model FROM ev WHERE model IS NOT NULL AND model NOT IN (SELECT model FROM price)",
    "agents": f"SELECT DISTINCT source, agent_name FROM (SELECT source, {_AGENT} FROM ev) WHERE agent_name IS NOT NULL",
    "projects": f"SELECT p.project_id, name, root_path, {_I('coalesce(sum(ms), 0)')} AS active_ms FROM project p LEFT JOIN span s ON s.project_id = p.project_id GROUP BY ALL",
    "groups": f"SELECT g.group_id, name, {_I('coalesce(sum(ms), 0)')} AS active_ms FROM grp g LEFT JOIN span s ON s.group_id = g.group_id GROUP BY ALL",
}


def _add(name: str, where: str, sql: str, run) -> None:
    run.__name__ = name
    query(_with(where, sql.removeprefix("{WITH}")))(run)


def _dated(out):
    """Days as text, as the SQL gives them."""
    return out.withColumn("day", F.col("day").cast("string")) if "day" in out.columns else out


for _name, _f, _where in VARIANTS:
    for _e, _sql in SQL.items():
        _pick = (lambda out: out["totals"]) if _e == "cost" else (lambda out: out)
        _add(f"endpoint_{_e}_{_name}", _where, _sql, lambda spark, d, e=_e, f=_f, pick=_pick: _dated(pick(E.endpoint(e, corpus(spark, d), f))))
for _part, _sql in PARTS.items():
    _add(f"endpoint_cost_{_part}", VARIANTS[1][2], _sql, lambda spark, d, part=_part: _dated(E.endpoint("cost", corpus(spark, d), VARIANTS[1][1])[part]))
for _part, _sql in META.items():
    _add(f"endpoint_meta_{_part}", "TRUE", _sql, lambda spark, d, part=_part: E.endpoint("meta", corpus(spark, d))[part])
_add("stats_active_days", "TRUE", "SELECT count(DISTINCT CAST(make_timestamp(started_at * 1000) AS DATE)) AS active_days FROM span", lambda spark, d: E.stats(corpus(spark, d))["active_days"])
