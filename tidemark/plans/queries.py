"""The query catalogue: every Spark query beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import cost as C
from tidemark.operators import grouping as G
from tidemark.operators import intervals as I
from tidemark.operators import merge as M
from tidemark.operators import pricing as P
from tidemark.operators import redact as R
from tidemark.operators import rollups as A
from tidemark.operators import spans as SP
from tidemark.operators import usage as U
from tidemark.operators.filters import Filters
from tidemark.plans.views import COST, IDLE_MS, SPANS, V1, V2, act_event, act_span, iv_span, prices, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400_000


def query(sql: str | None = None, day: str | None = None):
    """Register a query and its SQL; day: a date column, given as text on both sides."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, d: f(spark, d).withColumn(day, F.col(day).cast("string"))) if day else f
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE (CAST({day} AS VARCHAR) AS {day}) FROM ({sql})" if day else sql
        return f

    return add


def w(view: str, select: str) -> str:
    return f"WITH {view} {select}"


_I = lambda x: f"CAST({x} AS BIGINT)"
_SWEEP = """pts AS (SELECT {k} started_at AS t, 1 AS d FROM {s} UNION ALL SELECT {k} ended_at, -1 FROM {s}),
ins AS (SELECT {k} t, sum(d) AS d FROM pts GROUP BY ALL),
lev AS (SELECT {k} t, CAST(sum(d) OVER ({p} ORDER BY t) AS BIGINT) AS level, coalesce(lead(t) OVER ({p} ORDER BY t) - t, 0) AS ms FROM ins)"""
SWEEP = lambda s, *k: _SWEEP.format(s=s, k="".join(f"{x}, " for x in k), p=f"PARTITION BY {', '.join(k)}" if k else "")


# --- spans ---------------------------------------------------------------------------------------------------------------------------------

@query(w(SPANS, f"SELECT thread_id, span_no, started_at, ended_at, event_count, {_I('ms')} AS ms FROM span"))
def spans_basic(spark, d):
    return act_span(spark, d).select("thread_id", "span_no", "started_at", "ended_at", "event_count", "ms")


@query(w(SPANS, "SELECT thread_id, started_at, ended_at, event_count FROM span"))
def spans_session_window(spark, d):
    return SP.spans_by_session_window(act_event(spark, d), IDLE_MS)


@query(w(SPANS, "SELECT thread_id, span_no, attended FROM span"))
def spans_attended(spark, d):
    return act_span(spark, d).select("thread_id", "span_no", "attended")


@query(w(SPANS, "SELECT span_id, thread_id, started_at FROM span"))
def span_ids(spark, d):
    return act_span(spark, d).select("span_id", "thread_id", "started_at")


@query(w(SPANS, f"SELECT e.thread_id, min(e.ts) AS started_at, max(e.ts) AS ended_at, count(*) AS event_count, coalesce((SELECT {_I('sum(ms)')} FROM span s WHERE s.thread_id = e.thread_id), 0) AS active_ms FROM ev e GROUP BY e.thread_id"))
def thread_rollup(spark, d):
    return A.rollup(act_event(spark, d), "thread_id", IDLE_MS)


@query(w(SPANS, f"SELECT e.session_id, min(e.ts) AS started_at, max(e.ts) AS ended_at, count(*) AS event_count, coalesce((SELECT {_I('sum(ms)')} FROM span s WHERE s.session_id = e.session_id), 0) AS active_ms FROM ev e GROUP BY e.session_id"))
def session_rollup(spark, d):
    return A.rollup(act_event(spark, d), "session_id", IDLE_MS)


_TOTALS = f"count(*) AS spans, count(DISTINCT session_id) AS sessions, count(DISTINCT thread_id) AS threads, {_I("coalesce(sum(event_count), 0)")} AS events, {_I("coalesce(sum(ms), 0)")} AS active_ms"


@query(w(SPANS, f"SELECT {_TOTALS} FROM span"))
def summary_totals(spark, d):
    return A.totals(act_span(spark, d))


@query(w(SPANS, f"SELECT source, {_TOTALS} FROM span GROUP BY source"))
def summary_by_source(spark, d):
    return A.totals(act_span(spark, d), "source")


@query(w(SPANS, f"SELECT CASE WHEN is_subagent THEN 'autonomous' WHEN attended THEN 'human' ELSE 'unattended_root' END AS role, count(*) AS spans, {_I('sum(ms)')} AS active_ms FROM span GROUP BY 1"))
def summary_partition(spark, d):
    return A.by_role(act_span(spark, d))


@query(w(SPANS, ", ".join(["SELECT s.source", *(f"{_I(f'coalesce(sum({c}_tokens), 0)')} AS {c}" for c in ("input", "output", "cache_read", "cache_write", "cache_write_1h"))]) + " FROM ev e JOIN span s ON s.thread_id = e.thread_id AND e.ts BETWEEN s.started_at AND s.ended_at GROUP BY s.source"))
def summary_tokens(spark, d):
    # an event carries its span's number from the gap pass, so the range join is not needed
    return SP.with_span(act_event(spark, d), IDLE_MS).groupBy("source").agg(*(F.coalesce(F.sum(f"{c}_tokens"), F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_write", "cache_write_1h")))


@query(w(SPANS, "SELECT s.thread_id, s.span_no, count(*) AS events FROM ev e JOIN span s ON s.thread_id = e.thread_id AND e.ts BETWEEN s.started_at AND s.ended_at GROUP BY ALL"))
def events_in_span(spark, d):
    # the gap pass numbers events and spans alike, so no range join is needed
    return SP.with_span(act_event(spark, d), IDLE_MS).groupBy("thread_id", "span_no").agg(F.count("*").alias("events"))


@query(w(V1, ", g AS (SELECT ts - lag(ts) OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS gap FROM ev) SELECT p, quantile_disc(gap, p) AS gap FROM g, (VALUES (0.5), (0.9), (0.99)) q(p) WHERE gap IS NOT NULL GROUP BY p".replace("quantile_disc(gap, p)", "CASE p WHEN 0.5 THEN quantile_disc(gap, 0.5) WHEN 0.9 THEN quantile_disc(gap, 0.9) ELSE quantile_disc(gap, 0.99) END").replace("SELECT p,", "SELECT CAST(p AS DOUBLE) AS p,")))
def gap_percentiles(spark, d):
    gap = F.col("ts") - F.lag("ts").over(W.partitionBy("thread_id").orderBy("ts", "event_id"))
    gaps = act_event(spark, d).select(gap.alias("gap")).where("gap IS NOT NULL")
    one = gaps.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY gap)").cast("long").alias(str(p)) for p in (0.5, 0.9, 0.99)))
    return one.selectExpr("stack(3, 0.5D, `0.5`, 0.9D, `0.9`, 0.99D, `0.99`) AS (p, gap)")


# --- intervals -----------------------------------------------------------------------------------------------------------------------------

@query(w(SPANS, f", {SWEEP('span')} SELECT level, {_I('sum(ms)')} AS ms FROM lev WHERE level > 0 AND ms > 0 GROUP BY level"))
def concurrency_levels(spark, d):
    return I.time_at_level(act_span(spark, d))


_CONC = "{k} max(level) AS peak, CASE WHEN max(level) > 0 THEN arg_min(t, (-level, t)) END AS peak_at, CAST(coalesce(sum(ms) FILTER (WHERE level > 0), 0) AS BIGINT) AS wall_ms"


@query(w(SPANS, f", {SWEEP('span')}, c AS (SELECT {_CONC.format(k='')} FROM lev), a AS (SELECT {_I('sum(ms)')} AS active_ms FROM span) SELECT *, CASE WHEN wall_ms > 0 THEN round(active_ms / wall_ms, 4) ELSE 0.0 END AS multiplier FROM c, a"))
def concurrency_peak(spark, d):
    return I.concurrency(act_span(spark, d))


@query(w(V2, f", {SWEEP('iv_span', 'source')}, c AS (SELECT {_CONC.format(k='source,')} FROM lev GROUP BY source), a AS (SELECT source, {_I('sum(ms)')} AS active_ms FROM iv_span GROUP BY source) SELECT c.*, active_ms, CASE WHEN wall_ms > 0 THEN round(active_ms / wall_ms, 4) ELSE 0.0 END AS multiplier FROM c JOIN a USING (source)"))
def concurrency_by_source(spark, d):
    return I.concurrency(iv_span(spark, d), "source")


@query(w(SPANS, f", {SWEEP('span')} SELECT {_I('coalesce(sum(ms), 0)')} AS ms FROM lev WHERE level >= 2"))
def at_least_2(spark, d):
    return I.time_at_level(act_span(spark, d)).where("level >= 2").agg(F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"))


@query(w(V2, f", {SWEEP('iv_span', 'project_id')} SELECT project_id, {_I('coalesce(sum(ms) FILTER (WHERE level > 0), 0)')} AS wall_ms FROM lev GROUP BY project_id"))
def union_wall(spark, d):
    return I.union_length(iv_span(spark, d), "project_id")


@query(w(V2, "SELECT span_id, started_at, ended_at, CAST(ms AS BIGINT) AS ms, (SELECT count(*) FROM iv_span) > 4000 AS truncated FROM iv_span ORDER BY ms DESC, started_at, span_id LIMIT 4000"))
def timeline_topk(spark, d):
    return A.widest(iv_span(spark, d), 4000).select("span_id", "started_at", "ended_at", "ms", "truncated")


_DAYS = f"""days AS (SELECT *, unnest(generate_series(started_at // {DAY}, ended_at // {DAY})) AS dn FROM span),
piece AS (SELECT source, dn, greatest(started_at, dn * {DAY}) AS started_at, least(ended_at, (dn + 1) * {DAY}) AS ended_at, started_at = ended_at AS zero FROM days),
pc AS (SELECT *, CAST(make_timestamp(dn * {DAY} * 1000) AS DATE) AS day FROM piece WHERE started_at < ended_at OR zero)"""
_DAILY = f"{_DAYS}, {SWEEP('pc', 'day')}, act AS (SELECT day, {_I('sum(ended_at - started_at)')} AS active_ms FROM pc GROUP BY day), wal AS (SELECT day, {_I('coalesce(sum(ms) FILTER (WHERE level > 0), 0)')} AS wall_ms FROM lev GROUP BY day), dly AS (SELECT * FROM act JOIN wal USING (day))"


@query(w(SPANS, f", {_DAILY} SELECT day, active_ms FROM act"), day="day")
def daily_active(spark, d):
    pieces = I.split(act_span(spark, d), "DAY")
    return pieces.groupBy(F.to_date("bucket").alias("day")).agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("active_ms"))


@query(w(SPANS, f", {_DAILY} SELECT * FROM dly"), day="day")
def daily_wall(spark, d):
    return I.daily(act_span(spark, d))


@query(w(SPANS, f", {_DAYS} SELECT day, source, {_I('sum(ended_at - started_at)')} AS active_ms FROM pc GROUP BY ALL"), day="day")
def daily_by_source(spark, d):
    return I.split(act_span(spark, d), "DAY").groupBy(F.to_date("bucket").alias("day"), "source").agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("active_ms"))


@query(w(SPANS, f", {_DAILY}, sub AS (SELECT * FROM dly WHERE active_ms % 3 <> 0) SELECT CAST(c.day AS DATE) AS day, coalesce(active_ms, 0) AS active_ms, coalesce(wall_ms, 0) AS wall_ms FROM (SELECT unnest(generate_series((SELECT min(day) FROM sub), (SELECT max(day) FROM sub), INTERVAL 1 DAY)) AS day) c LEFT JOIN sub ON sub.day = CAST(c.day AS DATE)"), day="day")
def daily_gapfill(spark, d):
    return I.fill_days(I.daily(act_span(spark, d)).where("active_ms % 3 <> 0"), active_ms=F.lit(0), wall_ms=F.lit(0))


@query(w(SPANS, f", {_DAILY} SELECT CAST(date_trunc('week', day) AS DATE) AS week, {_I('sum(active_ms)')} AS active_ms, {_I('sum(wall_ms)')} AS wall_ms, greatest(0, {_I('sum(active_ms)')} - {_I('sum(wall_ms)')}) AS surplus_ms FROM dly GROUP BY 1"), day="week")
def weekly_surplus(spark, d):
    return I.weekly(I.daily(act_span(spark, d)))


@query(w(SPANS, f""", hrs AS (SELECT *, unnest(generate_series(started_at // 3600000, ended_at // 3600000)) AS hn FROM span),
hp AS (SELECT hn, greatest(started_at, hn * 3600000) AS a, least(ended_at, (hn + 1) * 3600000) AS b, started_at = ended_at AS z FROM hrs)
SELECT CAST(isodow(make_timestamp(hn * 3600000000)) - 1 AS INTEGER) AS weekday, CAST(hour(make_timestamp(hn * 3600000000)) AS INTEGER) AS hour, {_I('sum(b - a)')} AS ms FROM hp WHERE a < b OR z GROUP BY 1, 2"""))
def heatmap(spark, d):
    return I.heatmap(act_span(spark, d))


_W = (1_705_000_000_000, 1_705_600_000_000)


@query(w(SPANS, f", cl AS (SELECT greatest(started_at, {_W[0]}) AS started_at, least(ended_at, {_W[1]}) AS ended_at FROM span WHERE ended_at > {_W[0]} AND started_at < {_W[1]}), {SWEEP('cl')} SELECT level, {_I('sum(ms)')} AS ms FROM lev WHERE level > 0 AND ms > 0 GROUP BY level"))
def window_clip_stats(spark, d):
    return I.time_at_level(I.clip(act_span(spark, d), *_W))


@query(w(SPANS, f", p AS (SELECT *, started_at // {DAY} AS day_no FROM span) SELECT day_no, source, {_I('sum(ms)')} AS active_ms FROM p GROUP BY ALL"))
def team_daily_utc(spark, d):
    return act_span(spark, d).groupBy(F.floor(F.col("started_at") / DAY).alias("day_no"), "source").agg(F.sum("ms").alias("active_ms"))


# --- rankings and filters --------------------------------------------------------------------------------------------------------------------

_RANK = f"{_I('sum(ms)')} AS active_ms, count(DISTINCT session_id) AS sessions, count(DISTINCT thread_id) AS threads, min(started_at) AS first_at, max(ended_at) AS last_at"


@query(w(V2, f"SELECT project_id, {_RANK} FROM iv_span GROUP BY project_id"))
def projects_ranking(spark, d):
    return A.ranking(iv_span(spark, d), "project_id")


@query(w(COST, f", {SPANS.split(V1)[1].lstrip(',')}, m AS (SELECT project_id, {_I('sum(total)')} AS cost_nano FROM ledger GROUP BY project_id), r AS (SELECT project_id, {_RANK} FROM span GROUP BY project_id) SELECT r.*, coalesce(cost_nano, 0) AS cost_nano FROM r LEFT JOIN m ON r.project_id IS NOT DISTINCT FROM m.project_id"))
def projects_cost_ranking(spark, d):
    return A.ranking(act_span(spark, d), "project_id", C.cost_ledger(act_event(spark, d), prices(spark), ("project_id",)))


@query(w(V2, f", x AS (SELECT * FROM iv_span WHERE started_at >= 883612800000) SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_name AS name, coalesce((SELECT {_I('sum(ms)')} FROM x WHERE x.project_id = n_nationkey), 0) AS active_ms FROM nation"))
def projects_roster(spark, d):
    dim = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("name"))
    return A.roster(dim, iv_span(spark, d).where("started_at >= 883612800000"), "project_id")


@query(w(SPANS, f"SELECT group_id, {_RANK}, count(DISTINCT project_id) AS projects FROM span WHERE group_id IS NOT NULL GROUP BY group_id"))
def groups_ranking(spark, d):
    s = act_span(spark, d).where("group_id IS NOT NULL")
    return A.ranking(s, "group_id").join(s.groupBy("group_id").agg(F.countDistinct("project_id").alias("projects")), "group_id")


@query(w(SPANS, f"SELECT {_TOTALS} FROM span WHERE group_id IS NULL"))
def groups_ungrouped(spark, d):
    return A.totals(act_span(spark, d).where("group_id IS NULL"))


@query(w(SPANS, f"SELECT {_I('sum(ms) FILTER (WHERE group_id IS NOT NULL)')} AS grouped, {_I('sum(ms) FILTER (WHERE group_id IS NULL)')} AS ungrouped, {_I('sum(ms)')} AS active FROM span"))
def groups_partition_check(spark, d):
    s = act_span(spark, d)
    return s.agg(F.sum(F.when(F.col("group_id").isNotNull(), F.col("ms"))).alias("grouped"), F.sum(F.when(F.col("group_id").isNull(), F.col("ms"))).alias("ungrouped"), F.sum("ms").alias("active"))


@query(w(SPANS, f"SELECT source, CASE WHEN source = 'src_b' THEN 'src_b agents' ELSE concat('agent-', thread_id % 5) END AS agent, count(DISTINCT thread_id) AS threads, {_I('sum(ms)')} AS active_ms FROM span WHERE is_subagent GROUP BY ALL"))
def agents_ranking(spark, d):
    agent = F.when(F.col("source") == "src_b", "src_b agents").otherwise(F.concat(F.lit("agent-"), (F.col("thread_id") % 5).cast("string")))
    return act_span(spark, d).where("is_subagent").groupBy("source", agent.alias("agent")).agg(F.countDistinct("thread_id").alias("threads"), F.sum("ms").alias("active_ms"))


def _filtered(spark, d, **f):
    return A.totals(iv_span(spark, d).where(Filters(**f).predicate()))


@query(w(V2, f"SELECT {_TOTALS} FROM iv_span WHERE project_id IN (3, 7) OR group_id IN (1)"))
def filter_project_or_group(spark, d):
    return _filtered(spark, d, projects=(3, 7), groups=(1,))


@query(w(V2, f"SELECT {_TOTALS} FROM iv_span WHERE started_at >= 820454400000 AND started_at < 852076800000"))
def filter_range_half_open(spark, d):
    return _filtered(spark, d, ts_from=820454400000, ts_to=852076800000)


@query(w(V2, f"SELECT {_TOTALS} FROM iv_span WHERE is_subagent"))
def filter_role(spark, d):
    return _filtered(spark, d, role="autonomous")


@query(w(V2, f"SELECT {_TOTALS} FROM iv_span WHERE (project_id IN (1, 2, 3) OR group_id IN (2)) AND source IN ('1-URGENT', '2-HIGH') AND started_at >= 820454400000 AND NOT is_subagent"))
def filter_composed(spark, d):
    return _filtered(spark, d, projects=(1, 2, 3), groups=(2,), sources=("1-URGENT", "2-HIGH"), ts_from=820454400000, role="human")


@query(w(V2, f", r AS (SELECT project_id, {_I('sum(ms)')} AS active_ms FROM iv_span GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY active_ms DESC, project_id) AS rn FROM r) SELECT CASE WHEN rn <= 8 THEN CAST(project_id AS VARCHAR) ELSE 'other' END AS key, {_I('sum(active_ms)')} AS active_ms, count(*) AS members FROM t GROUP BY 1"))
def top_n_other(spark, d):
    return A.top_with_rest(iv_span(spark, d).groupBy("project_id").agg(F.sum("ms").alias("active_ms")), "project_id", "active_ms", 8)


@query(w(V2, f", r AS (SELECT source, {_I('sum(ms)')} AS active_ms FROM iv_span GROUP BY 1) SELECT *, round(active_ms / sum(active_ms) OVER (), 4) AS share FROM r"))
def share_of_whole(spark, d):
    return A.share(iv_span(spark, d).groupBy("source").agg(F.sum("ms").alias("active_ms")), "active_ms")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (100, 5000) ORDER BY o_custkey, o_orderkey LIMIT 500")
def keyset_page(spark, d):
    return A.keyset_page(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderkey"], (100, 5000), 500)


@query("SELECT count(*) AS n, CAST(coalesce(sum(CAST(concat('0x', substr(md5(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), coalesce(c_name, chr(0)), coalesce(CAST(c_nationkey AS VARCHAR), chr(0)))), 1, 12)) AS BIGINT)), 0) AS BIGINT) AS digest FROM customer")
def table_digest(spark, d):
    return A.digest(read(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"])


@query(w(SPANS, f"SELECT source, project_id, CAST(grouping(source, project_id) AS INTEGER) AS level, {_I('sum(ms)')} AS active_ms FROM span GROUP BY ROLLUP (source, project_id)"))
def grouping_sets_source_project(spark, d):
    return act_span(spark, d).rollup("source", "project_id").agg(F.grouping_id().cast("int").alias("level"), F.sum("ms").alias("active_ms"))


# --- cost ------------------------------------------------------------------------------------------------------------------------------------

@query(w(COST, "SELECT event_id, cm AS carried, attributed FROM carried"))
def carry_forward_model(spark, d):
    return C.carry_model(act_event(spark, d)).select("event_id", "carried", "attributed")


@query(w(COST, "SELECT event_id, cm AS carried, price_from, currency FROM priced"))
def asof_rate(spark, d):
    return C.priced(act_event(spark, d), prices(spark)).select("event_id", "carried", "price_from", "currency")


_N = ("input", "output", "cache_read", "cache_write", "cache_write_1h")


@query(w(COST, "SELECT event_id, model, attributed, price_from, " + ", ".join(f"n{i + 1} AS {c}_nano" for i, c in enumerate(_N)) + ", total AS total_nano FROM ledger"))
def cost_ledger(spark, d):
    return C.cost_ledger(act_event(spark, d), prices(spark)).select("event_id", "model", "attributed", "price_from", *(f"{c}_nano" for c in _N), "total_nano")


@query(w(COST, "SELECT event_id, model, tokens, reason FROM unpriced"))
def cost_unpriced(spark, d):
    return C.unpriced_ledger(act_event(spark, d), prices(spark)).select("event_id", "model", "tokens", "reason")


@query(w(COST, "SELECT " + ", ".join(f"{_I(f'sum(n{i + 1})')} AS {c}_nano" for i, c in enumerate(_N)) + f", {_I('sum(total)')} AS total_nano, count(*) AS events, count(*) FILTER (WHERE attributed) AS attributed FROM ledger"))
def cost_by_component(spark, d):
    led = C.cost_ledger(act_event(spark, d), prices(spark))
    return led.agg(*(F.sum(f"{c}_nano").alias(f"{c}_nano") for c in _N), F.sum("total_nano").alias("total_nano"), F.count("*").alias("events"), F.count_if("attributed").alias("attributed"))


def _cost_by(key):
    def run(spark, d):
        led = C.cost_ledger(act_event(spark, d), prices(spark))
        return led.groupBy(key).agg(F.sum("total_nano").alias("total_nano"), F.count("*").alias("events"))

    return run


for _key in ("model", "source"):
    _f = _cost_by(_key)
    _f.__name__ = f"cost_by_{_key}"
    query(w(COST, f"SELECT {_key}, {_I('sum(total)')} AS total_nano, count(*) AS events FROM ledger GROUP BY 1"))(_f)

SPAN_ONLY = SPANS.split(V1)[1].lstrip(",")


@query(w(COST, f", {SPAN_ONLY} SELECT CAST(make_timestamp(l.ts * 1000) AS DATE) AS day, {_I('sum(total)')} AS total_nano, count(*) AS events FROM ledger l JOIN span s ON s.thread_id = l.thread_id AND l.ts BETWEEN s.started_at AND s.ended_at GROUP BY 1"), day="day")
def cost_daily(spark, d):
    """Events inside spans only, so that the days sum to what the cost endpoint totals."""
    led = C.cost_ledger(SP.with_span(act_event(spark, d), IDLE_MS), prices(spark))
    return led.groupBy(F.to_date(F.timestamp_millis("ts")).alias("day")).agg(F.sum("total_nano").alias("total_nano"), F.count("*").alias("events"))


@query(w(COST, f"SELECT source, {_I('sum(t4)')} AS tokens, count(*) AS events FROM priced WHERE assumed GROUP BY source"))
def assumed_5m(spark, d):
    return C.priced(act_event(spark, d), prices(spark)).where("assumed_5m").groupBy("source").agg(F.sum("t_cache_write").alias("tokens"), F.count("*").alias("events"))


@query(w(COST, f"SELECT model, reason, {_I('sum(tokens)')} AS tokens, count(*) AS events FROM unpriced GROUP BY ALL"))
def unpriced_tokens(spark, d):
    return C.unpriced_ledger(act_event(spark, d), prices(spark)).groupBy("model", "reason").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("events"))


@query(w(COST, "SELECT DISTINCT currency FROM ledger"))
def currency_in_use(spark, d):
    return C.cost_ledger(act_event(spark, d), prices(spark)).select("currency").distinct()


@query(w(V1, f"SELECT source, {_I('sum(cache_write_tokens) FILTER (WHERE cache_write_1h_tokens IS NOT NULL)')} AS known, {_I('sum(cache_write_tokens)')} AS total FROM ev GROUP BY source"))
def token_coverage(spark, d):
    return act_event(spark, d).groupBy("source").agg(F.sum(F.when(F.col("cache_write_1h_tokens").isNotNull(), F.col("cache_write_tokens"))).alias("known"), F.sum("cache_write_tokens").alias("total"))


@query(w(COST, "SELECT DISTINCT model FROM ev WHERE model IS NOT NULL AND model NOT IN (SELECT model FROM price)"))
def anti_unpriced_models(spark, d):
    return act_event(spark, d).select("model").where("model IS NOT NULL").distinct().join(prices(spark), "model", "left_anti")


@query(w(V1, f""", s AS (SELECT model, ts, output_tokens % 7 AS rate, event_id FROM ev WHERE model IS NOT NULL), c AS (SELECT *, row_number() OVER w = 1 OR rate IS DISTINCT FROM lag(rate) OVER w AS fresh FROM s WINDOW w AS (PARTITION BY model ORDER BY ts))
SELECT model, ts AS valid_from, lead(ts) OVER (PARTITION BY model ORDER BY ts) AS valid_to, rate FROM c WHERE fresh"""))
def scd2_price_history(spark, d):
    snaps = act_event(spark, d).where("model IS NOT NULL").select("model", "ts", "event_id", (F.col("output_tokens") % 7).alias("rate"))
    return P.history(snaps, "model", "ts", "rate", tie="event_id")


# --- ingest rules ------------------------------------------------------------------------------------------------------------------------------

@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def dedup_first_wins(spark, d):
    return A.first_wins(read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], ["l_linenumber"])


@query(w(V1, "SELECT session_id, arg_max(model, (ts, event_id)) FILTER (WHERE model IS NOT NULL) AS model, arg_max(project_id, (ts, event_id)) FILTER (WHERE project_id IS NOT NULL) AS project_id FROM ev GROUP BY session_id"))
def latest_non_null(spark, d):
    return A.latest_non_null(act_event(spark, d), "session_id", ["model", "project_id"], ["ts", "event_id"])


@query(w(V1, "SELECT session_id, bool_or(is_subagent) AS any_subagent FROM ev GROUP BY session_id"))
def sticky_or(spark, d):
    return act_event(spark, d).groupBy("session_id").agg(F.bool_or("is_subagent").alias("any_subagent"))


_RUN = ", l AS (SELECT thread_id, event_id, ts, model, output_tokens, CASE WHEN row_number() OVER w = 1 OR model IS DISTINCT FROM lag(model) OVER w THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY thread_id ORDER BY event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY thread_id ORDER BY event_id) AS run FROM l)"


@query(w(V1, f"{_RUN} SELECT event_id, row_number() OVER w = 1 AS first, greatest(output_tokens - coalesce(max(output_tokens) OVER (PARTITION BY thread_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS billed_output FROM r WINDOW w AS (PARTITION BY thread_id, run ORDER BY event_id)"))
def response_billing_increment(spark, d):
    return U.bill_once(act_event(spark, d), "thread_id", "event_id", ["model"], "output_tokens").select("event_id", "first", "billed_output")


@query(w(V1, "SELECT event_id, greatest(cache_read_tokens - coalesce(lag(cache_read_tokens) OVER (PARTITION BY thread_id ORDER BY ts, event_id), 0), 0) AS delta FROM ev"))
def saturating_delta(spark, d):
    return U.increments(act_event(spark, d), "thread_id", ["ts", "event_id"], "cache_read_tokens").select("event_id", "delta")


@query(w(V1, "SELECT event_id, CASE WHEN m IS NULL OR cache_read_tokens > m THEN input_tokens ELSE 0 END AS counted FROM (SELECT *, max(cache_read_tokens) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev)"))
def usage_when_advanced(spark, d):
    return U.advanced_only(act_event(spark, d), "thread_id", ["ts", "event_id"], "cache_read_tokens", "input_tokens").select("event_id", "counted")


@query(w(V1, ", t AS (SELECT DISTINCT thread_id AS id FROM ev), k AS (SELECT id, CASE WHEN id % 11 = 0 THEN id ELSE id - id % 4 END AS p FROM t) SELECT k.id, t.id AS parent_thread_id FROM k LEFT JOIN t ON t.id = k.p AND k.p <> k.id"))
def parent_link_guarded(spark, d):
    t = act_event(spark, d).select(F.col("thread_id").alias("id")).distinct()
    return M.guarded_parents(t, t.select("id", F.when(F.col("id") % 11 == 0, F.col("id")).otherwise(F.col("id") - F.col("id") % 4).alias("parent_thread_id")))


_PROBE = "p AS (SELECT l_partkey AS project_id, CAST(l_suppkey % 10 AS VARCHAR) AS host_id, CASE WHEN l_linenumber > 3 THEN NULL ELSE epoch_us(l_shipdate) // 1000 END AS detected_at, CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS path_exists, l_orderkey FROM lineitem)"


def _probes(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("project_id"), (F.col("l_suppkey") % 10).cast("string").alias("host_id"), F.when(F.col("l_linenumber") <= 3, S.to_millis(F.col("l_shipdate"))).alias("detected_at"), F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("path_exists"))


@query(w(_PROBE, "SELECT project_id, host_id, detected_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY host_id = '3' DESC, coalesce(detected_at, 0) DESC, host_id) AS rn FROM p) WHERE rn = 1"))
def best_probe(spark, d):
    return G.best_probe(_probes(spark, d), "3").select("project_id", "host_id", "detected_at")


@query(w(_PROBE, "SELECT project_id, bool_or(path_exists) AS path_exists FROM p GROUP BY project_id"))
def path_exists_any(spark, d):
    return G.exists_anywhere(_probes(spark, d))


_HOSTS = "h AS (SELECT user_id % 50 AS host_id, min(epoch_us(ts) // 1000) AS first_seen, max(epoch_us(ts) // 1000) AS last_seen FROM events GROUP BY ALL)"


@query("WITH h AS (SELECT user_id % 50 AS host_id, epoch_us(ts) // 1000 AS t, event_type FROM events) SELECT host_id, min(t) AS first_seen, max(t) AS last_seen, arg_max(event_type, t) FILTER (WHERE event_type <> 'view') AS os FROM h GROUP BY host_id")
def merge_host_minmax(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 50).alias("host_id"), S.to_millis(F.col("ts")).alias("first_seen"), S.to_millis(F.col("ts")).alias("last_seen"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("os"), "event_id")
    return M.merge_hosts(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"))


@query("WITH s AS (SELECT c_custkey AS project_id, CAST(c_nationkey AS BIGINT) AS group_id, c_custkey % 3 = 0 AS group_pinned FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS project_id, CAST(c_nationkey + 100 AS BIGINT) AS group_id, c_custkey % 7 = 0 AS group_pinned FROM customer WHERE c_custkey % 4 <> 0) SELECT project_id, CASE WHEN coalesce(s.group_pinned, FALSE) OR n.project_id IS NULL THEN s.group_id ELSE n.group_id END AS group_id, coalesce(s.group_pinned, FALSE) OR coalesce(n.group_pinned, FALSE) AS group_pinned FROM s FULL JOIN n USING (project_id)")
def merge_pin_survives(spark, d):
    c = read(spark, d, "customer")
    row = lambda g, m: (F.col("c_custkey").alias("project_id"), (F.col("c_nationkey") + g).cast("long").alias("group_id"), (F.col("c_custkey") % m == 0).alias("group_pinned"))
    return M.merge_projects(c.where("c_custkey % 5 <> 0").select(*row(0, 3)), c.where("c_custkey % 4 <> 0").select(*row(100, 7)))


@query("SELECT count(*) AS inserted FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)")
def insert_if_absent(spark, d):
    stored = read(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return M.insert_absent(stored, read(spark, d, "orders"), ["o_orderkey"]).agg(F.count("*").alias("inserted"))


@query("WITH s AS (SELECT c_custkey AS id, c_mktsegment AS a, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'new' END AS a, CASE WHEN c_custkey % 5 = 0 THEN 1.5 END AS b FROM customer WHERE c_custkey % 4 <> 0) SELECT id, coalesce(n.a, s.a) AS a, CAST(coalesce(n.b, s.b) AS DOUBLE) AS b FROM s FULL JOIN n USING (id)")
def upsert_coalesce(spark, d):
    c = read(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    s = c.where("id % 3 <> 0").select("id", F.col("c_mktsegment").alias("a"), F.col("c_acctbal").alias("b"))
    n = c.where("id % 4 <> 0").select("id", F.when(F.col("id") % 2 != 0, "new").alias("a"), F.when(F.col("id") % 5 == 0, 1.5).alias("b"))
    return M.coalesce_upsert(s, n, ["id"])


@query("SELECT l_orderkey AS id, l_linenumber AS line, CAST(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity END, (SELECT max(o_totalprice) FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')) AS DOUBLE) AS v FROM lineitem")
def backfill_nulls(spark, d):
    stored = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity").cast("double")).alias("v"))
    return M.backfill(stored, read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")), "id", "v")


# --- strings, grouping, publication ------------------------------------------------------------------------------------------------------------

@query("WITH u AS (SELECT page_id, concat('git@', upper(regexp_extract(url, '^[a-z]+://([^/]+)', 1)), ':Team/', page_id % 100, '.git') AS raw FROM pages) SELECT page_id, concat('https://', lower(regexp_extract(raw, '^git@([^:]+):', 1)), '/Team/', page_id % 100) AS remote, lower(regexp_extract(raw, '^git@([^:]+):', 1)) AS host, 'Team' AS owner, CAST(page_id % 100 AS VARCHAR) AS repo FROM u")
def normalize_remote(spark, d):
    raw = F.concat(F.lit("git@"), F.upper(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)), F.lit(":Team/"), (F.col("page_id") % 100).cast("string"), F.lit(".git"))
    p = read(spark, d, "pages").select("page_id", S.normalize_remote(raw).alias("remote"))
    return p.select("page_id", "remote", *(v.alias(k) for k, v in S.forge(F.col("remote")).items()))


_PARTS = r"""u AS (SELECT page_id, regexp_replace(trim(url), '^[a-z+]+://([^/@]*@)?', '') AS rest FROM pages),
p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(rest, '/+$', ''), '\.git$', ''), '/+$', ''), '/') AS seg FROM u)"""


@query(f"WITH {_PARTS} SELECT page_id, lower(seg[1]) AS host, CASE WHEN len(seg) > 2 THEN seg[2] END AS owner, CASE WHEN len(seg) > 1 THEN seg[-1] END AS repo FROM p")
def parse_forge(spark, d):
    p = read(spark, d, "pages").select("page_id", S.normalize_remote(F.col("url")).alias("remote"))
    return p.select("page_id", *(v.alias(k) for k, v in S.forge(F.col("remote")).items()))


@query("SELECT p_partkey, regexp_replace(concat('acme/', p_brand, '-', '2024010', p_size % 10), '-(\\d{8}|\\d{4}-\\d{2}-\\d{2})$', '') AS model FROM part")
def strip_date_suffix(spark, d):
    return read(spark, d, "part").select("p_partkey", S.strip_date(F.concat(F.lit("acme/"), "p_brand", F.lit("-2024010"), (F.col("p_size") % 10).cast("string"))).alias("model"))


@query("SELECT p_partkey, translate(lower(concat(p_brand, '.', p_size % 10)), '.@', '--') AS spelled FROM part")
def spelling_normalize(spark, d):
    return read(spark, d, "part").select("p_partkey", S.spelling(F.concat(F.lit("acme/x:"), "p_brand", F.lit("."), (F.col("p_size") % 10).cast("string"))).alias("spelled"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS INTEGER) AS n_tokens FROM documents")
def tokenize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(S.tokens_of(F.col("text"))).alias("n_tokens"))


_SECRETS = ("idiot", "clown", "nowhere")


@query("WITH s(secret) AS (VALUES ('idiot'), ('clown'), ('nowhere')), t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents) SELECT secret, count(t.word) AS n FROM s LEFT JOIN t ON t.word = s.secret GROUP BY secret")
def audit_contains(spark, d):
    return R.audit(read(spark, d, "documents"), "text", spark.createDataFrame([(s,) for s in _SECRETS], "secret string"))


_REPOS = "repo AS (SELECT * FROM (VALUES (0, 'r0'), (2, 'r2'), (3, 'r0')) t(pid, repo_id))"


def _repos(spark):
    return spark.createDataFrame([(0, "r0"), (2, "r2"), (3, "r0")], "project_id long, repo_id string")


@query(w(SPANS, f", {_REPOS} SELECT span_id, session_id, thread_id, started_at, ended_at, event_count, repo_id, CASE WHEN is_subagent THEN 'autonomous' WHEN attended THEN 'human' ELSE 'unattended_root' END AS role FROM span JOIN repo ON pid = project_id"))
def publication_spans_role(spark, d):
    return R.publish_spans(act_span(spark, d), _repos(spark))


@query(w(SPANS, f", {_REPOS} SELECT session_id, repo_id, min(started_at) AS started_at, max(ended_at) AS ended_at, {_I('sum(event_count)')} AS event_count FROM span JOIN repo ON pid = project_id GROUP BY ALL"))
def publication_sessions(spark, d):
    return R.publish_spans(act_span(spark, d), _repos(spark)).groupBy("session_id", "repo_id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("event_count").alias("event_count"))


@query(w(SPANS, f", {_REPOS} SELECT {_I('coalesce(sum(ms), 0)')} AS withheld_ms, count(DISTINCT project_id) AS withheld_projects FROM span WHERE project_id IS NULL OR project_id NOT IN (SELECT pid FROM repo)"))
def withheld_totals(spark, d):
    return R.withheld(act_span(spark, d), _repos(spark))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT') OR (o_orderpriority, o_custkey) IN (SELECT '2-HIGH', c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def scope_visible_rows(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("repo_id"), F.col("o_custkey").alias("account_id"))
    own = read(spark, d, "customer").where("c_custkey % 10 = 0").select(F.lit("2-HIGH").alias("repo_id"), F.col("c_custkey").alias("account_id"))
    return R.visible(rows, spark.createDataFrame([("1-URGENT",)], "repo_id string"), own).select("o_orderkey")


@query("WITH f AS (SELECT l_partkey AS repo_id, l_suppkey % 20 AS team_id, l_returnflag = 'R' AS suppress FROM lineitem) SELECT repo_id, coalesce(bool_or(suppress) FILTER (WHERE team_id < 5), bool_or(suppress)) AS suppressed FROM f GROUP BY repo_id")
def branch_suppression(spark, d):
    flags = read(spark, d, "lineitem").select(F.col("l_partkey").alias("repo_id"), (F.col("l_suppkey") % 20).alias("team_id"), (F.col("l_returnflag") == "R").alias("suppress"))
    return R.branch_suppressed(flags, spark.range(5).select(F.col("id").alias("team_id")))


@query("WITH h AS (SELECT user_id AS account_id, event_id % 3 AS host, CAST(sum(floor(value)) AS BIGINT) AS ms, count(DISTINCT event_type) AS projects, max(epoch_us(ts) // 1000) AS as_of FROM events GROUP BY ALL) SELECT account_id, CAST(sum(ms) AS BIGINT) AS ms, max(projects) AS projects, max(as_of) AS as_of FROM h GROUP BY account_id")
def team_withheld_max_sum(spark, d):
    h = read(spark, d, "events").groupBy(F.col("user_id").alias("account_id"), (F.col("event_id") % 3).alias("host")).agg(F.sum(F.floor("value")).alias("ms"), F.countDistinct("event_type").alias("projects"), F.max(S.to_millis(F.col("ts"))).alias("as_of"))
    return h.groupBy("account_id").agg(F.sum("ms").alias("ms"), F.max("projects").alias("projects"), F.max("as_of").alias("as_of"))


@query()
def model_lookup_fuzzy(spark, d):
    kind = F.col("p_size") % 4
    names = read(spark, d, "part").select(F.concat(F.when(kind == 3, "acme/eu-").otherwise("acme/"), F.lower(F.translate("p_brand", "#", "-")), F.when(kind == 0, "-mini").when(kind == 1, "-20240101").when(kind == 3, "-large").otherwise("")).alias("model"))
    keys = read(spark, d, "part").select(F.lower(F.translate("p_brand", "#", "-")).alias("key"), F.lit(0).alias("rank")).distinct()
    return P.match_models(names, keys)


@query(w(V1, ", e AS (SELECT thread_id, thread_id - thread_id % 4 AS parent_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS INTEGER) AS place, input_tokens % 20 AS usage FROM ev), m AS (SELECT c.*, coalesce(c.usage = p.usage, FALSE) AS same FROM e c LEFT JOIN e p ON p.thread_id = c.parent_id AND p.place = c.place WHERE c.thread_id <> c.parent_id), r AS (SELECT *, bool_and(same) OVER (PARTITION BY thread_id ORDER BY place) AS repeats FROM m) SELECT thread_id, parent_id, place AS \"at\", usage FROM r WHERE NOT repeats"))
def fork_replay(spark, d):
    at = F.row_number().over(W.partitionBy("thread_id").orderBy("ts", "event_id"))
    e = act_event(spark, d).select("thread_id", (F.col("thread_id") - F.col("thread_id") % 4).alias("parent_id"), at.alias("at"), (F.col("input_tokens") % 20).alias("usage"))
    return U.fork_replay(e.where("thread_id <> parent_id"), e)


@query()
def path_ancestor_ladder(spark, d):
    p = read(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.concat(F.lit("/srv/"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 25 != F.col("c_nationkey"), F.concat(F.lit("/"), F.col("c_custkey").cast("string"))).otherwise("")).alias("root_path"),
        F.when(F.col("c_custkey") % 25 == F.col("c_nationkey"), F.concat(F.lit("git@Host.example:team/"), F.col("c_nationkey").cast("string"), F.lit(".git"))).alias("git_remote"),
        F.lit(None).cast("string").alias("git_common_dir"), F.lit(False).alias("group_pinned"), F.lit(None).cast("string").alias("group_id"),
    )
    return G.ladder(p)
