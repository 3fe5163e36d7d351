"""The driver's tables seen as an activity log (act_event) and as ready-made spans (iv_span), in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import to_millis
from tidemark.operators.spans import spans
from tidemark.plans.endpoints import Corpus

IDLE_MS = 21_600_000

V1 = """
raw AS (SELECT *, user_id // 4 AS sid, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
ev0 AS (SELECT event_id, user_id AS thread_id, sid AS session_id, user_id % 4 <> 0 AS is_subagent, epoch_us(ts) // 1000 AS ts,
  CASE event_type WHEN 'signup' THEN 'user_prompt' WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'tool_use' WHEN 'purchase' THEN 'tool_result' ELSE 'system' END AS kind,
  CASE sid % 3 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' ELSE 'src_c' END AS source,
  CASE WHEN sid % 7 = 6 THEN NULL ELSE sid % 7 END AS project_id,
  CASE WHEN k % 5 = 0 THEN NULL ELSE concat('model-', k % 4) END AS model,
  k * 10 AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, CAST(floor(value * 100) AS BIGINT) AS cache_read_tokens,
  CASE WHEN k % 3 = 0 THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS cache_write_tokens,
  CASE k % 6 WHEN 3 THEN NULL WHEN 0 THEN CAST(floor(value * 10) AS BIGINT) // 2 ELSE 0 END AS cache_write_1h_tokens FROM raw),
ev AS (SELECT *, CASE WHEN project_id = 5 THEN NULL ELSE project_id % 3 END AS group_id FROM ev0)"""

SPANS = f"""{V1},
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > {IDLE_MS} THEN 1 ELSE 0 END AS brk, count(*) OVER (PARTITION BY thread_id) AS n FROM ev WINDOW w AS (PARTITION BY thread_id ORDER BY ts, event_id)),
numbered AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS BIGINT) AS span_no FROM gaps WHERE n >= 2),
span0 AS (SELECT thread_id, span_no, any_value(session_id) AS session_id, any_value(source) AS source, any_value(project_id) AS project_id, any_value(group_id) AS group_id, any_value(is_subagent) AS is_subagent,
  min(ts) AS started_at, max(ts) AS ended_at, count(*) AS event_count, arg_min(kind, (ts, event_id)) FILTER (WHERE kind <> 'system') AS fk FROM numbered GROUP BY thread_id, span_no),
span AS (SELECT *, ended_at - started_at AS ms, CASE WHEN is_subagent THEN FALSE WHEN fk = 'user_prompt' THEN TRUE WHEN span_no = 0 THEN NULL ELSE FALSE END AS attended,
  substr(sha256(concat(CAST(thread_id AS VARCHAR), chr(31), CAST(started_at AS VARCHAR))), 1, 32) AS span_id FROM span0)"""

V2 = """
iv AS (SELECT o_orderkey AS thread_id, any_value(o_custkey) AS session_id, any_value(o_orderpriority) AS source, any_value(o_orderstatus) <> 'O' AS is_subagent,
  any_value(CAST(c_nationkey AS BIGINT)) AS project_id, any_value(CAST(n_regionkey AS BIGINT)) AS group_id,
  min(epoch_us(l_shipdate) // 1000) AS started_at, max(epoch_us(l_shipdate) // 1000) AS ended_at, count(*) AS event_count
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY o_orderkey),
iv_span AS (SELECT *, ended_at - started_at AS ms, thread_id AS span_id FROM iv)"""

#: A small rate table with two dates, a missing component and a missing model (model-3).
RATES = (
    ("model-0", 0, 15.0, 75.0, 1.5, 18.75, 30.0, "USD"),
    ("model-0", 1705276800000, 12.5, 60.0, 1.25, 15.0, 25.0, "USD"),
    ("model-1", 0, 3.0, 15.0, 0.3, None, None, "USD"),
    ("model-2", 1704844800000, 1.1, 4.4, 0.275, 1.375, 2.2, "EUR"),
)
_NUM = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)"
PRICES = "price(model, effective_from, r1, r2, r3, r4, r5, currency) AS (VALUES " + ", ".join(f"('{m}', CAST({t} AS BIGINT), {', '.join(map(_NUM, r))}, '{c}')" for m, t, *r, c in RATES) + ")"

_COST = lambda t, r: f"CAST(round_even({t} * {r} * 1e9::DOUBLE / 1e6::DOUBLE, 0) AS BIGINT)"
COST = f"""{V1}, {PRICES},
carried AS (SELECT *, last_value(model IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cm, model IS NULL AS attributed FROM ev),
tok AS (SELECT *, greatest(input_tokens, 0) AS t1, greatest(output_tokens, 0) AS t2, greatest(cache_read_tokens, 0) AS t3,
  CASE WHEN cache_write_1h_tokens IS NULL THEN 0 ELSE greatest(0, least(cache_write_1h_tokens, cache_write_tokens)) END AS t5, cache_write_1h_tokens IS NULL AND cache_write_tokens > 0 AS assumed FROM carried),
tok2 AS (SELECT *, cache_write_tokens - t5 AS t4 FROM tok),
priced AS (SELECT t.*, p.effective_from AS price_from, p.currency, {', '.join(f"CASE WHEN t{i} > 0 THEN {_COST(f't{i}', f'r{i}')} END AS n{i}" for i in range(1, 6))}
  FROM tok2 t LEFT JOIN price p ON p.model = t.cm AND p.effective_from <= t.ts AND NOT EXISTS (SELECT 1 FROM price q WHERE q.model = p.model AND q.effective_from <= t.ts AND q.effective_from > p.effective_from)
  WHERE t1 > 0 OR t2 > 0 OR t3 > 0 OR t4 > 0 OR t5 > 0),
ledger AS (SELECT event_id, thread_id, session_id, source, project_id, ts, cm AS model, attributed, price_from, currency, {', '.join(f'coalesce(n{i}, 0) AS n{i}' for i in range(1, 6))},
  {' + '.join(f'coalesce(n{i}, 0)' for i in range(1, 6))} AS total FROM priced WHERE {' OR '.join(f'n{i} IS NOT NULL' for i in range(1, 6))}),
unpriced AS (SELECT * FROM (SELECT event_id, cm AS model, attributed, source, {' + '.join(f'CASE WHEN t{i} > 0 AND n{i} IS NULL THEN t{i} ELSE 0 END' for i in range(1, 6))} AS tokens,
  CASE WHEN cm IS NULL THEN 'no_model' WHEN price_from IS NULL THEN 'no_rate' ELSE 'no_component' END AS reason FROM priced) WHERE tokens > 0)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def act_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, sid = F.get_json_object("props", "$.k").cast("long"), F.expr("user_id DIV 4")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", to_millis(F.col("ts")).alias("ts"), k.alias("k"), sid.alias("session_id"))
    kind = F.when(F.col("event_type") == "signup", "user_prompt").when(F.col("event_type") == "view", "assistant").when(F.col("event_type") == "click", "tool_use").when(F.col("event_type") == "purchase", "tool_result").otherwise("system")
    source = F.when(F.col("session_id") % 3 == 0, "src_a").when(F.col("session_id") % 3 == 1, "src_b").otherwise("src_c")
    project = F.when(F.col("session_id") % 7 != 6, F.col("session_id") % 7)
    write = F.floor(F.col("value") * 10)
    return e.select(
        "event_id", F.col("user_id").alias("thread_id"), "session_id", (F.col("user_id") % 4 != 0).alias("is_subagent"), "ts", kind.alias("kind"), source.alias("source"),
        project.alias("project_id"), F.when(project != 5, project % 3).alias("group_id"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("model-"), (F.col("k") % 4).cast("string"))).alias("model"),
        (F.col("k") * 10).alias("input_tokens"), F.floor("value").alias("output_tokens"), F.floor(F.col("value") * 100).alias("cache_read_tokens"),
        F.when(F.col("k") % 3 == 0, write).otherwise(0).alias("cache_write_tokens"),
        F.when(F.col("k") % 6 == 3, F.lit(None).cast("long")).when(F.col("k") % 6 == 0, F.floor(write / 2)).otherwise(0).alias("cache_write_1h_tokens"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The event view with agents, projects of the nation table and groups of the region table."""
    agent = F.when(F.col("is_subagent"), F.when(F.col("source") == "src_b", "src_b agents").otherwise(F.concat(F.lit("agent-"), (F.col("thread_id") % 5).cast("string"))))
    key = F.col("n_nationkey").cast("long")
    projects = read(spark, sf_dir, "nation").select(key.alias("project_id"), F.col("n_name").alias("name"), F.concat(F.lit("/srv/"), F.lower("n_name")).alias("root_path"), F.when(key != 5, key % 3).alias("group_id"), (key % 4 == 0).alias("group_pinned"), F.when(key % 5 != 0, key % 2 == 0).alias("path_exists"))
    groups = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("group_id"), F.col("r_name").alias("name"), F.lit("git_remote").alias("origin"))
    return Corpus(act_event(spark, sf_dir).withColumn("agent_name", agent), prices(spark), projects, groups, IDLE_MS)


def act_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(act_event(spark, sf_dir), IDLE_MS)


def iv_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"), F.count("*").alias("event_count"))
    joined = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    a, b = to_millis(F.col("a")), to_millis(F.col("b"))
    return joined.select(F.col("o_orderkey").alias("thread_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") != "O").alias("is_subagent"), F.col("c_nationkey").cast("long").alias("project_id"), F.col("n_regionkey").cast("long").alias("group_id"), a.alias("started_at"), b.alias("ended_at"), "event_count", (b - a).alias("ms"), F.col("o_orderkey").alias("span_id"))


def prices(spark: SparkSession) -> DataFrame:
    kinds = "model string, effective_from long, input_mtok double, output_mtok double, cache_read_mtok double, cache_write_mtok double, cache_write_1h_mtok double, currency string"
    return spark.createDataFrame(list(RATES), kinds)
