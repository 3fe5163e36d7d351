"""Queries that run the library's stateful parts over the driver's tables, beside the SQL of one pass over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import digests
from tidemark.plans.queries import query, w
from tidemark.plans.views import IDLE_MS, SPANS, V1, act_event, read
from tidemark.sources import catalog_build
from tidemark.sources.catalog import RATES
from tidemark.session import work_dir
from tidemark.streaming.open_spans import stream_spans
from tidemark.streaming.reader import message_events, message_lines
from tidemark.streaming.store import SessionStore

#: Micro-batches in which the lines of a log come.
SLICES = 3

_BILLED = """, line AS (SELECT *, coalesce(model, 'none') AS response FROM ev),
cut AS (SELECT *, CASE WHEN lag(response) OVER t = response THEN 0 ELSE 1 END AS fresh FROM line WINDOW t AS (PARTITION BY thread_id ORDER BY event_id)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY thread_id ORDER BY event_id) AS run_no FROM cut),
best AS (SELECT *, max(output_tokens) OVER (PARTITION BY thread_id, run_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM run)
SELECT CAST(event_id AS VARCHAR) AS native_event_id, CAST(thread_id AS VARCHAR) AS session_id, ts, CASE WHEN fresh = 1 THEN input_tokens END AS input_tokens,
  CASE WHEN fresh = 1 THEN output_tokens ELSE greatest(output_tokens - coalesce(before, 0), 0) END AS output_tokens FROM best"""


@query(w(V1, _BILLED))
def stream_equals_batch(spark, d):
    """The table's events as message logs (one file a thread) that grow in SLICES steps, read by the stateful stream: one pass bills the same."""
    e = act_event(spark, d)
    bounds = e.agg(F.min("event_id"), F.max("event_id")).first()
    slice_of = F.floor((F.col("event_id") - bounds[0]) * SLICES / (bounds[1] - bounds[0] + 1))
    usage = F.struct("input_tokens", "output_tokens")
    message = F.struct(F.coalesce("model", F.lit("none")).alias("id"), usage.alias("usage"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("event_id").cast("string").alias("uuid"), F.col("thread_id").cast("string").alias("sessionId"), F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), message.alias("message")))
    lines = e.select(F.col("thread_id").cast("string").alias("file_path"), (F.col("event_id") + 1).alias("at"), line.alias("value"), slice_of.alias("slice"))
    base = work_dir(spark, "stream")
    grown = lambda: spark.readStream.schema("file_path string, at long, value string").parquet(f"{base}/in")
    write = lambda df, n: message_events(df).write.mode("overwrite").parquet(f"{base}/out/batch={n}")  # noqa: E731  a batch that runs again replaces its own
    for k in range(SLICES):  # the stream goes on from its checkpoint
        lines.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{base}/in")
        message_lines(grown(), timers=False).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("native_event_id", "session_id", "ts", "input_tokens", "output_tokens")


@query(w(SPANS, "SELECT span_id, thread_id, session_id, started_at, ended_at, event_count FROM span"))
def store_equals_batch(spark, d):
    """The table's events in SLICES overlapping batches into a session store whose cells split; its spans are those of one batch."""
    e = act_event(spark, d)
    store = SessionStore(spark, work_dir(spark, "store"), cell_rows=2000)
    for k in range(SLICES):
        store.cycle(e.where((F.col("event_id") % SLICES == k) | (F.col("event_id") % 7 == 0)), IDLE_MS)
    return store.read("spans").select("span_id", "thread_id", "session_id", "started_at", "ended_at", "event_count")


@query(w(SPANS, "SELECT span_id, thread_id, session_id, span_no, started_at, ended_at, event_count, attended FROM span"))
def open_spans_equal_batch(spark, d):
    """The table's events in SLICES steps of time, each step shuffled, into spans that a stream keeps open; one event far on closes them all."""
    e = act_event(spark, d).select("event_id", "session_id", "thread_id", "is_subagent", "ts", "kind")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    base, step = work_dir(spark, "spans"), (high - low) // SLICES + 1
    end = spark.createDataFrame([(-1, -1, -1, False, high + 100 * IDLE_MS, "system")], e.schema)  # of a thread of its own
    for k in range(SLICES + 1):  # the stream goes on from its checkpoint
        part = e.where(F.floor((F.col("ts") - low) / step) == k).repartition(F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id")) if k < SLICES else end
        part.write.mode("append").parquet(f"{base}/in")
        grown = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        stream_spans(grown, "1 hour", IDLE_MS).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("span_id", F.col("thread_id").cast("long").alias("thread_id"), F.col("session_id").cast("long").alias("session_id"), "span_no", "started_at", "ended_at", "event_count", "attended")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 3 THEN 'removed' WHEN o_orderkey % 997 = 5 THEN 'added' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 1009 = 3 AND o_orderkey % 997 <> 5 OR o_orderkey % 997 = 5 AND o_orderkey % 1009 <> 3 OR o_orderkey % 499 = 7 AND o_orderkey % 1009 <> 3 AND o_orderkey % 997 <> 5")
def store_difference(spark, d):
    """Orders against a copy of which some rows were changed, removed and added, by trees of digests."""
    orders, base, k = read(spark, d, "orders"), work_dir(spark, "digests"), F.col("o_orderkey")
    a = digests.write(orders.where(k % 997 != 5), ["o_orderkey"], f"{base}/a", 3)
    b = digests.write(orders.where(k % 1009 != 3).withColumn("o_totalprice", F.when(k % 499 == 7, 0.0).otherwise(F.col("o_totalprice"))), ["o_orderkey"], f"{base}/b", 3)
    return digests.difference(a, b)


_PERIODS = """WITH prev AS (SELECT p_brand AS model, CAST(p_size AS BIGINT) * 1000 AS effective_from, max(p_retailprice) AS input_mtok FROM part GROUP BY ALL),
last AS (SELECT model, max(effective_from) AS since, arg_max(input_mtok, effective_from) AS rate, CAST(right(model, 1) AS INTEGER) AS k FROM prev GROUP BY model),
now AS (SELECT model, CASE WHEN k % 3 = 1 THEN rate + 1 ELSE rate END AS input_mtok, CASE WHEN k % 3 = 1 THEN 1000000 WHEN k = 5 THEN 0 ELSE since END AS effective_from FROM last)"""


def _periods(spark, d):
    at, digit = F.col("p_size").cast("long") * 1000, F.right(F.col("model"), F.lit(1)).cast("int")
    none = [F.lit(None).cast("double").alias(r) for r in RATES[1:]]
    previous = read(spark, d, "part").groupBy(F.col("p_brand").alias("model"), at.alias("effective_from")).agg(F.max("p_retailprice").alias("input_mtok")).select("model", F.lit("p").alias("provider"), "effective_from", "input_mtok", *none)
    last = previous.groupBy("model").agg(F.max_by("input_mtok", "effective_from").alias("rate"))
    plain = [F.lit(x).cast(t).alias(c) for c, x, t in (("source", "s", "string"), ("upstream", "u", "string"), ("provider", "p", "string"), ("trust", None, "string"), ("tiered", False, "boolean"))]
    built = last.select("model", *plain, F.when(digit % 3 == 1, F.col("rate") + 1).otherwise(F.col("rate")).alias("input_mtok"), *none)
    return previous, built, [r.model for r in last.where(digit == 5).select("model").collect()]


@query(f"{_PERIODS} SELECT p.model, p.effective_from, p.input_mtok FROM prev p JOIN now USING (model) WHERE p.effective_from < now.effective_from UNION ALL SELECT model, effective_from, input_mtok FROM now")
def catalog_history(spark, d):
    """Brands as models of a catalogue that is built again: unchanged rates keep their date, changed ones begin a period, rebased ones lose theirs."""
    previous, built, rebased = _periods(spark, d)
    return catalog_build.with_history(built, previous, 1_000_000, tuple(rebased)).select("model", "effective_from", "input_mtok")


@query(f"{_PERIODS} SELECT model, rate AS before, input_mtok AS after FROM now JOIN last USING (model) WHERE abs(input_mtok - rate) / abs(rate) > 0.0005")
def catalog_changes(spark, d):
    previous, built, _ = _periods(spark, d)
    return catalog_build.changes(previous, built, 0.0005).select("model", F.col("before.input_mtok").alias("before"), F.col("after.input_mtok").alias("after"))
