"""A stream's spans are those of a batch over all its events, whatever the order and repeats."""

from __future__ import annotations

import random

from tidemark.operators.spans import spans
from tidemark.streaming.follow import follow

KINDS = "event_id long, session_id long, thread_id long, is_subagent boolean, ts long, kind string"


def test_follow(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i % 5, i % 9 + 100 * (i % 5), False, rng.randrange(10**8), "user_prompt") for i in range(300)]
    src = tmp_path / "in"
    for part in (rows[:120], rows[100:220], rows[200:], rows[:50]):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(str(src))
        q = follow(spark.readStream.schema(KINDS).parquet(str(src)), str(tmp_path / "events"), str(tmp_path / "spans"), str(tmp_path / "check"), availableNow=True)
        q.awaitTermination()
    cols = ["thread_id", "span_no", "started_at", "ended_at", "event_count", "session_id"]
    want = spans(spark.createDataFrame(rows, KINDS), keep=("session_id", "is_subagent")).select(*cols).collect()
    assert sorted(spark.read.parquet(str(tmp_path / "spans")).select(*cols).collect()) == sorted(want)
    assert spark.read.parquet(str(tmp_path / "events")).count() == 300


def test_costs_follow(spark, tmp_path):
    """Ledgers after several cycles equal those of one batch; a price that comes later empties the unpriced ledger."""
    from pyspark.sql import functions as F

    from tidemark.operators.cost import cost_ledger, unpriced_ledger
    from tidemark.plans.views import act_event, prices
    from tidemark.streaming.follow import corpus_totals, cycle

    events = act_event(spark, "/root/testdata/sf0.001").where("thread_id < 40").cache()
    at = [f"{tmp_path}/{x}" for x in ("events", "spans", "costs")]
    dollars = prices(spark)
    for k in range(3):
        cycle(events.where(f"event_id % 3 = {k} OR event_id % 7 = 0"), at[0], at[1], 21_600_000, dollars, at[2])
    for name, ledger, value in (("ledger", cost_ledger, "total_nano"), ("unpriced", unpriced_ledger, "tokens")):
        got = {(r.event_id, r[value]) for r in spark.read.parquet(f"{at[2]}/{name}").collect()}
        assert got and got == {(r.event_id, r[value]) for r in ledger(events, dollars).collect()}
    total = corpus_totals(spark.read.parquet(at[1]), spark.read.parquet(f"{at[2]}/ledger")).first()
    assert total.cost_nano == cost_ledger(events, dollars).agg(F.sum("total_nano")).first()[0] > 0
    every = spark.createDataFrame([(f"model-{i}", 0, 1.0, 1.0, 1.0, 1.0, 1.0, "USD") for i in range(4)], dollars.schema)
    named = events.withColumn("model", F.coalesce("model", F.lit("model-0")))
    cycle(named, f"{tmp_path}/e2", f"{tmp_path}/s2", 21_600_000, dollars, f"{tmp_path}/c2")
    cycle(named, f"{tmp_path}/e2", f"{tmp_path}/s2", 21_600_000, every, f"{tmp_path}/c2")
    assert spark.read.schema(unpriced_ledger(events, dollars).schema).parquet(f"{tmp_path}/c2/unpriced").count() == 0
