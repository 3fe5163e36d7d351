"""What only larger tables show: sums beyond 64 bits, ties, keys that many rows share."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import needles, parents
from tidemark.operators.pricing import history
from tidemark.operators.rollups import digest
from tidemark.plans import stream_queries
from tidemark.plans.queries import QUERIES
from tidemark.streaming.store import SessionStore


def test_a_digest_beyond_64_bits(spark):
    """70,000 hashes of 48 bits add up to more than a long holds."""
    want = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(70_000))
    assert want >= 2**63
    got = digest(spark.range(70_000), ["id"]).first()
    assert (got.n, got.digest) == (70_000, (want + 2**63) % 2**64 - 2**63)
    assert tuple(digest(spark.range(0), ["id"]).first()) == (0, 0)


def test_history_of_snapshots_at_one_time(spark):
    """Their order is that of the tie, within a bucket and at its end, whatever order they come in."""
    rows = [("a", t, n, v) for n, (t, v) in enumerate([(1, 5), (1, 6), (1, 5), (8, 5), (9, 4), (9, 7), (9, 3), (12, 3), (12, 8)])]
    want = [(1, 1, 5), (1, 1, 6), (1, 9, 5), (9, 9, 4), (9, 9, 7), (9, 12, 3), (12, None, 8)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = history(spark.createDataFrame(rows, "k string, t long, n long, v long").repartition(3, F.col("n")), "k", "t", "v", 10, tie="n")
        assert sorted((tuple(r)[1:] for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_null_key_is_joined(spark, monkeypatch):
    """Threads without a parent, and those whose chain has ended, take no part in the left side of a join: they would all meet in one task."""
    joined, real = [], type(spark.range(1)).join

    def join(self, other, on=None, how=None):
        if isinstance(on, list) and "id" not in on:
            joined.append(self.where(F.col(on[-1]).isNull()).count())
        return real(self, other, on, how)

    rows = [(i, i // 3 if i % 3 else None) for i in range(1, 300)] + [(1000, 1001), (1001, 1000), (1002, 5000)]
    want = {}
    for i, p in rows[:-3]:
        want[i] = want[p] + 1 if p in want else 0
    threads = spark.createDataFrame(rows, "id long, parent_id long")
    monkeypatch.setattr(type(threads), "join", join)
    assert {r.id: r.depth for r in parents.depths(threads).collect()} == {**want, 1000: None, 1001: None, 1002: 0}
    lane = threads.where("id < 1000").select("*", F.lit(False).alias("is_subagent"), F.lit(1).alias("session_id"))
    spans = lane.select(F.col("id").alias("thread_id"), F.col("id").alias("started_at"))
    before = len(joined)
    assert {r.id: r.depth for r in parents.lanes(lane, spans).collect()} == want
    assert before >= 3 and len(joined) > before and set(joined) == {0}


def test_texts_are_read_once_for_any_number_of_needles(spark):
    """Needles of many lengths, other alphabets, words at the edges of texts and slices, and a bitmap that is full, against plain search."""
    rng = random.Random(4)
    some = lambda a, b: "".join(rng.choice("aBc1-/é日") for _ in range(rng.randrange(a, b)))
    texts = [("f", some(0, 60)) for _ in range(400)] + [("g", ""), ("g", "日本"), ("g", some(90, 100))]
    held = [(x[i : i + n].lower(), x[i : i + n].lower(), "path", False) for _, x in rng.sample(texts, 60) if len(x) > 12 for i, n in [(rng.randrange(9), rng.randrange(3, 12))]]
    words = [(w, w, "name", True) for w in ("a", "abc", "1", "bca1", "zz")]
    wanted = sorted({*held, *words, ("nowhere/1", "nowhere/1", "path", False)})
    tokens = lambda x: re.findall("[a-z0-9]+", x.lower())
    want = {(f, x, s, k) for f, x in texts for low, s, k, word in wanted if (low in tokens(x) if word else low in x.lower())}
    df = spark.createDataFrame(texts, "field string, value string").repartition(3)
    kinds = "low string, secret string, kind string, word boolean"
    for most in (1 << 20, 4096):
        got = needles.found(df, spark.createDataFrame(wanted, kinds), most)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want and len(want) > 100
    many = [(f"p{i:06d}/x", f"p{i:06d}/x", "path", False) for i in range(150_000)]  # 40 automata of the former 256 KB
    plan = needles.found(df, spark.createDataFrame([*many, *wanted], kinds), 1 << 18)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert set(map(tuple, plan.collect())) == want


def test_a_store_has_no_file_for_each_cell(spark, tmp_path):
    store = SessionStore(spark, f"file://{tmp_path}/store", cell_rows=10)
    events = spark.range(300).selectExpr("id event_id", "id % 60 session_id", "id % 60 thread_id", "false is_subagent", "id * 1000 ts", "'user_prompt' kind")
    store.cycle(events.where("event_id < 200"))
    store.cycle(events)
    assert store.directory(store.manifest()).count() > 20
    assert all(len(list(t.glob("*.parquet"))) <= 4 for t in tmp_path.glob("store/data/*/*"))  # the session's partitions
    assert sorted(r.event_id for r in store.read("events").collect()) == list(range(300)) and store.read("events", 1).count() == 200


@pytest.mark.parametrize("name", ["stream_equals_batch", "open_spans_equal_batch"])
def test_no_step_of_a_stream_is_one_task(spark, tmp_path, monkeypatch, name):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 6").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(stream_queries, "work_dir", lambda s, kind: f"file://{tmp_path}/{kind}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("*/in/*.parquet"))) >= 3 * stream_queries.SLICES
