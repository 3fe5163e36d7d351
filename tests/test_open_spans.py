"""Spans in a stream's state: late and shuffled events give the spans of one batch, and the state holds what the watermark has not passed."""

from __future__ import annotations

import json
import random

from tidemark.operators.spans import spans
from tidemark.streaming.open_spans import add, close, new, stream_spans

IDLE, LATE = 300_000, 7_200_000
KINDS = "event_id long, session_id long, thread_id long, is_subagent boolean, ts long, kind string"


def test_any_order_gives_the_same_spans():
    rng = random.Random(2)
    events = sorted((rng.randrange(40 * IDLE), str(i), rng.choice(("user_prompt", "assistant", "system"))) for i in range(60))
    whole = new()
    add(whole, events, IDLE)
    want = close(whole, 10**12, IDLE)
    assert len(want) > 5 and [w[0] for w in want] == list(range(len(want))) and sum(w[3] for w in want) == 60
    for _ in range(20):
        rng.shuffle(events)
        state, at = new(), 0
        while at < 60:
            n = rng.randrange(1, 9)
            add(state, events[at : at + n], IDLE)
            state, at = json.loads(json.dumps(state)), at + n
        assert close(state, 10**12, IDLE) == want and state["open"] == []


def test_spans_close_behind_the_watermark():
    state = new()
    add(state, [(0, "a", "system")], IDLE)
    assert close(state, 10**9, IDLE) == []  # a thread of one event
    add(state, [(10 * IDLE, "b", "assistant"), (12 * IDLE, "c", "assistant")], IDLE)
    assert close(state, 10 * IDLE, IDLE) == [(0, 0, 0, 1, None)]
    add(state, [(11 * IDLE, "d", "user_prompt")], IDLE)  # joins the two that are open
    assert close(state, 13 * IDLE, IDLE) == [] and close(state, 13 * IDLE + 1, IDLE) == [(1, 10 * IDLE, 12 * IDLE, 3, "assistant")]


def test_a_stream_of_late_events(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, (t := rng.randrange(6)) // 2, t, t % 2 == 1, rng.randrange(10**8), rng.choice(("user_prompt", "assistant", "system"))) for i in range(500)]
    come = sorted(rows, key=lambda r: r[4] + rng.randrange(LATE // 2))
    come += [(900 + i, 9, 90 + i, False, 3 * 10**8 + i, "system") for i in range(2)]  # threads of one event, far on: the watermark passes all others
    src = tmp_path / "in"
    for at in range(0, len(come), 101):
        spark.createDataFrame(come[at : at + 101], KINDS).coalesce(1).write.mode("append").parquet(str(src))
        out = stream_spans(spark.readStream.schema(KINDS).parquet(str(src)), f"{LATE} milliseconds", IDLE)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(300)
    columns = ["thread_id", "session_id", "is_subagent", "span_no", "started_at", "ended_at", "event_count", "attended", "ms"]
    plain = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == plain(spans(spark.createDataFrame(rows, KINDS), IDLE, ("session_id", "is_subagent")))
