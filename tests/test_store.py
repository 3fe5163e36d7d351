"""The session store: what it holds is what one batch over all events gives, whatever the batches, splits, crashes and rival writers."""

from __future__ import annotations

import random


from tidemark.operators.cost import cost_ledger, unpriced_ledger
from tidemark.operators.spans import spans
from tidemark.plans.views import act_event, prices
from tidemark.streaming.store import SessionStore, follow_store

IDLE = 21_600_000
KINDS = "event_id long, session_id long, thread_id long, is_subagent boolean, ts long, kind string"


def _rows(df, columns) -> list:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def _some(n: int, sessions: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, (s := rng.randrange(sessions)), 10 * s + rng.randrange(3), False, rng.randrange(10**8), "user_prompt") for i in range(n)]


def test_cycles_equal_one_batch(spark, tmp_path):
    """With small cells that split, repeats, late events, and prices."""
    events = act_event(spark, "/root/testdata/sf0.001").cache()
    dollars = prices(spark)
    store = SessionStore(spark, f"file://{tmp_path}/store", cell_rows=120)
    for k in range(3):
        assert store.cycle(events.where(f"event_id % 3 = {k} OR event_id % 7 = 0"), IDLE, dollars) == k + 1
    assert _rows(store.read("events"), events.columns) == _rows(events, events.columns)
    for name, want in (("spans", spans(events, IDLE)), ("ledger", cost_ledger(events, dollars)), ("unpriced", unpriced_ledger(events, dollars))):
        assert _rows(store.read(name), want.columns) == _rows(want, want.columns), name
    cells = store.directory(store.manifest()).collect()
    assert sum(r.rows for r in cells) == events.count() and all(r.rows <= 120 or r.sessions == 1 or r.depth > 3 for r in cells) and len(cells) >= 4
    assert sum(2.0**-r.depth for r in cells) == 1  # every hash has one cell
    old = store.read("events", 1)
    assert old.count() == events.where("event_id % 3 = 0 OR event_id % 7 = 0").count()
    assert store.vacuum() > 0 and _rows(store.read("spans"), ["span_id"]) == _rows(spans(events, IDLE), ["span_id"])


def test_one_session_rewrites_one_cell(spark, tmp_path):
    rows = _some(600, 40)
    store = SessionStore(spark, f"file://{tmp_path}/store", cell_rows=60)
    store.cycle(spark.createDataFrame(rows, KINDS))
    store.cycle(spark.createDataFrame(rows[:5], KINDS))  # cells that were too large at first are split as they are touched
    before = {(r.depth, r.prefix): r.folder for r in store.directory(store.manifest()).collect()}
    assert len(before) >= 8
    one = (9999, rows[7][1], rows[7][2], False, 5, "user_prompt")
    version = store.cycle(spark.createDataFrame([one], KINDS))
    after = {(r.depth, r.prefix): r.folder for r in store.directory(store.manifest()).collect()}
    gone = [c for c in before if after.get(c) != before[c]]
    assert len(gone) == 1 and len(store.changes(version - 1)[0]["changed"]) <= 4
    want = spans(spark.createDataFrame([*rows, one], KINDS), keep=("session_id", "is_subagent"))
    assert _rows(store.read("spans"), want.columns) == _rows(want, want.columns)


def test_a_crash_leaves_the_old_state_or_the_new(spark, tmp_path, monkeypatch):
    """The cycle dies before each of its writes in turn, and before and after the version's."""
    rows = _some(120, 6)
    dollars = prices(spark)
    kind = f"{KINDS}, source string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, cache_write_1h_tokens long"
    full = [(*r, "s", "model-0", 5, 5, 0, 0, 0) for r in rows]
    first, second = spark.createDataFrame(full[:80], kind), spark.createDataFrame(full[60:], kind)
    columns = {"events": ["event_id"], "spans": ["span_id", "event_count"], "ledger": ["event_id", "total_nano"]}

    class Died(Exception):
        pass

    store = SessionStore(spark, f"file://{tmp_path}/store")
    store.cycle(first, IDLE, dollars, number=0)
    state = lambda: {t: _rows(store.read(t), c) for t, c in columns.items()}
    old, real, steps = state(), SessionStore._write, [0]
    for dies_at in range(20):
        count = [0]

        def write(self, *a, **k):
            if count[0] == dies_at:
                raise Died
            count[0] += 1
            return real(self, *a, **k)

        monkeypatch.setattr(SessionStore, "_write", write)
        try:
            store.cycle(second, IDLE, dollars, number=1)
            steps[0] = dies_at
            break
        except Died:
            assert state() == old and store.version() == 1
    monkeypatch.undo()
    assert steps[0] >= 5 and store.version() == 2
    new = state()
    assert [r[0] for r in new["events"]] == sorted((r[0] for r in rows), key=lambda x: repr((x,))) and new != old
    assert store.cycle(second, IDLE, dollars, number=1) == 2 and state() == new  # the batch again: already in


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """A rival commits while a cycle runs: its version is taken, and the cycle goes on top of it."""
    rows = _some(90, 5)
    a, b = (spark.createDataFrame(x, KINDS) for x in (rows[:50], rows[40:]))
    store, rival = (SessionStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    real, done = SessionStore._commit, []

    def commit(self, manifest):
        if self is store and not done:
            done.append(rival.cycle(b))
        return real(self, manifest)

    monkeypatch.setattr(SessionStore, "_commit", commit)
    assert store.cycle(a) == 2 and done == [1]
    assert [r[0] for r in _rows(store.read("events").orderBy("event_id"), ["event_id"])] == sorted(range(90), key=lambda x: repr((x,)))
    assert [c["version"] for c in store.changes()] == [1, 2]


def test_a_stream_into_the_store(spark, tmp_path):
    rows, src, told = _some(300, 9), tmp_path / "in", []
    store = SessionStore(spark, f"file://{tmp_path}/store", cell_rows=100)
    for part in (rows[:120], rows[100:], rows[:50]):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(str(src))
        follow_store(spark.readStream.schema(KINDS).parquet(str(src)), store, str(tmp_path / "check"), then=told.append, availableNow=True).awaitTermination(300)
    want = spans(spark.createDataFrame(rows, KINDS), keep=("session_id", "is_subagent"))
    assert told == [1, 2, 3] and _rows(store.read("spans"), want.columns) == _rows(want, want.columns)
    assert store.read("ledger") is None
