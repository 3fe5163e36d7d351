"""Log, store and catalogue readers on files written here."""

from __future__ import annotations

import json
import sqlite3

from tidemark.sources import catalog, message_log, store


def test_message_log(spark, tmp_path):
    line = lambda **x: json.dumps({"sessionId": "s", "timestamp": "2026-01-01T00:00:00.000Z", **x})
    text = [
        line(type="user", uuid="u1", message={"role": "user", "content": "hi"}),
        line(type="assistant", uuid="u2", message={"id": "m", "model": "<synthetic>", "content": [{"type": "text"}, {"type": "tool_use", "id": "t1", "name": "A"}, {"type": "tool_use", "id": "t2", "name": "B"}], "usage": {"input_tokens": 7}}),
        line(type="user", uuid="u3", agentId="a", message={"content": [{"type": "tool_result", "tool_use_id": "t1"}]}),
        line(type="hook", uuid="u4"), "", "[1]", "nonsense", '{"type":"user"}', '{"timestamp":"2026-01-01T00:00:00Z","type":"other"}', line(type="user")[:-9],
    ]
    (tmp_path / "stem.jsonl").write_text("\n".join(text))
    got = {r.native_event_id: r for r in message_log.events(message_log.lines(spark, [str(tmp_path)])).collect()}
    assert len(got) == 6
    assert [got[k].kind for k in ("u1", "u2", "u2#1", "u3", "u4")] == ["user_prompt", "tool_use", "tool_use", "tool_result", "system"]
    assert got["u2"].input_tokens == 7 and got["u2#1"].input_tokens is None and got["u2#1"].tool_name == "B" and got["u2"].model is None
    assert (got["u3"].thread_id, got["u3"].parent_thread_id, got["u3"].is_subagent) == ("a", "s", True)
    bare = next(r for k, r in got.items() if len(k) == 32)
    assert bare.session_id == "stem" and bare.kind == "other"


def test_store(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.executescript("CREATE TABLE session(id, parent_id, directory); CREATE TABLE message(id, session_id, time_created, data); CREATE TABLE part(id, session_id, time_created, data)")
    con.executemany("INSERT INTO session VALUES (?, ?, '/x')", [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "f"), ("f", "e")])
    con.execute("INSERT INTO message VALUES ('m', 'a', 5, ?)", (json.dumps({"role": "assistant", "modelID": "x", "time": {"created": 5, "completed": 9}, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 0}}}),))
    part = lambda kind="tool", status="completed", **time: json.dumps({"type": kind, "tool": "bash", "callID": "c", "state": {"status": status, "time": time}})
    con.executemany("INSERT INTO part VALUES (?, 'a', 5, ?)", [("p1", part(start=6, end=8)), ("p2", part(start=9, end=7)), ("p3", part(status="running", start=9, end=9)), ("p4", part(end=9)), ("p5", part("text", start=1, end=2)), ("p6", part(start=3)), ("p7", "junk")])
    con.commit()
    con.close()
    (tmp_path / "b.db").write_bytes(b"no store")
    roots = {r.id: r.root_id for r in store.with_root(store.table(spark, [str(tmp_path)], "session")).collect()}
    assert {k: roots[k] for k in "abcd"} == {"a": "a", "b": "a", "c": "a", "d": "d"} and set(roots) == set("abcdef")
    tools = {(r.native_event_id, r.ts, r.kind, r.tool_name, r.tool_use_id) for r in store.tool_events(store.table(spark, [str(tmp_path)], "part")).collect()}
    assert tools == {(i, t, k, "bash", "c") for i, t, k in [("p1", 6, "tool_use"), ("p1:done", 8, "tool_result"), ("p2", 9, "tool_use"), ("p2:done", 9, "tool_result"), ("p3", 9, "tool_use"), ("p6", 3, "tool_use")]}
    rows = {r.native_event_id: r for r in store.message_events(store.table(spark, [str(tmp_path)], "message")).collect()}
    assert rows["m"].output_tokens == 5 and rows["m"].ts == 5 and rows["m:done"].ts == 9 and rows["m:done"].output_tokens is None


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"models": {"m": {"provider": "p", "clauses": [{"start_date": "2026-01-01", "input_mtok": 3.0}, {"input_mtok": 2.0}]}}}))
    assert sorted((r.model, r.effective_from, r.input_mtok, r.output_mtok) for r in catalog.rates(spark, str(tmp_path / "c.json")).collect()) == [("m", 0, 2.0, None), ("m", 1767225600000, 3.0, None)]
    (tmp_path / "bad.json").write_text("[]")
    assert catalog.rates(spark, str(tmp_path / "bad.json")).count() == 0


def test_store_with_a_log(spark, tmp_path):
    """Rows in the main file, in the write-ahead log alone, and in both; frames that were not committed, or are damaged, count for nothing."""
    import shutil
    import sqlite3

    from tidemark.sources import store

    con = sqlite3.connect(tmp_path / "live.db", isolation_level=None)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("PRAGMA wal_autocheckpoint=0")
    for name, columns in store.TABLES.items():
        con.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
    put = lambda a, b: con.executemany("INSERT INTO session VALUES (?, ?, ?)", [(f"s{i}", None, "x" * 300) for i in range(a, b)])
    keep = lambda name: [shutil.copy(tmp_path / f"live.db{e}", tmp_path / f"{name}.db{e}") for e in ("", "-wal")]
    ids = lambda name: sorted(int(r.id[1:]) for r in store.table(spark, [str(tmp_path / f"{name}.db")], "session").collect())
    put(0, 5)
    keep("log_only")
    con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    keep("main_only")
    put(5, 60)
    con.execute("UPDATE session SET id = 's1000' WHERE id = 's3'")
    keep("both")
    log = (tmp_path / "both.db-wal").read_bytes()
    (tmp_path / "cut.db").write_bytes((tmp_path / "both.db").read_bytes())
    (tmp_path / "cut.db-wal").write_bytes(log[: len(log) - 10])
    (tmp_path / "worse.db").write_bytes((tmp_path / "both.db").read_bytes())
    (tmp_path / "worse.db-wal").write_bytes(log[:60] + b"?" + log[61:])
    con.execute("BEGIN")
    put(60, 4000)  # spills into the log before its end
    keep("open")
    con.execute("COMMIT")
    con.close()
    assert (tmp_path / "main_only.db").stat().st_size > 0 and (tmp_path / "log_only.db").stat().st_size <= 4096
    whole = sorted([*(i for i in range(60) if i != 3), 1000])
    assert ids("log_only") == ids("main_only") == list(range(5)) and ids("both") == ids("open") == whole
    assert ids("cut") == sorted(range(60)) and ids("worse") == list(range(5))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.db").write_bytes(b"not a store at all" * 100)
    sqlite3.connect(tmp_path / "bad" / "b.db").executescript("CREATE TABLE other (x)")
    shutil.copy(tmp_path / "both.db", tmp_path / "bad" / "c.db")
    shutil.copy(tmp_path / "both.db-wal", tmp_path / "bad" / "c.db-wal")
    told = {r.path.rsplit("/", 1)[1]: r.error for r in store.errors(spark, [str(tmp_path / "bad")]).collect()}
    assert set(told) == {"a.db", "b.db"} and "no such table" in told["b.db"]
    assert store.table(spark, [str(tmp_path / "bad")], "session").count() == len(whole)
