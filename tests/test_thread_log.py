"""The thread-log reader on files written here."""

from __future__ import annotations

import json

from tidemark.sources import thread_log


def _write(path, records, tail=""):
    path.write_text("".join(json.dumps({"timestamp": f"2026-01-01T00:00:{i:02d}.000Z", "ordinal": i, **r}) + "\n" for i, r in enumerate(records)) + tail)


def _block(i, o, cached=0):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": cached}


def _report(last, total):
    return {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": last, "total_token_usage": total}}}


def _record(rid, usage, thread=None):
    return {"type": "token_usage_record", "payload": {"response_id": rid, "usage": usage, "thread_token_usage": thread}}


def _compacted(rid):
    return {"type": "compacted", "payload": {"compaction_response_id": rid}}


def _billed(spark, tmp_path, records):
    _write(tmp_path / "t.jsonl", records)
    rows = thread_log.events(thread_log.lines(spark, [str(tmp_path)])).orderBy("line").collect()
    return [r.output_tokens for r in rows]


def test_events(spark, tmp_path):
    meta = {"id": "t", "session_id": "s", "parent_thread_id": "r", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "r"}}}, "agent_nickname": "n", "cwd": "/a", "git": {"branch": "main"}}
    call = {"type": "function_call", "name": "sh", "call_id": "c"}
    records = [
        {"type": "turn_context", "payload": {"model": "m", "cwd": "/b"}}, {"type": "session_meta", "payload": meta}, {"type": "session_meta", "payload": {"id": "other"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user"}}, {"type": "response_item", "payload": {"type": "message", "role": "developer"}},
        {"type": "response_item", "payload": call}, {"type": "response_item", "payload": {"type": "web_search_call"}}, {"type": "event_msg", "payload": {"type": "unseen"}},
        {"type": "world_state", "payload": "text"}, {"type": "response_item", "ordinal": None, "payload": {"type": "reasoning"}},
    ]
    _write(tmp_path / "a.jsonl", records, "\n[1]\nnonsense\n" + '{"type":"turn_context"}\n{"timestamp":"2026-01-0')
    _write(tmp_path / "root.jsonl", [{"type": "session_meta", "payload": {"id": "r", "source": "vscode-subagent"}}])
    rows = thread_log.events(thread_log.lines(spark, [str(tmp_path)])).orderBy("thread_id", "line").collect()
    root, own = rows[0], rows[1:]
    assert (root.thread_id, root.session_id, root.is_subagent, root.replayed_from) == ("r", "r", False, None)
    assert {(r.thread_id, r.session_id, r.parent_thread_id, r.is_subagent, r.replayed_from, r.agent_name, r.git_branch) for r in own} == {("t", "s", "r", True, "r", "n", "main")}
    assert [r.kind for r in own] == ["system", "system", "system", "user_prompt", "system", "tool_use", "tool_use", "other", "system", "assistant"]
    assert [r.native_event_id for r in own[:2]] == ["t:0", "t:1"] and len(own[9].native_event_id) == 32
    assert (own[0].model, own[0].cwd, own[3].model, own[3].cwd) == ("m", "/b", None, "/a")
    assert [(r.tool_name, r.tool_use_id) for r in own[5:7]] == [("sh", "c"), ("web_search", None)]


def test_usage_spellings(spark, tmp_path):
    _write(tmp_path / "u.jsonl", [_report({"prompt_tokens": 10, "cached_tokens": 30, "cache_write_input_tokens": 5, "output": 2, "input_tokens": -1}, None)])
    (r,) = thread_log.events(thread_log.lines(spark, [str(tmp_path)])).collect()
    assert (r.input_tokens, r.cache_read_tokens, r.cache_write_tokens, r.output_tokens, r.thread_id) == (0, 10, 0, 2, "u")


def test_totals(spark, tmp_path):
    records = [_report(_block(5, 1), _block(5, 1)), _report(_block(5, 1), _block(5, 1)), _report(None, _block(9, 4)), _report(None, _block(2, 1)), _report(_block(0, 0), None), _report(_block(1, 6), None)]
    assert _billed(spark, tmp_path, records) == [1, None, 3, None, None, 6]


def test_compaction_counts_once_whatever_the_order(spark, tmp_path):
    use = _block(7, 3)
    assert _billed(spark, tmp_path, [_record("a", use), _compacted("a"), _record("a", use), _compacted("a")]) == [None, 3, None, None]
    assert _billed(spark, tmp_path, [_compacted("a"), _record("a", use), _record("b", use)]) == [None, 3, None]
    covered = [_record("a", use), _report(use, _block(7, 3)), _compacted("a")]
    assert _billed(spark, tmp_path, covered) == [None, 3, None]
    repeated = [_record("a", use), _compacted("a"), _report(use, _block(7, 3)), _report(use, _block(14, 6))]
    assert _billed(spark, tmp_path, repeated) == [None, 3, None, 3]
    other = [_record("a", use), _report(_block(1, 1), _block(1, 1)), _compacted("a")]
    assert _billed(spark, tmp_path, other) == [None, 1, 3]


def test_empty(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    assert thread_log.events(thread_log.lines(spark, [str(tmp_path)])).count() == 0


def test_a_fork_counts_only_what_is_its_own(spark):
    """Usage taken one by one: the repeated head of the origin, else a burst at the start, counts for nothing."""
    import random

    from tidemark.sources.thread_log import BURST_MS, without_replays

    rng = random.Random(4)
    files: dict[str, tuple[str, str | None, list[tuple[int, int]]]] = {}
    make = lambda n, start, pauses: [(start := start + rng.choice(pauses), rng.randrange(4)) for _ in range(n)]
    for k in range(12):
        files[f"/logs/t{k}.jsonl"] = (f"t{k}", None, make(8, 0, [5000]))
    files["/logs/archived_sessions/t0.jsonl"] = ("t0", None, make(8, 0, [5000]))
    for k in range(40):
        origin = f"t{rng.randrange(14)}"  # t12 and t13 are not there
        head = [(i * rng.choice([20, 1500]), u) for i, (_, u) in enumerate(files.get(f"/logs/{origin}.jsonl", ("", None, make(5, 0, [30])))[2][: rng.randrange(6)])]
        files[f"/logs/f{k}.jsonl"] = (f"f{k}", origin, head + make(rng.randrange(1, 6), 10_000, [30, BURST_MS, BURST_MS + 1, 9000]))
    want = {}
    for path, (_, origin, own) in files.items():
        said = [u for _, u in files.get(f"/logs/{origin}.jsonl", ("", None, []))[2]] if origin else []
        n = 0
        while origin and n < min(len(own), len(said)) and own[n][1] == said[n]:
            n += 1
        if origin and not n and len(own) > 1 and 0 <= own[1][0] - own[0][0] <= BURST_MS:
            n = 1
            while n < len(own) and 0 <= own[n][0] - own[n - 1][0] <= BURST_MS:
                n += 1
        want.update({(path, 2 * i): None if i < n else u for i, (_, u) in enumerate(own)})
    rows = [(path, 2 * i + j, t, origin, ts, u if j == 0 else None) for path, (t, origin, own) in files.items() for i, (ts, u) in enumerate(own) for j in (0, 1)]
    kind = "file_path string, line int, thread_id string, replayed_from string, ts long, output_tokens long, input_tokens long, cache_read_tokens long, cache_write_tokens long"
    out = without_replays(spark.createDataFrame([(*r, r[5], 0, 0) for r in rows], kind))
    assert len(out.columns) == 9
    got = {(r.file_path, r.line): r.output_tokens for r in out.where("line % 2 = 0").collect()}
    assert got == want and None in want.values() and sum(v is not None for v in want.values()) > 60
