"""A response's usage, repeated on each of its lines, is billed once."""

from __future__ import annotations

import json

from tidemark.sources import message_log
from tidemark.sources.message_log import events, lines


def test_response_of_several_lines_is_billed_once(spark, tmp_path):
    def line(uuid, output, id="m", request="r", **x):
        usage = {"input_tokens": 7, "output_tokens": output, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 4, "cache_creation": {"ephemeral_1h_input_tokens": 3}}
        return json.dumps({"sessionId": "s", "timestamp": "2026-01-01T00:00:00.000Z", "type": "assistant", "uuid": uuid, "requestId": request, "message": {"id": id, "usage": usage}, **x})

    user = json.dumps({"sessionId": "s", "timestamp": "2026-01-01T00:00:00.000Z", "type": "user", "uuid": "u", "message": {"content": "hi"}})
    text = [line("a", 10), line("b", 10), user, line("c", 25), line("d", 20), line("e", 8, request=None), line("f", 9, request=None), line("g", 30, id="n"), line("h", 2), line("i", None), line("j", 6)]
    text += [line("k", 40, id="o", timestamp="no time"), line("l", 50, id="o")]
    (tmp_path / "one.jsonl").write_text("\n".join(text) + "\n")
    (tmp_path / "two.jsonl").write_text(line("z", 3) + "\n")
    got = {r.native_event_id: r for r in message_log.events(message_log.lines(spark, [str(tmp_path)])).collect()}
    assert {k: r.output_tokens for k, r in got.items()} == {"a": 10, "b": 0, "u": None, "c": 15, "d": 0, "e": 8, "f": 1, "g": 30, "h": 2, "i": None, "j": 4, "l": 50, "z": 3}
    assert {k for k, r in got.items() if r.input_tokens == 7 and (r.cache_read_tokens, r.cache_write_tokens, r.cache_write_1h_tokens) == (5, 4, 3)} == {"a", "e", "g", "h", "z"}
    assert all(got[k].input_tokens is got[k].cache_read_tokens is got[k].cache_write_tokens is got[k].cache_write_1h_tokens is None for k in "bcdfijl")
    assert got["a"].request_id == "r" and got["e"].request_id is None


def test_agent_name_is_sniffed_from_the_head(spark, tmp_path):
    """The first name within 64 lines holds for every event of a subagent's file; a later one, and that of a root file, for none."""
    row = lambda i, agent, name=None: json.dumps({"type": "user", "uuid": f"u{agent}{i}", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "s", **({"agentId": agent} if agent else {}), **({"attributionAgent": name} if name else {})})
    for file, agent, at in (("early", "a1", 3), ("late", "a2", 70), ("root", None, 1), ("never", "a3", None)):
        (tmp_path / f"{file}.jsonl").write_text("".join(row(i, agent, "scout" if i == at else "other" if at is not None and i > at else None) + "\n" for i in range(80)))
    got = {(r.file_path.rsplit("/", 1)[-1], r.agent_name) for r in events(lines(spark, [str(tmp_path)])).select("file_path", "agent_name").distinct().collect()}
    assert got == {("early.jsonl", "scout"), ("late.jsonl", None), ("root.jsonl", None), ("never.jsonl", None)}
    (tmp_path / "queue.jsonl").write_text(json.dumps({"type": "queue-operation", "timestamp": "2026-01-01T00:00:00Z"}) + "\n")
    assert {r.kind for r in events(lines(spark, [str(tmp_path / "queue.jsonl")])).collect()} == {"other"}
