"""The stateful reader: logs cut anywhere give the events of one pass."""

from __future__ import annotations

import json
import random

from tidemark.sources import message_log, thread_log
from tidemark.streaming.reader import MessageMachine, ThreadMachine, message_events, thread_events, watch

from .test_thread_log import _block, _compacted, _record, _report


def _at(i: int) -> str:
    return f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z"


def message_lines_() -> list[str]:
    """Responses of several lines, broken by other lines, repeated later; lines without time, not JSON, of an agent named late."""
    rng, out = random.Random(3), []
    for i in range(90):
        rid = f"m{i // 3 if i % 7 else i // 9}"
        kind = rng.choice(["assistant"] * 5 + ["user", "system"])
        line = {"type": kind, "uuid": f"u{i}", "timestamp": None if i % 17 == 5 else _at(i), "sessionId": "s", "message": {"id": rid, "model": "m", "content": [{"type": "tool_use", "id": f"t{i}", "name": "sh"}, {"type": "text"}, {"type": "tool_result", "tool_use_id": f"t{i}"}] if i % 4 == 0 else "x"}, "requestId": rng.choice(["r", None])}
        if kind == "assistant":
            line["message"]["usage"] = {"input_tokens": i, "output_tokens": rng.randrange(50), "cache_creation": {"ephemeral_1h_input_tokens": 2}}
        out.append(json.dumps(line) if i % 23 != 11 else rng.choice(["", "[1]", "{broken"]))
    return out


def agent_lines() -> list[str]:
    return [json.dumps({**json.loads(x), "agentId": "a", **({"attributionAgent": "helper"} if i == 40 else {})}) if x.startswith("{") and not x.startswith("{b") else x for i, x in enumerate(message_lines_())]


def thread_lines_() -> list[str]:
    rng = random.Random(5)
    records: list[dict] = [{"type": "turn_context", "payload": {"model": "m"}}, _report(_block(5, 5), _block(5, 5)), {"type": "session_meta", "payload": {"id": "t", "session_id": "s", "parent_thread_id": "r"}}, {"type": "session_meta", "payload": {"id": "other"}}]
    total = [5, 5]
    for i in range(120):
        kind = rng.randrange(9)
        last = _block(rng.randrange(1, 9), rng.randrange(1, 4), rng.randrange(3))
        if kind < 3:
            total = [total[0] + last["input_tokens"], total[1] + last["output_tokens"]]
            records.append(_report(rng.choice((last, None)), rng.choice((_block(*total), _block(*total), None))))
        elif kind == 3:
            records.append(_report(last, _block(*total)))  # a repeat
        elif kind == 4:
            records.append(_record(f"c{rng.randrange(12)}", last, rng.choice((_block(*total), None))))
        elif kind == 5:
            records.append(_compacted(f"c{rng.randrange(12)}"))
        elif kind == 6:
            rid = f"d{i}"
            parts = [_record(rid, last, _block(total[0] + last["input_tokens"], total[1] + last["output_tokens"])), _compacted(rid), _report(last, _block(total[0] + last["input_tokens"], total[1] + last["output_tokens"]))]
            total = [total[0] + last["input_tokens"], total[1] + last["output_tokens"]]
            rng.shuffle(parts)
            records += parts
        else:
            records.append({"type": "response_item", "payload": {"type": "message", "role": rng.choice(("user", "assistant"))}})
    out = [json.dumps({**({} if i % 31 == 7 else {"timestamp": _at(i)}), "ordinal": i, **r}) for i, r in enumerate(records)]
    out.insert(50, "not json")
    return out


#: By kind: the module, the machine, events of billed lines, and the columns to compare.
KINDS = {"messages": (message_log, MessageMachine, message_events), "threads": (thread_log, ThreadMachine, thread_events)}


def _rows(df) -> list[tuple]:
    cols = [c for c in df.columns if c not in ("file_path", "line")]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def _prepared(spark, kind: str, lines: list[str], monkeypatch) -> list[dict]:
    """The lines as the stream's own plan gives them to the machine."""
    from tidemark.streaming import reader

    held = []
    monkeypatch.setattr(reader, "_stated", lambda rows, *a: held.append(rows) or rows)
    reader.READERS[kind][0](spark.createDataFrame([("f", 10 * i, x) for i, x in enumerate(lines)], "file_path string, at long, value string"))
    monkeypatch.undo()
    return sorted((r.asDict(recursive=True) for r in held[0].collect()), key=lambda r: r["at"])


def test_machines_cut_at_every_line_bill_as_one_pass(spark, tmp_path, monkeypatch):
    for name, kind, lines in (("m", "messages", message_lines_()), ("a", "messages", agent_lines()), ("t", "threads", thread_lines_())):
        module, machine, events_of = KINDS[kind]
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.jsonl").write_text("\n".join(lines) + "\n")
        want = _rows(module.events(module.lines(spark, [str(tmp_path / name)])))
        rows = _prepared(spark, kind, lines, monkeypatch)
        state = machine.new()
        whole = machine.step(state, [dict(r) for r in rows])
        assert whole and not state["held"]
        for cut in range(len(rows) + 1):
            state = machine.new()
            out = machine.step(state, [dict(r) for r in rows[:cut]])
            state = json.loads(json.dumps(state))
            assert out + machine.step(state, [dict(r) for r in rows[cut:]]) == whole, (name, cut)
        fields = f"file_path string, {machine.columns}, {machine.answers}"
        columns = [f.split()[0] for f in fields.split(", ")]
        billed = spark.createDataFrame([tuple({**r, "file_path": "f"}[c] for c in columns) for r in whole], fields)
        assert _rows(events_of(billed)) == [tuple(x) for x in want], name


def test_undecided_lines_go_out_when_the_file_rests():
    line = {"value": "{}", "whole": True, "ts": 1, "response_id": None, "request_id": None, "output_tokens": None, "usage_line": False, "name": None, "in_agent": True}
    state = MessageMachine.new()
    assert MessageMachine.step(state, [{**line, "at": i} for i in range(5)]) == [] and len(state["held"]) == 5
    assert [r["agent_name"] for r in MessageMachine.step(state, [], settled=True)] == [None] * 5 and not state["held"]
    assert [r["agent_name"] for r in MessageMachine.step(state, [{**line, "at": 9, "name": "late"}])] == ["late"]
    many = MessageMachine.new()
    assert len(MessageMachine.step(many, [{**line, "at": i} for i in range(64)])) == 64  # the head is over
    thread = {"value": "x", "whole": True, "ts": 1, "type": "turn_context", "rid": None, "is_report": False, "total": None, "last": None, "own": None, "thread": None}
    state = ThreadMachine.new()
    assert ThreadMachine.step(state, [{**thread, "at": 0}]) == []
    assert [r["meta"] for r in ThreadMachine.step(state, [{**thread, "at": 1, "type": "session_meta", "value": "M"}])] == ["M", "M"]


def test_watched_logs_are_those_of_one_pass(spark, tmp_path):
    """Real files that grow, cut in the middle of lines, over runs of the stream that end and go on; one file starts again."""
    for kind, lines in (("messages", agent_lines()), ("threads", thread_lines_())):
        module = KINDS[kind][0]
        logs = tmp_path / kind
        logs.mkdir()
        data = ("\n".join(lines) + "\n").encode()
        (logs / "again.jsonl").write_bytes(data[:900])
        done = 0
        for to in (len(data) // 3, len(data) * 2 // 3, len(data)):
            with open(logs / "f.jsonl", "ab") as f:
                f.write(data[done:to])
            if done:
                (logs / "again.jsonl").write_bytes(data[:400])
            done = to
            q = watch(spark, kind, str(logs / "*.jsonl"), lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out-{kind}/batch={n}"), str(tmp_path / f"state-{kind}"), availableNow=True)
            q.awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out-{kind}").where("file_path LIKE '%f.jsonl'").drop("batch")
        want = module.events(module.lines(spark, [str(logs / "f.jsonl")]))
        assert _rows(got.select(*want.columns)) == _rows(want)
