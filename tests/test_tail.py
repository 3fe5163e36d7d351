"""Growing files: every whole line once, half-written ones held back, shrunk files from their start."""

from __future__ import annotations

import os

from tidemark.sources.tail import Tail, TailReader, line_end, lines_of, ranges


def test_ranges_split_lines_once(tmp_path, monkeypatch):
    from tidemark.sources import tail

    path = tmp_path / "a.log"
    text = b"".join(b"line %d %s\n" % (i, b"x" * (i % 17)) for i in range(200))
    path.write_bytes(text + b"half")
    end = line_end(str(path), len(text) + 4, 0)
    assert end == len(text)
    for chunk in (1, 7, 64, 10_000):
        monkeypatch.setattr(tail, "CHUNK", chunk)
        got = [r for p in ranges(str(path), 0, end) for r in lines_of(p)]
        assert [r[2] for r in got] == text.decode().splitlines() and all(text[r[1] :].startswith(r[2].encode()) for r in got)


def test_offsets(tmp_path):
    path = tmp_path / "b.log"
    path.write_text("one\ntwo\nthr")
    reader = TailReader(str(tmp_path / "*.log"))
    first = reader.latestOffset()
    assert [r[2] for p in reader.partitions({}, first) for r in lines_of(p)] == ["one", "two"]
    with open(path, "a") as f:
        f.write("ee\nfour\n")
    second = reader.latestOffset()
    assert [r[2] for p in reader.partitions(first, second) for r in lines_of(p)] == ["three", "four"]
    assert reader.partitions(second, reader.latestOffset()) == []
    path.write_text("new\n")
    third = reader.latestOffset()
    assert [r[2] for p in reader.partitions(second, third) for r in lines_of(p)] == ["new"]
    os.symlink(path, tmp_path / "link.log")
    assert reader.latestOffset() == third


def test_stream(spark, tmp_path):
    spark.dataSource.register(Tail)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("a1\na2\na")
    (logs / "gone.log").symlink_to(tmp_path / "nowhere")

    def run():
        q = spark.readStream.format("tail").option("path", str(logs / "*.log")).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination(120)
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).where("error IS NULL").collect())

    assert run() == ["a1", "a2"]
    with open(logs / "a.log", "a") as f:
        f.write("3\n")
    (logs / "b.log").write_text("b1\n")
    assert run() == ["a1", "a2", "a3", "b1"]
    assert {r.error.split(":")[0] for r in spark.read.parquet(str(tmp_path / "out")).where("error IS NOT NULL").collect()} <= {"FileNotFoundError"}


def test_a_file_that_cannot_be_read_at_first(tmp_path, monkeypatch):
    """Its error is told once; once it can be read, no line is lost."""
    from tidemark.sources import tail

    path = tmp_path / "c.log"
    path.write_text("first\nsecond\n")
    shut, real = [True], tail.line_end
    monkeypatch.setattr(tail, "line_end", lambda p, *a: (_ for _ in ()).throw(PermissionError(13, "Permission denied")) if shut[0] else real(p, *a))
    monkeypatch.setattr(tail.os, "open", lambda *a: (_ for _ in ()).throw(PermissionError(13, "Permission denied")))
    reader = TailReader(str(tmp_path / "*.log"))
    one = reader.latestOffset()
    told = [r for p in reader.partitions({}, one) for r in lines_of(p)]
    assert told == [(str(path), 0, None, "PermissionError: Permission denied")]
    assert reader.partitions(one, reader.latestOffset()) == []
    shut[0] = False
    two = reader.latestOffset()
    assert [r[2] for p in reader.partitions(one, two) for r in lines_of(p)] == ["first", "second"]
