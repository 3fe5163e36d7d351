"""Growing line files as a stream: a Python data source whose offsets are bytes, so a file is read on from where the last batch ended.

`spark.dataSource.register(Tail)`, then `spark.readStream.format("tail").option("path", glob).load()`. The driver only looks at sizes and at the
last block of files that grew; executors read the ranges, one partition for each CHUNK bytes. A half-written last line is held back until its newline
comes, a file that shrank starts again at 0, and a file that cannot be read gives one row with its error and stops nothing else.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK, BLOCK = 64 << 20, 1 << 16
#: Before the path of a file that cannot be read, in an offset; its bytes stay under the path alone.
UNREAD = "!"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def line_end(path: str, size: int, least: int) -> int:
    """The place behind the last newline in the first size bytes, not before least."""
    with open(path, "rb") as f:
        at = size
        while at > least:
            start = max(least, at - BLOCK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return least


def ranges(path: str, start: int, end: int) -> list[Range]:
    return [Range(path, a, min(a + CHUNK, end)) for a in range(start, end, CHUNK)]


def lines_of(part: Range) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(path, place of the line, line, error) of the lines that begin in the range; the last one may end behind it. A range of an UNREAD path gives its error."""
    if part.path.startswith(UNREAD):
        path = part.path.removeprefix(UNREAD)
        try:
            os.close(os.open(path, os.O_RDONLY))
        except OSError as e:
            yield path, 0, None, f"{type(e).__name__}: {e.strerror}"
        return
    try:
        with open(part.path, "rb") as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that began before
            while at < part.end and (line := f.readline()):
                if not line.endswith(b"\n"):
                    return
                yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace"), None
                at += len(line)
    except OSError as e:
        yield part.path, part.start, None, f"{type(e).__name__}: {e.strerror}"


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern, self.known = os.path.expandvars(os.path.expanduser(pattern)), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """path -> bytes decided; files by their real path, so that links count once. A file that cannot be read has its UNREAD path besides, until it can."""
        out = dict(self.known)
        for path in sorted({os.path.realpath(p) for p in glob.glob(self.pattern, recursive=True)}):
            done = out.get(path, 0)
            try:
                size = os.stat(path).st_size
                out[path] = line_end(path, size, done if size >= done else 0)
                out.pop(UNREAD + path, None)
            except OSError:
                out[UNREAD + path] = 1  # told once as an error row
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """What grew; a file that is shorter than it was is read from 0."""
        return [r for path, to in end.items() for r in ranges(path, start.get(path, 0) if to >= start.get(path, 0) else 0, to)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(partition)


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file_path string, at long, value string, error string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
