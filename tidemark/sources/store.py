"""A relational session store kept in SQLite files: tables session, message and part, opened from the bytes that Spark reads.

A store is one file of one machine, so a task reads each. Where a write-ahead log lies beside it (`-wal`), the pages of its committed transactions
are put in place first, so rows that the tool has not yet moved into the main file are read too. What cannot be read has a row in errors().
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables' columns.
TABLES = {"session": ("id", "parent_id", "directory"), "message": ("id", "session_id", "time_created", "data"), "part": ("id", "session_id", "time_created", "data")}
#: States of a tool call that has not ended.
UNFINISHED = ("pending", "running")
DEPTH = 32


#: Fixed values of the file format: the first word of a log by the byte order of its checksums, and the sizes of its header and of a frame's.
WAL_MAGIC = {0x377F0682: "<", 0x377F0683: ">"}
WAL_HEADER, FRAME_HEADER = 32, 24


def _sums(data: bytes, order: str, s0: int, s1: int) -> tuple[int, int]:
    """The log's running checksum over the words of data."""
    words = iter(struct.unpack(f"{order}{len(data) // 4}I", data))
    for x, y in zip(words, words):
        s0 = (s0 + x + s1) & 0xFFFFFFFF
        s1 = (s1 + y + s0) & 0xFFFFFFFF
    return s0, s1


def with_log(main: bytes, wal: bytes) -> bytes:
    """The database as its committed transactions left it: frames of the log's own salts with right checksums, up to the last that ends a transaction."""
    if len(wal) < WAL_HEADER + FRAME_HEADER or struct.unpack(">I", wal[:4])[0] not in WAL_MAGIC:
        return main
    order = WAL_MAGIC[struct.unpack(">I", wal[:4])[0]]
    size, salts = struct.unpack(">I", wal[8:12])[0], wal[16:24]
    sums = _sums(wal[:24], order, 0, 0)
    if sums != struct.unpack(">2I", wal[24:32]):
        return main
    pages, waiting, last = {}, {}, 0
    for at in range(WAL_HEADER, len(wal) - FRAME_HEADER - size + 1, FRAME_HEADER + size):
        head, page = wal[at : at + FRAME_HEADER], wal[at + FRAME_HEADER : at + FRAME_HEADER + size]
        sums = _sums(page, order, *_sums(head[:8], order, *sums))
        if head[8:16] != salts or sums != struct.unpack(">2I", head[16:24]):
            break
        number, ends = struct.unpack(">2I", head[:8])
        waiting[number] = page
        if ends:  # the database's size in pages after this transaction
            pages |= waiting
            waiting, last = {}, ends
    if not pages:
        return main
    out = bytearray(main[: last * size].ljust(last * size, b"\0"))
    for number, page in pages.items():
        if number <= last:
            out[(number - 1) * size : number * size] = page
    return bytes(out)


def opened(main: bytes, wal: bytes | None) -> sqlite3.Connection:
    """The store in memory, to be read."""
    data = bytearray(with_log(bytes(main), bytes(wal or b"")))
    if len(data) >= 20 and data[18] == 2:  # says that a log lies beside it, which in memory there is not
        data[18] = data[19] = 1
    con = sqlite3.connect(":memory:")
    con.deserialize(bytes(data))
    return con


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content, wal) of every store under paths, each with the log beside it; paths may be folders, or files with or without their logs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = [jvm.org.apache.hadoop.fs.Path(f"{p}-wal") for p in paths if not p.endswith("-wal")]
    there = [str(p) for p in beside if p.getFileSystem(conf).exists(p)]
    files = spark.read.format("binaryFile").load(sorted({*paths, *there})).select("path", "content").where("NOT endswith(path, '-shm')")
    log = F.endswith("path", F.lit("-wal"))
    logs = files.where(log).select(F.regexp_replace("path", "-wal$", "").alias("path"), F.col("content").alias("wal"))
    return files.where(~log).join(logs, "path", "left")


def table(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """One table of all stores under paths, as strings, with the store's path."""
    columns = TABLES[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, wal in zip(batch["path"], batch["content"], batch["wal"]):
                try:
                    rows = opened(content, wal).execute(f"SELECT {', '.join(columns)} FROM {name}")
                    while some := rows.fetchmany(5000):
                        yield pd.DataFrame([[path, *(None if v is None else str(v) for v in r)] for r in some], columns=["path", *columns])
                except sqlite3.Error:
                    continue  # told by errors()

    return _files(spark, paths).mapInPandas(run, ", ".join(f"{c} string" for c in ("path", *columns)))


def errors(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, error) of the files under paths that are no such store, or are damaged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, wal in zip(batch["path"], batch["content"], batch["wal"]):
                try:
                    con = opened(content, wal)
                    for name, columns in TABLES.items():
                        for _ in con.execute(f"SELECT {', '.join(columns)} FROM {name}"):
                            pass
                except sqlite3.Error as e:
                    yield pd.DataFrame({"path": [path], "error": [f"{type(e).__name__}: {e}"]})

    return _files(spark, paths).mapInPandas(run, "path string, error string")


def with_root(sessions: DataFrame) -> DataFrame:
    """sessions plus root_id: the ancestor without a known parent, at most DEPTH steps up; a cycle ends where it closes."""
    spark = sessions.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE up(path, id, at, parent, seen, depth) AS (
          SELECT path, id, id, parent_id, array(id), 0 FROM {{s}}
          UNION ALL SELECT up.path, up.id, p.id, p.parent_id, array_append(up.seen, p.id), up.depth + 1 FROM up JOIN {{s}} p ON p.path = up.path AND p.id = up.parent
          WHERE up.depth < {DEPTH} AND NOT array_contains(up.seen, p.id))
        SELECT s.*, r.root_id FROM {{s}} s JOIN (SELECT path, id, max_by(at, depth) AS root_id FROM up GROUP BY path, id) r ON r.path = s.path AND r.id = s.id""",
        s=sessions,
    )


def message_events(messages: DataFrame) -> DataFrame:
    """Each message as a start event with its tokens and, where it completed later, an event of its end without them."""
    j = lambda p: F.get_json_object("data", f"$.{p}")
    start, done = F.coalesce(j("time.created").cast("long"), F.col("time_created").cast("long")), j("time.completed").cast("long")
    out = messages.select("path", "session_id", "id", start.alias("start"), done.alias("done"), j("role").alias("role"), j("modelID").alias("model"), *(j(f"tokens.{a}").cast("long").alias(b) for a, b in (("input", "input_tokens"), ("output", "output_tokens"), ("reasoning", "reasoning_tokens"), ("total", "total_tokens"), ("cache.read", "cache_read_tokens"), ("cache.write", "cache_write_tokens"))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = F.col("total_tokens") == zero("input_tokens") + zero("output_tokens") + zero("cache_read_tokens") + zero("cache_write_tokens")
    billed = F.col("output_tokens") + F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(zero("reasoning_tokens"))
    both = F.filter(F.array(F.struct(F.lit(False).alias("end"), F.col("start").alias("ts")), F.struct(F.lit(True).alias("end"), F.col("done").alias("ts"))), lambda e: ~e["end"] | F.coalesce(e["ts"] > F.col("start"), F.lit(False)))
    rows = out.withColumn("output_tokens", billed).withColumn("e", F.explode(both))
    first = lambda c: F.when(~F.col("e.end"), F.col(c)).alias(c)
    return rows.select("path", "session_id", F.when(F.col("e.end"), F.concat("id", F.lit(":done"))).otherwise(F.col("id")).alias("native_event_id"), F.col("e.ts").alias("ts"), F.when(F.col("role") == "user", "user_prompt").when(F.col("role") == "assistant", "assistant").otherwise("other").alias("kind"), "model", *map(first, ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")))


def tool_events(parts: DataFrame) -> DataFrame:
    """Tool parts as a use at their start and, where they have ended, a result at their end; other parts are dropped before anything else is parsed."""
    j = lambda p: F.get_json_object("data", f"$.{p}")
    tools = parts.where(j("type") == "tool").select("path", "session_id", "id", j("tool").alias("tool_name"), j("callID").alias("tool_use_id"), j("state.time.start").cast("long").alias("start"), F.when(~F.coalesce(j("state.status"), F.lit("")).isin(*UNFINISHED), j("state.time.end").cast("long")).alias("done"))
    use = F.struct(F.lit("tool_use").alias("kind"), F.col("start").alias("ts"), F.col("id").alias("native_event_id"))
    result = F.struct(F.lit("tool_result").alias("kind"), F.greatest("done", "start").alias("ts"), F.concat("id", F.lit(":done")).alias("native_event_id"))
    rows = tools.where("start IS NOT NULL").select("*", F.explode(F.when(F.col("done").isNotNull(), F.array(use, result)).otherwise(F.array(use))).alias("e"))
    return rows.select("path", "session_id", "e.native_event_id", "e.ts", "e.kind", "tool_name", "tool_use_id")
