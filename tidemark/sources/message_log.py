"""Message logs: append-only JSON lines, one object per message, many files, each read by Spark's text reader.

Each line of a response repeats the response's whole usage; it is billed once. A response is a run of usage lines of one file with the
same message id and request id (other lines do not break it): its first line keeps the usage, a later one only the output it adds.

Lines that are blank, not JSON objects or without a readable time are left out, as is a half-written last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_millis
from tidemark.operators.usage import bill_once

#: Types of a line that are the tool's own bookkeeping.
SYSTEM_TYPES = ("system", "mode", "permission-mode", "hook", "hook-result")
SYNTHETIC_MODEL = "<synthetic>"
#: Lines of a file that are searched for the agent's name.
HEAD_LINES = 64


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, line (block, number) and value of every line; line orders the lines of a file, as a task reads a block in order."""
    read = spark.read.option("recursiveFileLookup", True).text(paths)
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    return read.select(F.col("_metadata.file_path").alias("file_path"), line.alias("line"), "value")


def _text(path: str) -> Column:
    return F.get_json_object("value", f"$.{path}")


#: Usage of a line: its name in the log, and here.
USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_write_tokens", "cache_creation.ephemeral_1h_input_tokens": "cache_write_1h_tokens"}


def prepared(log: DataFrame) -> DataFrame:
    """rows (file_path, line, value) plus what billing needs: whole (the line is a JSON object), ts, response_id, request_id, usage as stated, usage_line, name (of an agent) and in_agent."""
    whole = F.expr("try_parse_json(value) IS NOT NULL") & F.expr("startswith(ltrim(value), '{')")
    own = log.select("*", F.coalesce(whole, F.lit(False)).alias("whole"), iso_millis(_text("timestamp")).alias("ts"), _text("message.id").alias("response_id"), _text("requestId").alias("request_id"), *(_text(f"message.usage.{a}").cast("long").alias(b) for a, b in USAGE.items()))
    usage = F.col("whole") & (_text("type") == "assistant") & F.startswith(_text("message.usage"), F.lit("{")) & F.col("response_id").isNotNull()
    return own.select("*", F.coalesce(usage, F.lit(False)).alias("usage_line"), F.nullif(_text("attributionAgent"), F.lit("")).alias("name"), _text("agentId").isNotNull().alias("in_agent"))


def once(rows: DataFrame) -> DataFrame:
    """rows with `first` and `billed_output` on their usage lines: the first line of a response keeps its usage, a later one only the output it adds."""
    added = F.when(F.col("output_tokens").isNotNull(), F.col("billed_output"))
    kept = {c: F.when(~F.col("usage_line") | F.col("first"), F.col(c)).otherwise(added if c == "output_tokens" else F.lit(None)) for c in USAGE.values()}
    return rows.withColumns(kept)


def _billed(read: DataFrame) -> DataFrame:
    """prepared rows with the usage that each line bills."""
    told = read.where("usage_line").withColumn("_output", F.when(F.col("ts").isNotNull(), F.col("output_tokens")))  # a line without a time bills nothing
    told = bill_once(told, "file_path", "line", ["response_id", "request_id"], "_output")
    return once(told).select(read.columns).unionByName(read.where("NOT usage_line"))


def agent_names(log: DataFrame) -> DataFrame:
    """(file_path, agent_name) of the files whose first HEAD_LINES lines name an agent: the first name counts for the whole file."""
    found = log.groupBy("file_path").agg(F.min("line").alias("head"), F.min(F.when(F.col("name").isNotNull(), F.struct("line", "name"))).alias("first"))
    near = (F.col("first.line.block") == F.col("head.block")) & (F.col("first.line.number") - F.col("head.number") < HEAD_LINES)
    return found.where(near).select("file_path", F.col("first.name").alias("agent_name"))


def events(log: DataFrame) -> DataFrame:
    """lines() as events; a subagent's events carry the name in its file's head; further tool blocks of a line are events of their own (id#place), without usage."""
    read = prepared(log).where("whole")
    return shaped(_billed(read).join(agent_names(read), "file_path", "left"))


def shaped(read: DataFrame) -> DataFrame:
    """Billed rows with their file's agent_name as events."""
    read = read.where("ts IS NOT NULL")
    blocks = F.from_json(_text("message.content"), "array<struct<type string, id string, name string, tool_use_id string>>")
    tools = F.filter(F.coalesce(blocks, F.array().cast("array<struct<type string, id string, name string, tool_use_id string>>")), lambda b: b["type"].isin("tool_use", "tool_result"))
    stem = F.regexp_extract("file_path", r"([^/]+?)(\.[^./]*)?$", 1)
    session = F.coalesce(_text("sessionId"), stem)
    agent, kind = _text("agentId"), _text("type")
    base = read.select(
        "ts", "file_path", "line", session.alias("session_id"), F.coalesce(agent, session).alias("thread_id"), agent.isNotNull().alias("is_subagent"),
        F.when(agent.isNotNull(), session).alias("parent_thread_id"), F.coalesce(_text("uuid"), F.substring(F.sha2("value", 256), 1, 32)).alias("native_event_id"),
        kind.alias("type"), F.nullif(_text("message.model"), F.lit(SYNTHETIC_MODEL)).alias("model"), "response_id", "request_id", _text("cwd").alias("cwd"), _text("gitBranch").alias("git_branch"), F.when(agent.isNotNull(), F.col("agent_name")).alias("agent_name"),
        *USAGE.values(),
        F.posexplode_outer(tools).alias("place", "tool"),
    )
    own = F.coalesce("place", F.lit(0)) == 0
    kinds = F.when(F.col("tool").isNotNull(), F.col("tool.type")).when(F.col("type") == "assistant", "assistant").when(F.col("type") == "user", "user_prompt").when(F.col("type").isin(*SYSTEM_TYPES), "system").otherwise("other")
    return base.select(
        "ts", "file_path", "line", "session_id", "thread_id", "parent_thread_id", "is_subagent", kinds.alias("kind"), "model", "response_id", "request_id", "cwd", "git_branch", "agent_name",
        F.when(own, F.col("native_event_id")).otherwise(F.concat("native_event_id", F.lit("#"), F.col("place").cast("string"))).alias("native_event_id"),
        F.col("tool.name").alias("tool_name"), F.coalesce("tool.id", "tool.tool_use_id").alias("tool_use_id"), *(F.when(own, F.col(c)).alias(c) for c in USAGE.values()),
    )
