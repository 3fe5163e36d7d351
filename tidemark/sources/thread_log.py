"""Thread logs: JSON lines of one thread a file; the first session_meta line names the thread for all of them.

A usage report counts its own tokens where the running total moved, else what the total gained. A compaction request
counts once, at the later of its usage record and its compacted line, unless a usage report is the same request.
Lines that are not JSON objects, or without a readable time, give no event; a last line counts once it is whole JSON.
All windows run within a file, over one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_millis

#: Kinds by message role, by type of payload and by type of line, and tool names that the log only implies.
ROLES = {"user_prompt": ("user",), "assistant": ("assistant",), "system": ("developer", "system")}
PAYLOADS = {
    "assistant": ("reasoning", "agent_message"),
    "tool_use": ("function_call", "custom_tool_call", "tool_search_call", "web_search_call"),
    "tool_result": ("function_call_output", "custom_tool_call_output", "tool_search_output"),
    "system": ("token_count", "item_completed", "task_started", "task_complete", "turn_aborted", "thread_settings_applied", "thread_goal_updated"),
}
LINES = {"system": ("session_meta", "turn_context", "world_state", "compacted", "token_usage_record", "inter_agent_communication_metadata")}
IMPLIED_TOOLS = {"web_search": ("web_search_call",), "tool_search": ("tool_search_call", "tool_search_output")}
#: The spellings of each count of a usage block, the preferred one first.
COUNTS = {
    "input": ("input_tokens", "prompt_tokens", "input"),
    "cached": ("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"),
    "write": ("cache_write_input_tokens", "cache_creation_input_tokens"),
    "output": ("output_tokens", "completion_tokens", "output"),
    "reasoning": ("reasoning_output_tokens", "reasoning_tokens"),
    "total": ("total_tokens",),
}
SYNTHETIC_MODEL = "<synthetic>"

_BLOCK = f"struct<{', '.join(f'{a} double' for names in COUNTS.values() for a in names)}>"
_TEXTS = "type role id session_id parent_thread_id forked_from_id source agent_nickname cli_version cwd model name call_id response_id compaction_response_id"
_PAYLOAD = f"struct<{', '.join(f'{t} string' for t in _TEXTS.split())}, git struct<branch string>, thread_settings struct<model string, cwd string>, usage {_BLOCK}, thread_token_usage {_BLOCK}, info struct<total_token_usage {_BLOCK}, last_token_usage {_BLOCK}>>"
_LINE = f"timestamp string, ordinal bigint, type string, payload {_PAYLOAD}"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, place (block, number) and value of every line; place orders the lines of a file, as a task reads a block in order."""
    read = spark.read.option("recursiveFileLookup", True).text(paths)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    return read.select(F.col("_metadata.file_path").alias("file_path"), place.alias("place"), "value")


def _choose(value: Column, names: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*(F.when(value.isin(*of), k) for k, of in names.items()))


def _usage(count: dict[str, Column]) -> Column:
    """A usage struct whose cached and written parts never exceed the input they belong to."""
    cached = F.least(count["cached"], count["input"])
    write = F.least(count["write"], F.greatest(count["input"] - cached, F.lit(0)))
    return F.struct(*(c.cast("long").alias(k) for k, c in (count | {"cached": cached, "write": write}).items()))


def usage(block: str) -> Column:
    """The usage struct of a block; null without a block. A total of zero or none is input + output."""
    of = lambda name: F.coalesce(*(F.when(F.col(f"{block}.{a}") >= 0, F.floor(f"{block}.{a}")) for a in COUNTS[name]), F.lit(0))
    count = {name: of(name) for name in COUNTS}
    count["total"] = F.when(count["total"] > 0, count["total"]).otherwise(count["input"] + count["output"])
    return F.when(F.col(block).isNotNull(), _usage(count))


def gained(total: str, before: str) -> Column:
    """What each count of a total gained, never negative."""
    return _usage({k: F.greatest(F.col(f"{total}.{k}") - F.coalesce(F.col(f"{before}.{k}"), F.lit(0)), F.lit(0)) for k in COUNTS})


def _any(u: str) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (F.col(f"{u}.{k}") > 0 for k in COUNTS if k != "total")), F.lit(False))


def prepared(log: DataFrame, *keep: str) -> DataFrame:
    """rows (file_path, place, value) plus what the ledger needs: whole (the line is a JSON object), ts, ordinal, type, p, rid, total and last of a report, own and thread of a record; keep: further columns."""
    whole = F.coalesce(F.expr("try_parse_json(value) IS NOT NULL") & F.expr("startswith(ltrim(value), '{')"), F.lit(False))
    rows = log.withColumn("whole", whole).withColumn("r", F.when(F.col("whole"), F.from_json("value", _LINE)))
    rows = rows.select("file_path", "place", "value", *keep, "whole", iso_millis(F.col("r.timestamp")).alias("ts"), F.col("r.ordinal").alias("ordinal"), F.col("r.type").alias("type"), F.col("r.payload").alias("p"))
    key = F.nullif(F.trim(F.coalesce("p.response_id", "p.compaction_response_id")), F.lit(""))
    report = F.col("p.type").eqNullSafe("token_count") & F.col("ts").isNotNull()
    x = rows.withColumn("rid", F.when(F.col("type").isin("token_usage_record", "compacted"), key))
    x = x.withColumn("total", F.when(report, usage("p.info.total_token_usage"))).withColumn("last", F.when(report, usage("p.info.last_token_usage")))
    return x.withColumn("own", usage("p.usage")).withColumn("thread", usage("p.thread_token_usage"))


def ledger(rows: DataFrame) -> DataFrame:
    """prepared rows plus line (number in the file) and counted: the usage that each line bills, or null."""
    w = W.partitionBy("file_path").orderBy("place")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    report, known = F.col("p.type").eqNullSafe("token_count") & F.col("ts").isNotNull(), F.col("rid").isNotNull()
    x = rows.withColumn("line", F.row_number().over(w))
    x = x.withColumn("prior", F.last("total", ignorenulls=True).over(before))
    moved = F.col("total").isNull() | ~F.col("total").eqNullSafe(F.col("prior"))
    x = x.withColumn("used", F.when(report, F.when(F.col("last").isNotNull() & moved, F.col("last")).when(F.col("total").isNotNull(), gained("total", "prior"))))
    x = x.withColumn("used", F.when(_any("used"), F.col("used"))).withColumn("counts", F.col("used").isNotNull() & moved)
    # a request's first record, and the line that bills it
    record = known & (F.col("type") == "token_usage_record") & F.col("ts").isNotNull() & _any("own")
    of = W.partitionBy("file_path", "rid")
    x = x.withColumn("record", F.coalesce(record, F.lit(False)))
    request = F.min_by(F.when(F.col("record"), F.struct("own", "thread")), F.when(F.col("record"), F.col("line"))).over(of)
    recorded, compacted = F.min(F.when(F.col("record"), F.col("line"))).over(of), F.min(F.when(F.col("type") == "compacted", F.col("line"))).over(of)
    x = x.withColumn("request", F.when(known, request)).withColumn("billed_at", F.when(known & recorded.isNotNull() & compacted.isNotNull(), F.greatest(recorded, compacted)))
    # the latest request before a report, which may be the same one
    live = F.col("record") & (F.col("billed_at").isNull() | (F.col("line") <= F.col("billed_at")))
    x = x.withColumn("latest", F.last(F.when(live, F.struct("rid", "request", "billed_at")), ignorenulls=True).over(before))
    x = x.withColumn("reported", F.max(F.when(F.col("counts"), F.col("line"))).over(before)).withColumn("bill", F.max(F.when(F.col("line") == F.col("billed_at"), F.col("line"))).over(before))
    same = F.col("counts") & F.coalesce((F.col("latest.request.own") == F.col("used")) | (F.col("latest.request.thread") == F.col("total")), F.lit(False))
    open_ = F.col("latest.billed_at").isNull() | (F.col("latest.billed_at") > F.col("line"))
    x = x.withColumn("covers", F.coalesce(same & open_, F.lit(False)))
    again = same & ~open_ & (F.col("bill") == F.col("latest.billed_at")) & (F.col("reported").isNull() | (F.col("reported") < F.col("bill")))
    x = x.withColumn("again", F.coalesce(again, F.lit(False))).withColumn("of", F.when(F.col("covers"), F.col("latest.rid")).otherwise(F.col("rid")))
    x = x.withColumn("covered", F.max("covers").over(W.partitionBy("file_path", "of")))
    bills = (F.col("line") == F.col("billed_at")) & ~F.col("covered")
    counted = F.when(F.col("used").isNotNull() & ~F.col("again"), F.col("used")).when(bills, F.col("request.own"))
    return x.select(*rows.columns, "line", counted.alias("counted"))


def events(log: DataFrame) -> DataFrame:
    """lines() as events; replayed_from is the thread whose history a fork's file repeats first."""
    all_ = W.partitionBy("file_path").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return shaped(ledger(prepared(log).where("whole")).withColumn("m", F.first(F.when(F.col("type") == "session_meta", F.col("p")), ignorenulls=True).over(all_)))


def meta_of(value: Column) -> Column:
    """The payload of a session_meta line, as events() keep it."""
    return F.from_json(value, _LINE)["payload"]


def shaped(x: DataFrame) -> DataFrame:
    """Rows of the ledger with m, the payload of their file's first session_meta line, as events."""
    x = x.where("ts IS NOT NULL")
    filled = lambda c: F.nullif(c, F.lit(""))
    thread = F.coalesce(filled(F.col("m.id")), F.regexp_extract("file_path", r"([^/]+?)(\.[^./]*)?$", 1))
    # `source` is a word on root threads; only an object can say that a thread is another's
    source = F.when(F.expr("startswith(ltrim(m.source), '{')"), F.col("m.source"))
    child = F.coalesce(F.get_json_object(source, "$.subagent").isNotNull(), F.lit(False))
    origin = F.coalesce(filled(F.col("m.forked_from_id")), F.get_json_object(source, "$.subagent.thread_spawn.parent_thread_id"))
    kind = F.when(F.col("p.type") == "message", _choose(F.col("p.role"), ROLES)).when(F.col("p.type").isNotNull(), _choose(F.col("p.type"), PAYLOADS)).otherwise(_choose(F.col("type"), LINES))
    turn, settings = F.col("type") == "turn_context", F.col("p.type") == "thread_settings_applied"
    said = lambda c: filled(F.when(turn, F.col(f"p.{c}")).when(settings, F.col(f"p.thread_settings.{c}")))
    x = x.withColumn("kind", F.coalesce(kind, F.lit("other"))).withColumn("thread_id", thread)
    tool = F.coalesce(_choose(F.col("p.type"), IMPLIED_TOOLS), filled(F.col("p.name")))
    number = F.concat("thread_id", F.lit(":"), F.col("ordinal").cast("string"))
    return x.select(
        "ts", "file_path", "line", "ordinal", F.coalesce(filled(F.col("m.session_id")), F.col("thread_id")).alias("session_id"), "thread_id", filled(F.col("m.parent_thread_id")).alias("parent_thread_id"),
        child.alias("is_subagent"), F.nullif(origin, F.col("thread_id")).alias("replayed_from"), "kind", F.coalesce(number, F.substring(F.sha2("value", 256), 1, 32)).alias("native_event_id"),
        F.nullif(said("model"), F.lit(SYNTHETIC_MODEL)).alias("model"), F.coalesce(said("cwd"), filled(F.col("m.cwd"))).alias("cwd"), F.col("m.git.branch").alias("git_branch"), F.col("m.cli_version").alias("cli_version"),
        F.col("m.agent_nickname").alias("agent_name"), F.when(F.col("kind").isin("tool_use", "tool_result"), tool).alias("tool_name"), F.col("p.call_id").alias("tool_use_id"),
        F.greatest(F.col("counted.input") - F.col("counted.cached") - F.col("counted.write"), F.when(F.col("counted").isNotNull(), 0)).alias("input_tokens"),
        F.col("counted.output").alias("output_tokens"), F.col("counted.cached").alias("cache_read_tokens"), F.col("counted.write").alias("cache_write_tokens"),
    )


#: How long a fork pauses at most inside history that it repeats, in ms, and how the path of a put-away copy is told.
BURST_MS = 1000
ARCHIVED = "/archived_sessions/"


def without_replays(rows: DataFrame) -> DataFrame:
    """events() in which a fork's usage that repeats its origin's counts for nothing.

    Usage repeats while it equals the origin's, one by one from the start (the origin's active file comes before an archived one). Where not even the first is
    equal, or the origin is not there, a burst at the start is history: usage events of which each follows the one before within BURST_MS.
    """
    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    by_file = W.partitionBy("file_path").orderBy("line")
    own = rows.where("output_tokens IS NOT NULL").select("file_path", "line", "thread_id", "replayed_from", "ts", F.struct(*tokens).alias("usage"), F.row_number().over(by_file).alias("k"))
    first_file = F.min_by("file_path", F.struct(F.contains("file_path", F.lit(ARCHIVED)), "file_path"))
    files = own.groupBy(F.col("thread_id").alias("of")).agg(first_file.alias("of_file"))
    origin = own.join(files, (F.col("thread_id") == F.col("of")) & (F.col("file_path") == F.col("of_file"))).select(F.col("thread_id").alias("replayed_from"), "k", F.col("usage").alias("said"))
    forks = own.where("replayed_from IS NOT NULL").join(origin, ["replayed_from", "k"], "left")
    w = W.partitionBy("file_path").orderBy("k")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    pause = F.col("ts") - F.lag("ts").over(w)
    forks = forks.withColumn("same", F.coalesce(F.col("usage") == F.col("said"), F.lit(False)).cast("int")).withColumn("close", F.when(F.col("k") == 1, F.coalesce((F.lead("ts").over(w) - F.col("ts")).between(0, BURST_MS), F.lit(False))).otherwise(pause.between(0, BURST_MS)).cast("int"))
    told = forks.withColumn("repeats", F.min("same").over(so_far)).withColumn("bursts", F.min("close").over(so_far)).withColumn("begins", F.first("same").over(so_far))
    gone = told.where("repeats = 1 OR begins = 0 AND bursts = 1").select("file_path", "line", F.lit(True).alias("gone"))
    out = rows.join(gone, ["file_path", "line"], "left")
    return out.select(*(F.when(F.col("gone").isNull(), F.col(c)).alias(c) if c in tokens else F.col(c) for c in rows.columns))
