"""Fixed schemas; readers never infer one."""

from __future__ import annotations

from pyspark.sql import types as T

#: The kinds of event.
KINDS = ("user_prompt", "assistant", "tool_use", "tool_result", "system", "other")
SIGNIFICANT = KINDS[:4]
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens")
COMPONENTS = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
VERSION = 1


def _struct(longs: str, strings: str, booleans: str = "", doubles: str = "") -> T.StructType:
    kinds = ((longs, T.LongType()), (strings, T.StringType()), (booleans, T.BooleanType()), (doubles, T.DoubleType()))
    return T.StructType([T.StructField(n, t) for names, t in kinds for n in names.split()])


RAW_EVENT = _struct(f"ts ordinal line_no block_no {' '.join(TOKENS)}", "source native_session_id native_thread_id native_parent_id native_event_id kind model tool_name tool_use_id cwd git_branch cli_version agent_name file_path", "is_subagent")
EVENT = _struct(f"ts ordinal {' '.join(TOKENS)}", "id session_id thread_id native_event_id kind model tool_name tool_use_id")
PRICE = _struct("effective_from", "model currency origin matched_id note", "", "input_mtok output_mtok cache_read_mtok cache_write_mtok cache_write_1h_mtok")
