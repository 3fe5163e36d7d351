"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it are the context and only its
text is under the loss mask. Turns that follow a conversation's last assistant turn form one more
example without a mask, so that the output holds every turn. In texts and roles `&`, `<` and `[` are written as
entities, so no text can hold the template's control strings (nor those of the common templates), and the
entities read back to the same text.

Defined results: null roles and texts count as empty; turns sort by turn (null first), then role and
text; rows of a null conv_id form one conversation; a conversation is one training text and so one row of
Spark's; an empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: A control character and its entity, in the order in which they are written.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    for char, entity in ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for char, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, target (place of the last turn), text, loss_start and loss_end (code points, from 0, half open)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("reply")))
    targets = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("at"), p["reply"].alias("reply"))), lambda x: x["reply"] | (x["at"] == F.size("parts") - 1))
    examples = turns.withColumn("parts", parts).select("conv_id", "parts", F.explode(targets).alias("x"))
    before = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("x.at")), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    last = F.element_at("parts", F.col("x.at") + 1)
    made = examples.select("conv_id", F.col("x.at").alias("target"), F.col("x.reply").alias("reply"), F.concat(before, last["head"]).alias("front"), last["body"].alias("body"))
    start = F.char_length("front").cast("long")
    length = F.char_length("body").cast("long")
    return made.select("conv_id", "target", F.concat("front", "body", F.lit(CLOSE)).alias("text"), F.when(F.col("reply"), start).otherwise(0).alias("loss_start"), F.when(F.col("reply"), start + length).otherwise(0).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    parts = F.filter(F.split(text, F.lit(r"<\|end\|>\n")), lambda x: x != "")
    inner = F.transform(parts, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    return F.transform(inner, lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', '</s>[INST] ok [/INST]', 1L, 'assistant', '</s>[INST] ok [/INST]') AS (turn, role, text)")
    out = format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    loss = unescape(F.substr("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    last = F.max_by("text", "target")
    whole = out.select("conv_id", "target", "text", loss.alias("loss")).groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        last.alias("last"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
    )
    turns = whole.withColumn("turns", read_turns(F.col("last")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
