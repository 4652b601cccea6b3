"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, only its text is trainable.
Turns behind the last assistant turn become one more example without a trainable part, so the output holds every turn.

A turn is written ``<s>[INST] role [/INST]text</s>``. In a role or text, each of the template's control strings gets a
backslash behind its first character (one more, where it has some); reading takes one away, so any text survives.

Edge cases: null roles and texts are empty; turns go by (turn, role, text), so ties have one order; repeated rows are
turns of their own; rows of a null conversation form one; very long texts are escaped and written whole; an empty table
gives no example; other columns are ignored. A conversation is one training text and is held by one task; its examples are
as long as its prefixes by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha_hex, table

OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
ESCAPE = (r"(<|\[)(\\*)(/?s>|/?INST\])", r"$1\\$2$3")
UNESCAPE = (r"(<|\[)\\(\\*)(/?s>|/?INST\])", r"$1$2$3")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, *ESCAPE)


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, *UNESCAPE)


def prefix_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """(conv, example, n_context, formatted, loss): ``loss`` has the start and end, in code points, of trainable text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
    whole = one.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    parts = whole.select(
        "conv",
        F.transform("t", lambda x: F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(MID), escaped(x["text"]), F.lit(CLOSE))).alias("parts"),
        F.transform("t", lambda x: F.length(escaped(x["text"]))).alias("size"),
        F.filter(F.transform("t", lambda x, i: F.when((x["role"] == target) | (i == F.size("t") - 1), i)), lambda i: i.isNotNull()).alias("ends"),
        F.transform("t", lambda x: x["role"] == target).alias("trained"),
    )
    cut = parts.select("conv", "parts", "size", "trained", F.posexplode("ends").alias("example", "end"))
    formatted = F.concat_ws("", F.slice("parts", F.lit(1), F.col("end") + 1))
    stop = F.length("formatted") - len(CLOSE)
    span = F.struct((stop - F.col("n")).alias("start"), stop.alias("end"))
    return (
        cut.select("conv", "example", F.col("end").alias("n_context"), formatted.alias("formatted"), F.element_at("size", F.col("end") + 1).alias("n"), F.element_at("trained", F.col("end") + 1).alias("train"))
        .select(F.col("conv").alias(conv), "example", "n_context", "formatted", F.when(F.col("train"), F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("loss"))
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs that a formatted string holds."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    at = lambda p: F.instr(p, MID.strip())
    return F.transform(
        turns,
        lambda p: F.struct(
            unescaped(F.substring(p, F.lit(len(OPEN) + 1), at(p) - 2 - len(OPEN))).alias("role"),
            unescaped(F.substring(p, at(p) + len(MID.strip()), F.length(p))).alias("text"),
        ),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    examples = prefix_examples(rows.unionByName(extra))
    in_loss = F.concat_ws("", F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))))
    by_conv = (
        examples.withColumn("in_loss", in_loss)
        .groupBy("conv_id")
        .agg(
            F.max_by("formatted", "example").alias("last"),
            F.sort_array(F.collect_list(F.struct("example", "in_loss"))).alias("l"),
            F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        )
        .select("conv_id", read_turns(F.col("last")).alias("t"), F.concat_ws("", F.col("l.in_loss")).alias("l"), "formatted_chars")
    )
    return by_conv.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        sha_hex(F.concat_ws("", F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        sha_hex(F.col("l")).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = {
    "op2_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, 22 + length(regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS of FROM c),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR k = of)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id"""
}

QUERIES = {"op2_chat_format": op2_chat_format}
