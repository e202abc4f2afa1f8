"""Operator 10: chat formatting with a grammar round trip (native SQL functions only).

Grammar of a formatted conversation (NL is a line feed)::

    conversation := turn*
    turn         := "[INST] " role " [/INST]" NL text NL "</s>" NL

Control strings are ``[INST]``, ``[/INST]`` and ``</s>``; one after a backslash is content.
A conversation is first rendered with its texts as they are and parsed back.  When the
recovered turns differ from the source, or a control string stands where the grammar has
none, every control string inside a role or text gets one backslash more in front of it (the
parser takes one away again), and the result is parsed and compared once more.  The template
puts a line feed or a space between content and its own control strings, so content that ends
in a backslash cannot hide them.  ``round_trip`` tells whether the output parses back to the
source and holds three control strings a turn.

Null text and null role count as empty, null turns come first, rows that tie on the turn are
ordered by role and text, repeated rows stay as repeated turns, a null conversation id is a
conversation of its own, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import col, table, text_or_empty

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_ANY = r"(?:\[INST\]|\[/INST\]|</s>)"
#: the end of a turn: its line feed, the end mark, and the line feed that follows
_TURN_END = r"\n</s>\n"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"(\\*{_ANY})", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"\\(\\*{_ANY})", "$1")


def _render(turns: Column, how) -> Column:
    return F.concat_ws("", F.transform(turns, lambda x: F.concat(
        F.lit(f"{OPEN} "), how(x["role"]), F.lit(f" {CLOSE}\n"), how(x["text"]), F.lit(f"\n{END}\n"))))


def parse(formatted: Column) -> Column:
    """Formatted string -> array of (role, text, raw, start): the turns as read back, the text
    as it stands in the string and its 1-based position in code points."""
    pieces = F.split(formatted, _TURN_END)
    # the string after the last end mark is empty and no turn
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = rf"(?s)^\[INST\] (.*?) (?<!\\)\[/INST\]\n"
    parts = F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, head, 1).alias("role"),
        F.regexp_replace(p, head, "").alias("raw"),
        F.length(p).alias("len"),
        F.length(F.regexp_extract(p, head, 0)).alias("head")))
    mark = len(f"\n{END}\n")
    zero = F.struct(F.lit(1).alias("at"), F.array().cast(
        "array<struct<role:string,text:string,raw:string,start:int>>").alias("out"))
    return F.aggregate(parts, zero, lambda a, x: F.struct(
        (a["at"] + x["len"] + mark).alias("at"),
        F.concat(a["out"], F.array(F.struct(
            unescape(x["role"]).alias("role"), unescape(x["raw"]).alias("text"), x["raw"].alias("raw"),
            (a["at"] + x["head"]).alias("start")))).alias("out")), lambda a: a["out"])


def _same(formatted: Column, parsed: Column, turns: Column) -> Column:
    pair = lambda a: F.transform(a, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    marks = F.regexp_count(formatted, F.lit(rf"(?<!\\){_ANY}"))
    return (marks == 3 * F.size(turns)) & (pair(parsed) == pair(turns))


def format_conversations(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``parsed`` (the turns read back
    from it), ``loss_mask`` (array of start and length, 1-based code points of the assistant
    texts inside ``formatted``), ``escaped`` and ``round_trip``."""
    rows = conv.select(col(conv_col).alias("conv_id"), F.struct(
        col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"),
        text_or_empty(text_col).alias("text")).alias("t"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    plain = one.withColumn("f0", _render(F.col("turns"), lambda c: c))
    plain = plain.withColumn("p0", parse(F.col("f0")))
    tried = plain.withColumn("escaped", ~_same(F.col("f0"), F.col("p0"), F.col("turns")))
    out = tried.withColumn("formatted", F.when(F.col("escaped"), _render(F.col("turns"), escape))
                           .otherwise(F.col("f0")))
    out = out.withColumn("parsed", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("p0")))
    spans = F.transform(F.filter("parsed", lambda x: x["role"] == LOSS_ROLE), lambda x: F.struct(
        x["start"].alias("start"), F.length(x["raw"]).alias("len")))
    return out.select("conv_id", "formatted", "parsed", spans.alias("loss_mask"), "escaped",
                      _same(F.col("formatted"), F.col("parsed"), F.col("turns")).alias("round_trip"))


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, read back from the formatted string and its loss mask."""
    loss = F.concat_ws("", F.transform("loss_mask", lambda m: unescape(
        F.substring(F.col("formatted"), m["start"], m["len"]))))
    text = F.concat_ws("", F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    step = formatted.withColumn("loss_text", loss)
    return step.select("conv_id", F.size("parsed").cast("long").alias("n_turns"),
                       F.sha2(text, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "round_trip")


#: Conversation -1 of the query: both of its texts are made of control strings.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE_TEXT).alias("text"))
    return digests(format_conversations(conv.unionByName(probe)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, role || chr(10) || text || chr(10) AS piece,
         length(role) + length(text) AS n,
         len(regexp_extract_all(role, '\[INST\]|\[/INST\]|</s>')) + len(regexp_extract_all(text, '\[INST\]|\[/INST\]|</s>')) AS marks
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(piece, '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(marks) > 0 AS escaped, sum(n) AS n, sum(marks) AS marks FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256,
       (n + 22 * n_turns + marks)::BIGINT AS formatted_chars,
       escaped, TRUE AS round_trip
FROM g
"""
