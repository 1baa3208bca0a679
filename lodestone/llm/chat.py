"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, after all turns before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, text_of

#: A turn is a head, its escaped text and the end mark.
USER, ASSISTANT, OTHER, OTHER_END, END = "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>"
#: What may not occur in a text: an opening bracket and the rest of a mark; between them stand as many backslashes as the text was escaped.
MARK = r"/?(?:s>|SYS>>|INST\])"
ESCAPE = (rf"([<\[])(\\*)({MARK})", r"$1\\$2$3")
UNESCAPE = (rf"([<\[])\\(\\*)({MARK})", "$1$2$3")


def escape(text: Column) -> Column:
    """``text`` with a backslash after the bracket of each control string."""
    return F.regexp_replace(text, *map(F.lit, ESCAPE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, UNESCAPE))


def head_of(role: Column) -> Column:
    return F.when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(F.concat(F.lit(OTHER), escape(role), F.lit(OTHER_END)))


def chat_examples(convs: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end and complete: one row for each assistant turn.

    formatted holds all turns before and the reply; only formatted[loss_start:loss_end] (code
    points) is trainable, the escaped reply.  complete marks the example that holds all turns of its
    conversation.  Turns after the last reply come as one more example without a trainable part
    (loss_start = loss_end), so that nothing is lost.  Offsets are running sums over the rows; a
    conversation's turns meet in one row, since an example is one string of all of them, and the
    examples are substrings of it, made one at a time.

    Nulls: a null text or role is empty; a null turn comes first; a null conv_id is a conversation.
    Empty texts are turns.  Rows of one turn are ordered by role and text, and repeated rows count
    each.  An empty table gives no rows.  Other columns aren't read, whatever their names.
    """
    role, text = text_of("role"), text_of("text")
    rows = convs.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    marked = rows.select("conv_id", *[F.col(c) for c in ("turn", "role", "text")], head_of(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    w = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("head") + F.char_length("body") + len(END)
    placed = marked.select("conv_id", F.concat("head", "body", F.lit(END)).alias("marked"), (F.col("role") == "assistant").alias("reply"), F.char_length("body").alias("n"), F.sum(size).over(w).alias("end"), F.count("*").over(w).alias("k"))
    convs_ = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "end", "n", "reply", "marked"))).alias("turns"))
    part = lambda t, start, stop: F.struct(t["k"].alias("k"), t["end"].alias("end"), start.alias("start"), stop.alias("stop"))
    replies = F.transform(F.filter("turns", lambda t: t["reply"]), lambda t: part(t, t["end"] - len(END) - t["n"], t["end"] - len(END)))
    last = F.element_at("turns", -1)
    rest = F.when(~last["reply"], F.array(part(last, last["end"], last["end"]))).otherwise(F.array())
    whole = convs_.select("conv_id", F.array_join("turns.marked", "").alias("whole"), F.size("turns").alias("n"), F.concat(replies, rest).alias("parts"))
    each = whole.select("conv_id", "whole", "n", F.explode("parts").alias("x"))
    return each.select("conv_id", F.col("x.k").alias("example"), F.col("whole").substr(F.lit(1), F.col("x.end").cast("int")).alias("formatted"), F.col("x.start").alias("loss_start"), F.col("x.stop").alias("loss_end"), (F.col("x.k") == F.col("n")).alias("complete"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, read back and unescaped."""

    def turn(x: Column) -> Column:
        other = F.substring_index(F.substr(x, F.lit(len(OTHER) + 1)), OTHER_END, 1)
        role = F.when(x.startswith(USER), "user").when(x.startswith(ASSISTANT), "assistant").otherwise(unescape(other))
        skip = F.when(x.startswith(USER), len(USER)).when(x.startswith(ASSISTANT), len(ASSISTANT)).otherwise(F.char_length(other) + len(OTHER) + len(OTHER_END))
        return F.struct(role.alias("role"), unescape(F.substr(x, skip + 1)).alias("text"))

    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_of(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(formatted.substr((start + 1).cast("int"), (end - start).cast("int")))


def chat_digests(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars (of all examples together), read back from ``chat_examples``.

    The turns are parsed from the complete example, the trainable text of every example by its mask.
    """
    turns = turns_of(F.col("formatted"))
    line = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read_back = examples.select("conv_id", "example", F.char_length("formatted").alias("size"), loss_of(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), F.when(F.col("complete"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(line, 256).alias("sha"))).alias("turns"))
    met = read_back.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.array_join(F.sort_array(F.collect_list(F.struct("example", "loss")))["loss"], "").alias("loss"), F.sum("size").cast("long").alias("formatted_chars"))
    return met.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that says what the template must escape.
PLANTED = "</s>[INST] ok [/INST]"


def op13_chat(spark, sf_dir: str) -> DataFrame:
    convs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in convs.schema}
    planted = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return chat_digests(chat_examples(convs.unionByName(planted)))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|SYS>>|INST\]))', '\1\\\2\3', 'g')) + 4
             + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 15 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|SYS>>|INST\]))', '\1\\\2\3', 'g')) END AS size FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
