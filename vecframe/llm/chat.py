"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: the formatted conversation up to
and with that turn, of which only the reply's text is trainable.

A turn is written ``<s>[INST]role[/INST]text</s>``.  Inside roles and texts
a backslash, ``<`` and ``[`` become ``\\e``, ``\\l`` and ``\\b``, so no control
string can come from data, and the escape is reversible.

Turns are ordered by turn, then role, then text; repeated rows are
repeated turns; null role or text is empty; null conv_id is a conversation
of its own.  A conversation without assistant turns has no examples; other
columns aren't read; an empty table gives an empty one.  A conversation is one
value, as its formatted text is; the expansion itself is done row by row, so a task
holds one prefix at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"
#: Character and its escape, in the order of escaping.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, replies: array of
    (example, turn_end, loss_start, loss_end), offsets in code points from 0."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # the running length is a window by the key of the grouping after it, so there is one exchange
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    rows = rows.select("conv_id", piece.alias("s"), F.char_length(escape(F.col("text"))).alias("n"), F.sum(F.char_length(piece)).over(order).cast("int").alias("end"), (F.col("role") == ASSISTANT).alias("a"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("end", "s", "n", "a"))).alias("p"))
    stop = lambda t: t.end - len(CLOSE)
    reply = lambda t, i: F.struct(i.alias("example"), t.end.alias("turn_end"), (stop(t) - t.n).alias("loss_start"), stop(t).alias("loss_end"))
    return got.select("conv_id", F.array_join(F.transform("p", lambda t: t.s), "").alias("formatted"), F.transform(F.filter("p", lambda t: t.a), reply).alias("replies"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row an example: conv_id, example, text, loss_start, loss_end.

    Conversations without replies give a row whose example is null."""
    rows = formatted.select("conv_id", "formatted", F.explode_outer("replies").alias("r"))
    return rows.select("conv_id", "formatted", F.col("r.example").alias("example"), F.substring("formatted", F.lit(1), F.col("r.turn_end")).alias("text"), F.col("r.loss_start").alias("loss_start"), F.col("r.loss_end").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation was made from."""
    parts = F.filter(F.split(formatted, F.lit(CLOSE), F.lit(-1)), lambda x: x != "")
    role = lambda x: unescape(F.substring(F.substring_index(x, MIDDLE, 1), F.lit(len(OPEN) + 1), F.length(x)))
    text = lambda x: unescape(F.substring(x, F.length(F.substring_index(x, MIDDLE, 1)) + len(MIDDLE) + 1, F.length(x)))
    return F.transform(parts, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))


def digest(turns: DataFrame) -> DataFrame:
    """What op3 returns, all of it read back from the examples and formatted texts."""
    ex = expand(format_conversations(turns))
    reply = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    # rows of a conversation are together since the first grouping, so this one needs no exchange
    one = ex.groupBy("conv_id").agg(F.first("formatted").alias("f"), F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", reply.alias("reply"))))).alias("r"))
    one = one.withColumns({"t": read_turns(F.col("f")), "loss": F.array_join(F.transform("r", lambda x: x.reply), "")})
    plain = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return one.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("f").cast("long").alias("formatted_chars"),
    )


#: The same rows by DuckDB, from the tables alone.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(replace(replace(replace(role || text, '\', '\e'), '<', '\l'), '[', '\b'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
