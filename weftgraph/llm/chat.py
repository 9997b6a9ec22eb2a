"""Chat formatting by a grammar round trip. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar:  chat = { asked | answered };  asked = "[INST] " role "\n" text " [/INST]";  answered = "<s> " text " </s>"
# In an escaped text, a control string has a backslash more after its first character than in the source.
_CONTROL = r"([\[<])(\\*)(/?(?:INST\]|s>))"
_ESCAPED = r"([\[<])\\(\\*)(/?(?:INST\]|s>))"
_BARE = r"\[/?INST\]|</?s>"
_TURN = r"(?s)\[INST\] .*?\n.*? \[/INST\]|<s> .*? </s>"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def _role_out(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(c: Column) -> Column:
    """Undo _role_out: a backslash pair stands for one, a backslash and n for a line break."""
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    """One turn; role and text as they are to stand there."""
    return F.when(role == LEARNED, F.concat(F.lit("<s> "), text, F.lit(" </s>"))).otherwise(F.concat(F.lit("[INST] "), role, F.lit("\n"), text, F.lit(" [/INST]")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted chat: array<struct<role, text>>, read from left to right."""

    def turn(x: Column) -> Column:
        asked = F.substring_index(x, "\n", 1)
        learned = F.startswith(x, F.lit("<s> "))
        role = F.when(learned, F.lit(LEARNED)).otherwise(unescape(_role_in(asked.substr(F.lit(8), F.length(asked)))))
        skip = F.when(learned, F.lit(4)).otherwise(F.length(asked) + 1)
        end = F.when(learned, F.lit(5)).otherwise(F.lit(8))
        return F.struct(role.alias("role"), unescape(x.substr(skip + 1, F.length(x) - skip - end)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), 0), turn)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_spans, turns, escaped, round_trip.

    Turns stand in order of (turn, role, text), a null turn first; null roles and texts are empty; a
    turn repeated in the table is repeated in the chat. Null conversation ids are one conversation;
    an empty table gives no rows. One conversation is one string and so one row; a conversation's
    turns must fit in it.

    Each turn is rendered as it is, parsed again and compared; where that turn differs, or holds a
    bare control string, its text and role are escaped. The whole chat is then parsed, and one
    that doesn't give its source's turns again gets all its turns escaped, which makes the grammar
    unambiguous. turns: what the final parse gives; round_trip: whether it equals the source.
    loss_spans: start and length, in code points, of the assistant's texts in `formatted`, as escaped.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = F.struct("role", "text")
    raw = render(_role_out(F.col("role")), F.col("text"))
    conflict = ~parse(raw).eqNullSafe(F.array(given)) | F.col("text").rlike(_BARE) | F.col("role").rlike(_BARE)
    safe = render(_role_out(escape(F.col("role"))), escape(F.col("text")))
    rows = rows.withColumns({"_safe": safe, "_conflict": conflict})
    rows = rows.withColumn("_first", F.when(F.col("_conflict"), F.col("_safe")).otherwise(raw))
    item = F.struct("turn", "role", "text", F.col("_first").alias("first"), F.col("_safe").alias("safe"), F.col("_conflict").cast("int").alias("conflict"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("_t"))
    source = F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    first = F.array_join(F.col("_t.first"), "")
    chats = chats.withColumns({"_source": source, "_first": first})
    chats = chats.withColumn("_same", parse(F.col("_first")).eqNullSafe(F.col("_source")))
    parts = F.when(F.col("_same"), F.col("_t.first")).otherwise(F.col("_t.safe"))
    chats = chats.withColumn("_parts", parts).withColumn("formatted", F.array_join("_parts", "")).withColumn("turns", parse(F.col("formatted")))
    step = F.aggregate(
        "_parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(F.startswith(p, F.lit("<s> ")), F.concat(s["spans"], F.array(F.struct((s["at"] + 4).alias("start"), (F.length(p) - 9).alias("length"))))).otherwise(s["spans"]).alias("spans")),
    )
    escaped = F.when(F.col("_same"), F.aggregate("_t.conflict", F.lit(0), lambda n, x: n + x)).otherwise(F.size("_t"))
    return chats.select("conv_id", "formatted", step["spans"].alias("loss_spans"), "turns", escaped.alias("escaped"), F.col("turns").eqNullSafe(F.col("_source")).alias("round_trip"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped: each span of the formatted chat in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
