"""Event-sourced chat reconstruction and formatting, with DataFrame functions only.

A log holds events of conversations.  `message` begins a message (a further one starts it
anew), `delta` appends streamed text, `edit` replaces the text, `regenerate` discards it so
that the deltas behind it make it again.  Events are partitioned by conversation and message,
sorted by sequence and folded: the last event that sets the text counts, with the deltas
behind it.  Messages stand in the order of their first event.

The template writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts every control string of this and of the instruction-style templates gets a backslash
behind its first character, one more than stands there already, so the escape can be taken
back exactly; line feeds in roles are written as ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

START, END = "<|im_start|>", "<|im_end|>"
#: Fixed: the control strings, with any number of backslashes behind the first character.
_CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
_ESCAPE = (r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")
#: Which role's text is trained on.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE[0]), F.lit(_ESCAPE[1]))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE[0]), F.lit(_UNESCAPE[1]))


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    halves = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("\\n"), F.lit("\n"))), "\\")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message, first_seq, role, text): the final messages of a log.

    events: conv_id, message, seq, kind, role, text.  Null texts append nothing, the role is
    that of the last event that names one (else empty), events of other kinds change nothing,
    ties in seq go by kind, role and text, and repeated identical events count each.  A hot
    conversation is spread by message; only one message's events meet in one row.
    """
    rows = pick(events, "conv_id", "message", "seq", "kind", "role", "text")
    event = F.struct(F.col("seq"), F.col("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = rows.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i + 1).otherwise(0))
    last = F.greatest(F.lit(0), F.coalesce(F.array_max(resets), F.lit(0)))
    live = F.filter("log", lambda e, i: (i + 1 >= F.col("last")) & e["kind"].isin("message", "edit", "delta"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.withColumn("last", last).select(
        "conv_id",
        "message",
        F.get("log", F.lit(0))["seq"].alias("first_seq"),
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row per conversation, messages in order of first_seq and message."""
    turn = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    rows = pick(messages, "conv_id", "message", "first_seq", "role", "text").select("conv_id", F.struct("first_seq", "message", turn.alias("turn")).alias("at"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"))


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted) straight from the log; a null conv_id is a conversation of its own."""
    return render(reconstruct(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text, skip, length, width>>) from the text alone.

    skip, length and width are code points of the turn's part: before its text, its escaped
    text, and all of it.
    """
    rows = pick(formatted, "conv_id", "formatted")
    parts = F.slice(F.split(F.col("formatted"), r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(part: Column) -> Column:
        line = F.locate("\n", part)
        length = F.length(part) - line - F.lit(len(END) + 1)
        text = F.substring(part, line + 1, length)
        role = F.substring(part, F.lit(1), line - 1)
        return F.struct(_role_in(role).alias("role"), unescaped(text).alias("text"), (line + len(START)).alias("skip"), length.alias("length"), (F.length(part) + len(START)).alias("width"))

    return rows.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, begin, end): the loss mask over `formatted`, code points, end exclusive."""
    turns = read_back(formatted).select("conv_id", F.posexplode("turns").alias("turn", "t"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("t.width").over(before), F.lit(0)) + F.col("t.skip")
    spans = turns.select("conv_id", "turn", F.col("t.role").alias("role"), begin.alias("begin"), (begin + F.col("t.length")).alias("end"))
    return spans.where(F.col("role") == TRAINED).drop("role")


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask: each assistant text, unescaped, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == TRAINED), lambda t: t["text"])
