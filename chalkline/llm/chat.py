"""Chat logs folded into messages and rendered with a reversible template and a loss mask.

A log holds events per conversation, ordered by their sequence number:

- ``open`` starts a message with a role (a text given with it is its beginning),
- ``delta`` adds streamed text to its message,
- ``edit`` replaces the text of its message,
- ``regenerate`` discards the text of its message, which then streams anew, and every later
  message of the conversation that was opened before it.

Everything is column expressions, windows and aggregates: the last replacing event of a message is found by
a window, what follows it is joined in order, and the template is string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Opening and closing mark per role; any other role is named in its opening mark.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "]", "[/ROLE]")
#: Characters that marks are made of, and the escape itself, which must come first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;")]
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the final messages of a log.

    ``events`` is (conv_id, seq, kind, message, role, text); ``message`` numbers a conversation's messages
    in their order. Null texts add nothing. Events with equal seq are taken by kind and text; events that are repeated row by row
    count as often as they occur. A message without an ``open`` event has role null; unknown kinds are ignored.
    Null conv_ids form one conversation. Other columns are ignored.
    """
    log = events.where(F.col("kind").isin("open", "delta", "edit", "regenerate")).select(
        "conv_id", "message", "role", "kind", F.coalesce("text", F.lit("")).alias("text"),
        F.struct(F.col("seq").alias("seq"), F.when(F.col("kind") == "open", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3).alias("rank"), F.coalesce("text", F.lit("")).alias("text")).alias("at"),
    )
    own = Window.partitionBy("conv_id", "message")
    replaced = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at"))).over(own)
    live = log.withColumn("from", replaced)
    counts = F.col("from").isNull() | (F.col("at") >= F.col("from"))
    part = F.when(counts & (F.col("kind") != "regenerate"), F.struct("at", "text"))
    messages = live.groupBy("conv_id", "message").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "").alias("text"),
        F.max(F.when(F.col("kind") == "open", F.col("role"))).alias("role"),
        F.min("at.seq").alias("opened"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("at.seq"))).alias("redone"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("redone").over(before)
    return messages.withColumn("cut", cut).where(
        F.col("cut").isNull() | (F.col("opened") > F.col("cut"))
    ).select("conv_id", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): a conversation as one text, and the spans of it that carry loss.

    ``loss`` is array<struct<start, length>> in code points, one span per assistant message, ordered. A null role is
    the empty name; the text of a role outside the template is kept under its name.
    """
    role = F.coalesce("role", F.lit(""))
    opening = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    closing = F.lit(OTHER[2])
    for name, (start, end) in MARKS.items():
        opening, closing = F.when(role == name, F.lit(start)).otherwise(opening), F.when(role == name, F.lit(end)).otherwise(closing)
    turns = messages.select(
        "conv_id", "message", (role == LEARNED).alias("learned"), opening.alias("opening"),
        escape(F.coalesce("text", F.lit(""))).alias("body"), closing.alias("closing"),
    ).withColumn("turn", F.concat("opening", "body", "closing"))
    order = Window.partitionBy("conv_id").orderBy("message")
    start = F.sum(F.length("turn")).over(order) - F.length("turn") + F.length("opening")
    placed = turns.withColumn("span", F.when(F.col("learned"), F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message", "turn"))), lambda t: t["turn"]), "").alias("formatted"),
        F.sort_array(F.collect_list("span")).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the messages a formatted conversation holds."""
    known = "|".join(rf"\Q{a}\E" for a, _ in MARKS.values())
    mark = rf"(?:{known}|\[ROLE [^\[\]<]*\])"
    # the text of a turn has no bracket of any kind, so the next one is the closing mark
    heads = F.regexp_extract_all(formatted, F.lit(rf"({mark})[^\[<]*+(?:<</SYS>>|</s>|\[/INST\]|\[/ROLE\])"), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(rf"{mark}([^\[<]*+)(?:<</SYS>>|</s>|\[/INST\]|\[/ROLE\])"), F.lit(1))

    def role(head: Column) -> Column:
        out = unescape(F.substring(head, len(OTHER[0]) + 1, F.length(head) - len(OTHER[0]) - len(OTHER[1])))
        for name, (start, _) in MARKS.items():
            out = F.when(head == start, F.lit(name)).otherwise(out)
        return out

    return F.zip_with(heads, bodies, lambda h, b: F.struct(role(h).alias("role"), unescape(b).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def turns_as_events(turns: DataFrame) -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text): each row opens a message and streams
    its text in deltas of 512 characters. Rows of a conversation that share a turn are separate
    messages, by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.withColumn("message", F.row_number().over(order).cast("long"))
    size = 512
    cuts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(F.coalesce("text", F.lit(""))) - 1, F.lit(0)) / size).cast("int"))
    # sequence numbers leave room for 2**31 deltas per message
    at = F.shiftleft(F.col("message"), 31)
    opened = numbered.select("conv_id", at.alias("seq"), F.lit("open").alias("kind"), "message", "role", F.lit(None).cast("string").alias("text"))
    deltas = numbered.select("conv_id", "message", "text", at.alias("at"), F.explode(cuts).alias("k")).select(
        "conv_id", (F.col("at") + 1 + F.col("k")).alias("seq"), F.lit("delta").alias("kind"), "message",
        F.lit(None).cast("string").alias("role"), F.substring("text", F.col("k") * size + 1, F.lit(size)).alias("text"),
    )
    return opened.unionByName(deltas)
