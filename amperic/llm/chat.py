"""Chat formatting from event logs, in DataFrame operations only.

A conversation is a log of events in sequence: ``start`` opens a message with a
role, ``delta`` appends text, ``edit`` replaces the text, ``regenerate`` empties a
message and voids all that came after it so far, ``delete`` takes a message out.
Folding the log gives the final messages. They are rendered with marked turns,
and control strings inside texts are escaped so that they can be read back.

Rules for odd input: a NULL text or role is empty; an unknown kind counts as
``delta``. Events of one message with the same sequence number are ordered by
kind, then text. A message without ``start`` has the role ``""``. Other columns
are ignored. An empty log gives an empty table. A NULL conversation or message
number is a conversation or message of its own. A conversation is one row of
output, so it is put together in one task and must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template's control strings.
OPEN, OPEN_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
RESETS = ("start", "edit", "regenerate", "delete")


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_events(rows: DataFrame) -> DataFrame:
    """Events of finished conversations: rows of ``conv_id``, ``turn``, ``role``, ``text``.

    Rows of one turn follow each other by role, then text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = F.row_number().over(order).cast("long")
    return rows.select(
        "conv_id", number.alias("seq"), number.alias("message"), F.lit("start").alias("kind"), "role", "text"
    )


def streamed_events(rows: DataFrame) -> DataFrame:
    """The log that a client might have written of the same conversations.

    Every text comes in three deltas, cut without regard to what it says. Before that,
    even messages are drafted, the next message is begun on that draft, and both are
    voided as the message is regenerated; odd messages begin with a wrong text that an
    edit replaces. After each message a further one is begun and deleted.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("n"))
    n, text, none = F.col("n"), F.col("text"), F.lit(None).cast("string")
    own, size = n * 2, F.length(text)
    first, second = (size / 3).cast("int"), (size * 2 / 3).cast("int")
    draft = F.concat(F.lit("draft of "), F.reverse(text))
    even = n % 2 == 0

    def event(step: int, message, kind, role, said) -> Column:
        parts = {"seq": n * 16 + step, "message": message, "kind": kind, "role": role, "text": said}
        return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()])

    events = F.array(
        event(0, own, "start", F.col("role"), F.when(even, none).otherwise(draft)),
        event(1, own, "delta", none, draft),
        event(2, F.when(even, own + 2).otherwise(own + 1), "start", F.lit("early"), draft),
        event(3, own, F.when(even, F.lit("regenerate")).otherwise(F.lit("edit")), none, F.when(even, draft).otherwise(F.lit(""))),
        event(4, own, "delta", none, F.substr(text, F.lit(1), first)),
        event(5, own, "delta", none, F.substr(text, first + 1, second - first)),
        event(6, own, "delta", none, F.substr(text, second + 1, size - second)),
        event(7, own + 1, "start", F.lit("aside"), draft),
        event(8, own + 1, "delete", none, none),
    )
    return rows.select("conv_id", F.inline(events))


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id``, ``message``, ``role``, ``text``: the messages that a log ends with.

    Voided events go first. Of the rest, a message's text is that of its last
    reset and the deltas after it.
    """
    log = events.select(
        "conv_id", F.col("seq").cast("long"), F.col("message").cast("long"), "kind",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    earlier = W.partitionBy("conv_id").orderBy("message").rangeBetween(W.unboundedPreceding, -1)
    log = log.withColumn("void", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
    log = log.filter(F.col("void").isNull() | (F.col("seq") > F.col("void")))
    own = W.partitionBy("conv_id", "message")
    resets = F.col("kind").isin(*RESETS)
    log = log.withColumn("reset", F.max(F.when(resets, F.struct("seq", "kind", "text"))).over(own))
    log = log.withColumn("opened", F.max(F.when(F.col("kind") == "start", F.struct("seq", "role"))).over(own))
    after = F.col("reset").isNull() | (F.struct("seq", "kind", "text") >= F.col("reset"))
    # a regenerated message starts empty, whatever text its event carries
    piece = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(resets, 0).otherwise(1).alias("late"), "kind", piece.alias("text"))))
    folded = log.filter(after).groupBy("conv_id", "message").agg(
        F.first("reset").alias("reset"), F.first("opened").alias("opened"), parts.alias("parts")
    )
    folded = folded.filter(F.col("reset").isNull() | (F.col("reset.kind") != "delete"))
    return folded.select(
        "conv_id", "message", F.coalesce("opened.role", F.lit("")).alias("role"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss``: spans of code points (start, end)
    that hold the texts of ``loss_role``."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(OPEN_END))
    rows = messages.withColumns({"head": head, "body": escaped(F.col("text"))})
    rows = rows.withColumn("size", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
    order = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("begin", F.sum("size").over(order) - F.col("size") + F.length("head"))
    span = F.struct("begin", (F.col("begin") + F.length("body")).alias("end"))
    turn = F.struct("begin", F.concat("head", "body", F.lit(CLOSE)).alias("turn"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: structs of role and text."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def turn(piece: Column) -> Column:
        role, text = (F.element_at(F.split(piece, r"\[/INST\]", -1), k) for k in (1, 2))
        return F.struct(unescaped(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), ""
    )
