r"""Chat formatting by event sourcing: logs are folded into final messages, messages are rendered with a loss mask.

An event log has conv_id, seq, message_id, event, role, text. Events: 'delta' appends its text to the message, 'edit'
replaces the message's text, 'regenerate' empties it (later deltas fill it anew) and removes every message that began
after it and before the regeneration. A message stands where its first event stands.

Rendering writes <|im_start|>role\ntext<|im_end|>\n for each message. Inside texts a backslash is doubled and <| becomes
<\|, so that no text can hold a marker; roles also write a newline as <\n>. unescaped() is the exact inverse.
loss_spans are the half-open UTF-8 byte ranges of the assistant texts in the output.

Defined results: null text and role are empty; a null conv_id is a conversation of its own; events with equal seq are
all taken, ordered by event and text; an empty log gives no row; a conversation is one row, so its rendered text is one
cell, while deltas are folded by (conversation, message) before conversations meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, position (seq of the first event), message_id, role, text."""
    reset = F.col("event").isin("edit", "regenerate")
    rank = F.when(F.col("event") == "regenerate", 0).when(F.col("event") == "edit", 1).otherwise(2)
    messages = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("position"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.max(F.when(reset, F.struct(F.col("seq"), rank.alias("rank")))).alias("reset"),
        F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.array_sort(F.collect_list(F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")))).alias("parts"),
    )
    live = F.filter("parts", lambda p: (p["rank"] > 0) & (F.col("reset").isNull() | (F.struct(p["seq"], p["rank"]) >= F.col("reset"))))
    text = F.array_join(F.transform(live, lambda p: p["text"]), "")
    earlier = Window.partitionBy("conv_id").orderBy("position", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max("regenerated").over(earlier) > F.col("position"), F.lit(False))
    return messages.select("conv_id", "position", "message_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), gone.alias("gone")).where(~F.col("gone")).drop("gone")


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans (array of start and length in UTF-8 bytes)."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    parts = messages.withColumns({"head": head, "body": escaped(F.col("text"))})
    parts = parts.withColumn("block", F.concat("head", "body", F.lit(END + "\n")))
    so_far = Window.partitionBy("conv_id").orderBy("position", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("block")).over(so_far), F.lit(0)) + F.octet_length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("long").alias("start"), F.octet_length("body").cast("long").alias("length")))
    turns = parts.select("conv_id", F.struct("position", "message_id", "block", span.alias("span")).alias("turn"))
    out = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of role and text, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, k: k > 0)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 2 - len(END))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    raw = F.encode(formatted, "UTF-8")
    cut = F.transform(spans, lambda s: unescaped(F.decode(F.substr(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    return F.array_join(cut, "")
