"""Chat formatting from event logs: streamed deltas, edits and regenerations fold into final messages.

Native: DataFrame functions only. An event is ``(conv_id, seq, message, kind, role, text)``.
``delta`` appends its text to its message; ``edit`` replaces what the message held; ``regenerate``
voids its message and every later one, and starts it anew with its own text. Events count in the
order of ``seq``, then kind (delta, edit, regenerate), role and text. Folding needs two windows: the
last edit of a message, and the last regeneration of it or of an earlier message; what came before
either in that order is dropped and the rest is joined.

The template writes ``[INST] role [/INST]text</s>`` for every turn. A control string inside a role or
text gets ``\\!`` after its first character, and a backslash is doubled, so that reading back is exact.

Edge cases: a null role or text is empty; a null ``conv_id`` is a conversation of its own; of events with
equal ``seq`` an edit or regeneration voids the deltas, and the last one in the order above counts;
repeated deltas append each, repeated edits and regenerations count once; messages that are voided and
not written again are gone; columns of other names are ignored, whatever they are called; an empty log
gives no rows. A conversation, with whatever long texts it holds, is one row of the result and has to
fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks (fixed values). All are searched for literally.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\!" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def folded(events: DataFrame) -> DataFrame:
    """``(conv_id, message, role, text)``: the messages that the log leaves, one row each."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    events = events.select("conv_id", "message", F.struct("seq", "kind", role, text).alias("event"))
    conversation, message = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "message")
    edit = F.max(F.when(F.col("event.kind") == "edit", F.col("event"))).over(message)
    anew = F.max(F.when(F.col("event.kind") == "regenerate", F.col("event"))).over(conversation.orderBy("message").rangeBetween(Window.unboundedPreceding, 0))
    live = events.withColumn("since", F.greatest(edit, anew)).where("since is null or event >= since")
    parts = live.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("event")).alias("parts"))
    # of what is left, at most the first in order is an edit or regeneration: further ones are its repeats
    parts = parts.withColumn("parts", F.filter("parts", lambda x, k: (k == 0) | (x["kind"] == "delta")))
    return parts.select("conv_id", "message", F.element_at("parts", -1)["role"].alias("role"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: the text of each conversation and where assistant texts stand in it.

    Spans are ``[start, length]`` in characters from 0.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE))
    turns = messages.select("conv_id", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("chars", (F.char_length("head") + F.char_length("body") + len(END)).cast("long"))
    turns = turns.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.char_length("head"))
    one = F.struct("message", "role", F.concat("head", "body", F.lit(END)).alias("turn"), "start", F.char_length("body").cast("long").alias("length"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def formatted(events: DataFrame) -> DataFrame:
    return rendered(folded(events))


def read_back(chats: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text)`` from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split(F.expr(f"substring(formatted, 1, char_length(formatted) - {len(END)})"), END)
    pattern = r"(?s)^\[INST\] (.*?) \[/INST\](.*)$"
    turns = F.transform(pieces, lambda x: F.struct(unescaped(F.regexp_extract(x, pattern, 1)).alias("role"), unescaped(F.regexp_extract(x, pattern, 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda x: unescaped(F.substring("formatted", (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as the log of a chat client: every row, repeats too, is a message, by turn.

    A text arrives as two streamed deltas. What a user types first is its first half, which an edit then
    replaces; an assistant's first attempt breaks off after its first half and is regenerated.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("head", F.substring("text", F.lit(1), half)).withColumn("tail", F.substring("text", half + 1, F.char_length("text")))
    event = lambda n, kind, text: F.struct((F.col("message") * 4 + n).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    delta = lambda n, c: event(n, "delta", F.col(c))
    asked = F.array(delta(0, "head"), event(1, "edit", F.col("head")), delta(2, "tail"))
    said = F.array(delta(0, "head"), event(1, "regenerate", F.lit("")), delta(2, "head"), delta(3, "tail"))
    log = F.when(F.col("role") == "assistant", said).otherwise(asked)
    return rows.select("conv_id", "message", "role", F.inline(log)).select("conv_id", "seq", "message", "kind", "role", "text")
