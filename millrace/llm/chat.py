"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. The log is partitioned by conversation, in one shuffle; there
streamed deltas, edits and regenerations are folded into final messages by their sequence, and the
messages are rendered and read back in order. A message at a time is in memory, whatever
a conversation's length. One conversation is one task's, as its digests are sequential.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of events.
#: message: a whole message. delta: text to append. edit: the text from now on. regenerate: the
#: message starts again from nothing. delete: the message goes.
KINDS = ("message", "delta", "edit", "regenerate", "delete")

#: Stands for a null turn, before all others.
NO_TURN = -(1 << 59)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What no text may hold unescaped: this template's marks and those of other common templates.
CONTROL = r"(?:/?s>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>)"
PLAIN = r"([<\[])(\\*)(?=" + CONTROL + ")"
ESCAPED = re.compile(r"([<\[])\\(\\*)(?=" + CONTROL + ")")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: Column) -> Column:
    """One more backslash after the first character of each control string, which ``unescaped`` takes away."""
    return F.regexp_replace(text, PLAIN, r"$1\\$2")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, role, text, first_seq) of a log of events.

    ``events``: conv_id, message_id, seq, kind, role, text. Events of a message are taken by seq.
    The text is that of the last message, edit or regenerate event, followed by the later deltas;
    a message whose last such event is a delete goes. The role is the first event's that has one.
    The result is partitioned by conversation, as ``read_back`` needs it.
    Null text is empty, a null or unknown kind counts as a message. Equal events of a message are one, as logs may
    deliver twice; of different events with the same seq, the order is by kind, role and text.
    A message stands where its first event stands. Null conv_id or message_id is an id like others.
    An empty log gives no messages.
    """
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.lit("message"))
    log = events.select("conv_id", "message_id", "seq", known.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    place = F.struct("seq", "kind", "role", "text")
    restart = F.col("kind") != "delta"
    # Partitioned by conversation, so that neither this aggregation nor reading back needs another shuffle.
    whole = log.repartition("conv_id").groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("role", F.when(F.col("role").isNotNull(), place)).alias("role"),
        F.sort_array(F.collect_set(F.when(~restart, place))).alias("deltas"),
        F.max(F.when(restart, place)).alias("base"),
    )
    later = F.filter("deltas", lambda d: F.col("base").isNull() | (d > F.col("base")))
    head = F.when(F.col("base.kind").isNull(), F.lit("")).otherwise(F.col("base.text"))
    text = F.concat(head, F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return whole.where(F.coalesce(F.col("base.kind"), F.lit("")) != "delete").select("conv_id", "message_id", "role", text.alias("text"), "first_seq")


def recorded(messages: DataFrame) -> DataFrame:
    """The log (conv_id, message_id, seq, kind, role, text) of events that a service would have kept of ``messages``: conv_id, turn, role, text.

    By a hash of its text a message comes at once, as three streamed deltas, as a draft that is regenerated and streamed
    anew, or as a draft that is extended and then edited. Each row is a message of its own, even where rows
    repeat; null texts are empty, null ids and roles stay, null turns come before all others; other columns are ignored; an empty table gives an empty log.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    cut = [F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, 2 * third + 1)]
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    deltas = [event("delta", x) for x in cut]
    ways = [
        [event("message", text)],
        [event("message", F.lit("")), *deltas],
        [event("message", cut[1]), event("delta", cut[0]), event("regenerate", F.lit("")), *deltas],
        [event("message", cut[0]), event("delta", cut[0]), event("edit", text)],
    ]
    way = F.pmod(F.xxhash64(text), F.lit(len(ways)))
    events = F.array(*ways[0])
    for k, steps in enumerate(ways):
        events = F.when(way == k, F.array(*steps)).otherwise(events)
    rows = messages.select("conv_id", F.monotonically_increasing_id().alias("message_id"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"), "role", events.alias("events"))
    rows = rows.select("conv_id", "message_id", "turn", "role", F.posexplode("events").alias("step", "event"))
    return rows.select("conv_id", "message_id", (F.col("turn") * 8 + F.col("step")).alias("seq"), F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``messages`` with ``rendered``: the message between the template's marks, its text escaped.

    A conversation's formatted text is its messages' in order of first_seq, then role and text. A
    null role is rendered as the empty string, a null text too; roles are escaped like texts, and their line feeds
    and percent signs as in addresses. Each row is taken by itself: repeated rows, ties and null ids stay;
    a column ``rendered`` is replaced; an empty table gives an empty one.
    """
    role = escaped(F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))
    body = escaped(F.coalesce("text", F.lit("")))
    return messages.withColumn("rendered", F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(f"{CLOSE}\n")))


def parse(rendered: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; the loss mask covers an assistant's text, marks excluded."""
    for m in TURN.finditer(rendered):
        yield unescaped(m[1]).replace("%0A", "\n").replace("%25", "%"), unescaped(m[2])


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation the digests of what its formatted text holds, parsed again from ``rendered``.

    ``rendered`` is what ``render`` makes of ``fold``'s messages: rows of a conversation share a
    partition. They are sorted by conversation; the digests grow with each message, so memory is one
    message's whatever a conversation's length. Messages with equal first_seq go by role and text;
    repeated ones count each; a null conv_id is one like others; an empty table gives an empty one.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        types, at, n, turns, loss, chars, size = None, (), 0, None, None, 0, 0

        def out() -> pa.RecordBatch:
            kinds = [types, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            types = batch.column(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != (conv,):
                    if at:
                        done.append([at[0], n, turns.hexdigest(), chars, loss.hexdigest(), size])
                    at, n, turns, loss, chars, size = (conv,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                text = text.as_py()
                size += len(text)
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        chars += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
            if len(done) >= 10_000:
                yield out()
        if at:
            done.append([at[0], n, turns.hexdigest(), chars, loss.hexdigest(), size])
            yield out()

    rows = rendered.select("conv_id", "first_seq", "role", "rendered").sortWithinPartitions("conv_id", "first_seq", "role", "rendered")
    return rows.select("conv_id", "rendered").mapInArrow(digest, f"conv_id {kind}, {DIGESTS}")
