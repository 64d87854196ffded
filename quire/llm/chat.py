"""Chat texts from event logs: final messages by event sourcing, then a template with a loss mask.

A log has rows ``conv_id, seq, kind, turn, sub, role, text``. A message is named by
its conversation and its place ``(turn, sub)``. Events of a conversation in the order of
``seq`` change its messages:

* ``message`` starts the message anew with a role and a text;
* ``delta`` appends a streamed piece of text;
* ``edit`` replaces the text;
* ``regenerate`` takes back the message and all later turns, which are then
  written again by the events that follow.

The fold is relational, so a conversation with most of the rows is no task of its
own: what an event still counts for depends only on the last reset of its message
and on the last regeneration at or before its turn. The pieces that are left are
put together message by message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
PIECE = 512
PART_CHARS = 1_000_000


def final_messages(log: DataFrame) -> DataFrame:
    """``conv_id, turn, sub, role, text``: the messages that the log leads to.

    Null texts and roles count as empty. A null ``conv_id`` is a conversation of
    its own, a null ``turn`` comes before all others, and so does a null ``seq``.
    Events of equal ``seq`` are ordered by kind (resets first), role and text. A delta
    without a message starts one; its role is that of the message's last event that
    has one. Repeated rows are repeated events. Extra columns are ignored.
    """
    low = -(2**63)
    rank = F.when(F.col("kind") == "delta", 1).otherwise(0)
    events = log.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("bigint"), F.lit(low)).alias("turn"),
        F.coalesce(F.col("sub").cast("bigint"), F.lit(0)).alias("sub"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(low)).alias("seq"),
        rank.alias("rank"),
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    again = events.filter("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("undo"))
    messages = events.groupBy("conv_id", "turn", "sub").agg(F.max(F.when(F.col("kind").isin("message", "edit"), F.col("seq"))).alias("reset"))
    # Only conversations with a regeneration need the running maximum: narrow rows, one per message.
    undone = messages.join(again.select("conv_id").distinct(), messages.conv_id.eqNullSafe(again.conv_id), "left_semi")
    before = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, 0)
    cut = (
        undone.select("conv_id", "turn", "sub", F.lit(None).cast("bigint").alias("undo"))
        .unionByName(again.select("conv_id", "turn", F.lit(None).cast("bigint").alias("sub"), "undo"))
        .select("conv_id", "turn", "sub", F.max("undo").over(before).alias("undo"))
        .filter("sub is not null and undo is not null")
    )
    same = lambda a, b: a.conv_id.eqNullSafe(b.conv_id) & (a.turn == b.turn) & (a.sub == b.sub)
    limits = messages.join(cut, same(messages, cut), "left").select(messages["*"], "undo")
    live = (
        events.join(limits, same(events, limits), "left")
        .select(events["*"], "reset", "undo")
        .filter("(undo is null or seq > undo) and kind <> 'regenerate'")
    )
    piece = F.struct("seq", "rank", "role", "text")
    folded = live.groupBy("conv_id", "turn", "sub").agg(
        F.array_sort(F.collect_list(F.when(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")), piece))).alias("e"),
        F.max(F.when(F.col("role") != "", F.struct("seq", "rank", "role"))).alias("named"),
    )
    # Of several resets at one place of the log the last one holds.
    last = F.expr("coalesce(array_max(transform(e, (x, i) -> if(x.rank = 0, i, 0))), 0)")
    return folded.withColumn("last", last).select(
        "conv_id",
        F.when(F.col("turn") != low, F.col("turn")).alias("turn"),
        "sub",
        F.coalesce("named.role", F.lit("")).alias("role"),
        F.expr("array_join(slice(e, last + 1, size(e)).text, '')").alias("text"),
    )


def escaped(text: Column) -> Column:
    """No control string is left: ``<|`` gets a backslash inside, and so does what looks like it already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "\\|" in text else text


def escaped_role(role: Column) -> Column:
    """The same for a role, which also must not end its line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: str) -> str:
    import re

    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def rendered(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, sub, formatted, loss_start, loss_end``: each message in the template.

    The formatted conversation is the concatenation of its messages by ``turn, sub``. The
    loss mask is the range of code points of ``formatted`` that hold an
    assistant's escaped text; it is null for other roles.
    """
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "turn", "sub", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    learned = F.col("role") == LEARNED
    return parts.select(
        "conv_id",
        "turn",
        "sub",
        F.concat("head", "body", F.lit(f"{END}\n")).alias("formatted"),
        F.when(learned, F.length("head")).alias("loss_start"),
        F.when(learned, F.length("head") + F.length("body")).alias("loss_end"),
    )


def formatted(log: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, formatted, loss``: whole conversations in parts of bounded size.

    Parts of a conversation in order, joined by nothing, are its formatted text;
    a part ends behind the message that reaches ``part_chars``, so nearly all
    conversations are one part. ``loss`` has the masked ranges of the part, in code
    points. A conversation is streamed through one task, sorted; memory holds one
    part. A log without events gives no rows.
    """
    rows = rendered(final_messages(log)).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "sub")
    conv = rows.schema["conv_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        out, room, now, part = [], 0, None, 0
        pieces, loss, size, begun = [], [], 0, False
        for batch in batches:
            for r in batch.to_pylist():
                if begun and (r["conv_id"] != now or size >= part_chars):
                    out.append({"conv_id": now, "part": part, "formatted": "".join(pieces), "loss": loss})
                    room += size
                    part = part + 1 if r["conv_id"] == now else 0
                    pieces, loss, size = [], [], 0
                    if room >= part_chars:
                        yield flush()
                        out, room = [], 0
                now, begun = r["conv_id"], True
                if r["loss_start"] is not None:
                    loss.append({"start": size + r["loss_start"], "end": size + r["loss_end"]})
                pieces.append(r["formatted"])
                size += len(r["formatted"])
        if begun:
            out.append({"conv_id": now, "part": part, "formatted": "".join(pieces), "loss": loss})
        yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"conv_id {conv}, part long, formatted string, loss array<struct<start:long,end:long>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(pack, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from formatted parts.

    Parses the template; only the running digests of a conversation are held.
    """
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, out = None, None, []

        def close() -> None:
            out.append({"conv_id": now, "turns_sha256": state["turns"].hexdigest(), "loss_sha256": state["loss"].hexdigest()} | {k: state[k] for k in ("n_turns", "loss_chars", "formatted_chars")})

        for batch in batches:
            for r in batch.to_pylist():
                if state is not None and r["conv_id"] != now:
                    close()
                    state = None
                if state is None:
                    now = r["conv_id"]
                    state = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                whole = r["formatted"]
                state["formatted_chars"] += len(whole)
                for turn in whole.split(START)[1:]:
                    role, body = turn.removesuffix(f"{END}\n").split("\n", 1)
                    state["n_turns"] += 1
                    state["turns"].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                for mask in r["loss"]:
                    text = unescape(whole[mask["start"] : mask["end"]])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        if state is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(parse, schema)


def as_log(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """A log of finished conversations as a stream would have sent them: a start, then deltas.

    ``seq`` counts within a message. Rows of one conversation and turn are messages of their own, by role and text.
    """
    tie = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("sub", F.row_number().over(tie))
    cut = F.expr(
        f"transform(sequence(0, cast(ceil(coalesce(length(text), 0) / {piece}) as int)),"
        f" i -> if(i = 0, '', substring(text, (i - 1) * {piece} + 1, {piece})))"
    )
    return rows.select("conv_id", "turn", "sub", "role", F.posexplode(cut).alias("seq", "text")).select(
        "conv_id", "seq", F.when(F.col("seq") == 0, "message").otherwise("delta").alias("kind"), "turn", "sub", "role", "text"
    )
