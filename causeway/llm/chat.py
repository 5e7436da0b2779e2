"""Chat formatting by event-sourced reconstruction.

A log of events, partitioned by conversation and ordered by sequence, is folded into final messages: ``message`` gives a
whole message, ``open`` begins an empty one, ``delta`` adds to one as it is streamed, ``edit`` puts other text in its place,
``regenerate`` throws its text away for the deltas that follow. The messages are rendered with a template and a loss mask over assistant texts, written to
the shared folder, and can be parsed back from there.

The fold is relational: the last event that resets a message decides which of its pieces count, so a long conversation is
spread over tasks by message. Only the parser reads a conversation in order; it is streamed and holds one message at a time.

Null texts and roles are empty. Of events of one message with equal sequence, deltas follow what resets the message, and go by text; of several that reset it the one
of the greatest text counts. A null conversation is one of
its own. An empty log gives no rows. Texts of any length are kept whole; columns beside the named ones are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import files

#: The template's control strings: fixed values.
START, END = "<|im_start|>", "<|im_end|>"
PARSED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(x: Column) -> Column:
    """No control string is left in the result; ``unescape`` undoes it."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: str) -> str:
    if "\\" not in x:
        return x
    out, it = [], iter(x)
    for c in it:
        out.append(next(it) if c == "\\" else c)
    return "".join(out)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, role, text) of events (conv_id, msg, seq, kind, role, text). place: the seq of a message's first event."""
    w = Window.partitionBy("conv_id", "msg")
    kept = (
        events.withColumn("_reset", F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(w))
        .withColumn("_first", F.min("seq").over(w))
        .where("_reset is null or seq >= _reset")
    )
    piece = F.struct("seq", (F.col("kind") == "delta").alias("d"), F.coalesce("text", F.lit("")).alias("t"))
    last = F.max(F.when(F.col("kind") != "delta", piece))
    return (
        kept.groupBy("conv_id", "msg")
        .agg(
            F.min("_first").alias("place"),
            F.min_by(F.coalesce("role", F.lit("")), F.struct("seq", F.coalesce("role", F.lit("")))).alias("role"),
            last.alias("_last"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", piece))).alias("_deltas"),
        )
        .select("conv_id", "place", "role", F.concat(F.coalesce("_last.t", F.lit("")), F.array_join(F.transform("_deltas", lambda p: p["t"]), "")).alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """``messages`` as formatted turns, each with the spans (start, chars) of its text under the loss mask."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    mask = F.when(F.col("role") == "assistant", F.array(F.struct(F.char_length(head).cast("long").alias("start"), F.char_length(body).cast("long").alias("chars"))))
    return messages.select("conv_id", "place", F.concat(head, body, F.lit(END + "\n")).alias("formatted"), F.coalesce(mask, F.array().cast("array<struct<start:bigint,chars:bigint>>")).alias("loss"))


def write(events: DataFrame) -> str:
    """Folds, renders and writes; gives the new table's folder in the shared folder."""
    at = files.fresh(X.shared_dir(events.sparkSession), "chat")
    render(fold(events)).write.mode("overwrite").parquet(at)
    return at


def _turn(x: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (x.startswith(START) and x.endswith(END + "\n")):
        raise ValueError("a turn's marks are missing")
    x = x[len(START) : -len(END) - 1]
    if "<|" in x:
        raise ValueError("a control string is inside a turn")
    at = x.find("\n")
    while (at - len(x[:at].rstrip("\\"))) % 2:  # an escaped line end belongs to the role
        at = x.find("\n", at + 1)
    return unescape(x[:at]), unescape(x[at + 1 :])


def parse(spark, folder: str) -> DataFrame:
    """One row per conversation of the written table, from its formatted turns alone."""
    n = X.parts(spark)
    rows = spark.read.parquet(folder).repartition(n, "conv_id").sortWithinPartitions("conv_id", "place", "formatted").select("conv_id", "formatted", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, [[] for _ in range(6)]

        def put() -> None:
            for col, v in zip(out, (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
                col.append(v)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], PARSED_NAMES)
            for c in out:
                c.clear()
            return made

        for x in batches:
            for conv, text, loss in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                if now != (conv,):
                    if now:
                        put()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = _turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    masked = unescape(text[s["start"] : s["start"] + s["chars"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(out[0]) > 1000:
                yield batch()
        if now:
            put()
        yield batch()

    return rows.mapInArrow(run, PARSED)


PARSED_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """The log that a table of turns (conv_id, turn, role, text) came from: every turn is a message with several events.

    An assistant's message is opened, streamed as a delta, thrown away for a regeneration and streamed again in three deltas;
    another's is a draft, a delta, and the edit that puts the final text in its place. Rows of one turn are a message each, by role and text.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("msg", F.struct("turn", F.row_number().over(same).alias("row")))
    n = F.char_length("text")
    cut = [F.lit(0), F.floor(n / 3), F.floor(2 * n / 3), n]
    part = lambda i: F.substring("text", cut[i] + 1, cut[i + 1] - cut[i])
    none = F.lit(None).cast("string")
    event = lambda i, kind, said: F.struct(F.lit(i).alias("k"), F.lit(kind).alias("kind"), said.alias("text"))
    streamed = F.array(event(0, "open", none), event(1, "delta", part(1)), event(2, "regenerate", none), *(event(3 + i, "delta", part(i)) for i in range(3)))
    edited = F.array(event(0, "message", part(0)), event(1, "delta", part(2)), event(2, "edit", F.col("text")))
    log = rows.select("conv_id", "msg", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", "msg", F.struct("msg.turn", "msg.row", "e.k").alias("seq"), "e.kind", "role", "e.text")
