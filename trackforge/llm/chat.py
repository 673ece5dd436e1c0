"""Chat formatting from an event log.

A log holds events of conversations: a message starts a turn, deltas append to it, an edit puts
another text in its place, a regeneration empties it (deltas follow), a deletion takes it out. The
log is partitioned by conversation and sorted by (conversation, turn, seq), so one pass folds it
with one open message in memory; Spark's sort spills. Messages are rendered turn by turn:

    <|im_start|>role\\ntext<|im_end|>\\n

A backslash in a role or text becomes two, "<|" becomes "<\\|" and a line end in a role "\\n"; so control strings never occur
inside, and unescape() gives the original back.

Defined results: null roles and texts are empty; every "message" event is a turn of its own, also
where turn numbers repeat (ties are ordered by seq, kind, role, text); other events before a
turn's message start one with an empty role; unknown kinds raise; empty tables give none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, MARK = "<|im_start|>", "<|im_end|>\n", "<|"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return "\\".join(x.replace("<\\|", "<|") for x in s.split("\\\\"))


def render(role: str, text: str, trained_role: str) -> tuple[str, int, int]:
    """A turn's chunk and its loss span within it (start = end: none)."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == trained_role else 0)


def parse(chunk: str) -> tuple[str, str]:
    """(role, text) of one rendered turn."""
    if not (chunk.startswith(START) and chunk.endswith(END)):
        raise ValueError("not a turn")
    head, _, body = chunk[len(START) : -len(END)].partition("\n")
    if MARK in head or MARK in body:
        raise ValueError("a control string inside a turn")
    return _role(head), unescape(body)


def _role(head: str) -> str:
    return "\\".join(x.replace("\\n", "\n").replace("<\\|", "<|") for x in head.split("\\\\"))


def sorted_log(log: DataFrame, conv: str, turn: str) -> DataFrame:
    d = log.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return d.repartition("conv").sortWithinPartitions("conv", "turn", "seq", "kind", "role", "text")


def fold(log: DataFrame, *, conv: str = "conv_id", turn: str = "turn", trained_role: str = "assistant") -> DataFrame:
    """conv, n (position of the final message in its conversation, from 0), chunk (rendered), loss_start,
    loss_end (code points within the chunk): one row per final message, in order within partitions.

    log: conv, turn, seq, kind (message, delta, edit, regenerate, delete), role, text.
    """
    d = sorted_log(log, conv, turn)
    schema = T.StructType([T.StructField("conv", d.schema["conv"].dataType), T.StructField("n", T.LongType()), T.StructField("chunk", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, message, kind_of = (), 0, None, None

        def close() -> None:
            nonlocal n, message
            if message and message[1] is not None:
                out.append((now[0], n, *render(message[0], "".join(message[1]), trained_role)))
                n += 1
            message = None

        out: list = []
        for b in batches:
            kind_of = b.schema.field("conv").type
            for c, t, kind, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "turn", "kind", "role", "text")), strict=True):
                if (c, t) != now or kind == "message":
                    close()
                    if not now or c != now[0]:
                        n = 0
                    now = (c, t)
                if kind == "message":
                    message = [role, [text]]
                    continue
                message = message or [role, []]
                if kind == "delta":
                    message[1] = message[1] or []
                    message[1].append(text)
                elif kind == "edit":
                    message[1] = [text]
                elif kind == "regenerate":
                    message[1] = [text] if text else []
                elif kind == "delete":
                    message[1] = None
                else:
                    raise ValueError(f"unknown kind {kind}")
            if out:
                yield _batch(out, kind_of)
                out = []
        close()
        if out:
            yield _batch(out, kind_of)

    return d.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def _batch(rows: list, kind) -> pa.RecordBatch:
    c, n, chunk, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array(n, pa.int64()), pa.array(chunk, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["conv", "n", "chunk", "loss_start", "loss_end"])


def format_conversations(log: DataFrame, *, conv: str = "conv_id", turn: str = "turn", trained_role: str = "assistant") -> DataFrame:
    """conv, text (the whole conversation as one string) and loss (array of [start, end) code
    points in it that are learnt from)."""
    f = fold(log, conv=conv, turn=turn, trained_role=trained_role)
    g = f.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("n", "chunk", "loss_start", "loss_end"))).alias("t"))
    text = F.concat_ws("", F.transform("t", lambda x: x["chunk"]))
    step = F.aggregate("t", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("s")), lambda a, x: F.struct(
        (a["at"] + F.length(x["chunk"])).alias("at"),
        F.when(x["loss_end"] > x["loss_start"], F.concat(a["s"], F.array(F.struct((a["at"] + x["loss_start"]).alias("start"), (a["at"] + x["loss_end"]).alias("end"))))).otherwise(a["s"]).alias("s")))
    return g.select(conv, text.alias("text"), step["s"].alias("loss"))


def read_back(turns: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: digests of what the
    rendered turns say when parsed. turns: fold()'s rows, still in its order."""
    schema = T.StructType([T.StructField("conv", turns.schema[conv].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out, kind = None, [], None

        def close():
            if open_:
                out.append((open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5]))

        def batch():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for c, chunk, s, e in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if not open_ or c != open_[0]:
                    close()
                    open_ = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(chunk)
                learnt = unescape(chunk[s:e])
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(learnt)
                open_[4].update(learnt.encode())
                open_[5] += len(chunk)
            if out:
                yield batch()
                out = []
        close()
        if out:
            yield batch()

    return turns.select(F.col(conv).alias("conv"), "chunk", "loss_start", "loss_end").mapInArrow(run, schema).withColumnRenamed("conv", conv)
