"""Bytes covered by a string of 200 bytes that starts in two places, by sparse suffix sorting.

Every window of 200 bytes has an anchor: the place of its 24-byte string with the smallest hash, the
first of equals. Equal windows have equal anchors at equal offsets, so only suffixes at anchors need
sorting, about one place in 88, and only those whose 24 bytes stand at another anchor, too.

1. Texts are packed in blocks with their anchors, a table bucketed by block.
2. Anchors' hashes are counted over the corpus; those that stand alone are dropped.
3. Each other anchor's context (the windows it is the anchor of) goes to a bucket of hashes, once for
   each different context of a block. There the suffixes to the right and the reversed prefixes to the
   left are sorted by deep-shallow sorting. Runs of neighbours that share enough on either side give
   each window's class; a class of two windows or more repeats. Classes are told apart by bytes alone.
4. A hash with more than HOT contexts (a passage or line in very many surroundings) would make a
   large group. Its windows are dealt out by a 128-bit digest of the window itself instead and counted.
5. Repeated windows go back to their blocks, which remove the union of what they cover.

Null texts are empty, without windows, as is any text below 200 bytes. Repeated rows are texts that
repeat each other. Ids may be null or repeat: a row's place in its block tells it apart. Matches don't cross
documents. Removing bytes can cut a character: ``kept`` is binary. Empty tables give no rows. Other columns
are not read by repeats(); without_repeats() passes them on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.llm.common import Scratch, bounded_batches, unused
from trackforge.llm.deepshallow import deep_shallow
from trackforge.llm.wordblocks import bucketed, whole

LENGTH = 200
BLOCK_BYTES = 4_000_000
#: Bytes of an anchor; windows' starts that are looked at at once.
ANCHOR, CHUNK = 24, 1 << 17
#: Contexts of all hashes of a bucket, some 12 MB in a task; a hash with more of its own than that is hot.
BUCKET_ENTRIES = HOT = 20_000
_POS = np.uint64((1 << 20) - 1)


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (8 at least) from each place on."""
    n = max(len(data) - k + 1, 0)
    if not n:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for at in [*range(0, k - 8, 8), k - 8]:
        out ^= words[at : at + n]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(29)
    return out


def anchors(data: np.ndarray, lens: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(pos, first, last, hash): each anchor of a block, and the first and last start of its windows."""
    ends = np.cumsum(lens)
    marks = np.zeros(len(data) + 1, np.int32)
    long = lens >= length
    np.add.at(marks, (ends - lens)[long], 1)
    np.add.at(marks, (ends - length + 1)[long], -1)
    inside = np.cumsum(marks[:-1], dtype=np.int32) > 0
    w = length - k + 1
    out: list[list[np.ndarray]] = [[], [], [], []]
    for s0 in range(0, max(len(data) - length + 1, 0), CHUNK):
        starts = min(CHUNK, len(data) - length + 1 - s0)
        here = np.flatnonzero(inside[s0 : s0 + starts])
        if not len(here):
            continue
        full = _hashes(data[s0 : s0 + starts + length - 1], k)
        low = (full & ~_POS) | np.arange(len(full), dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: starts], low[w - size : w - size + starts])
        p = (low[here] & _POS).astype(np.int64)
        cut = np.flatnonzero(np.diff(p, prepend=-1))
        last = np.append(cut[1:], len(p)) - 1
        for to, v in zip(out, (p[cut] + s0, here[cut] + s0, here[last] + s0, full[p[cut]]), strict=True):
            to.append(v)
    pos, first, last, h = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.uint64), strict=True))
    new = np.diff(pos, prepend=-1) != 0  # chunks cut an anchor's windows in two
    return pos[new], first[new], last[np.append(np.flatnonzero(new)[1:], len(pos)) - 1] if len(pos) else last, h[new].view(np.int64)


def text_blocks(docs: DataFrame, length: int, k: int, *, doc_id: str, text: str) -> DataFrame:
    """block, ids, lens, data, pos, first, last, h (packed)."""
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"))
    packed = ("data", "pos", "first", "last", "h")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(d.schema["id"].dataType)), T.StructField("lens", T.ArrayType(T.LongType())), *[T.StructField(c, T.BinaryType()) for c in packed]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy()
            number = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
            for lo, hi in zip(c := [0, *(np.flatnonzero(np.diff(number)) + 1).tolist()], [*c[1:], len(sizes)], strict=True) if len(sizes) else ():
                own = b"".join(batch.column(1).slice(lo, hi - lo).to_pylist())
                lens = sizes[lo:hi].astype(np.int64)
                pos, first, last, h = anchors(np.frombuffer(own, np.uint8), lens, length, k)
                small = [pa.array([v.tobytes()], pa.binary()) for v in (pos.astype(np.int32), (pos - first).astype(np.uint16), (pos - last).astype(np.uint16), h)]
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), whole(batch.column(0).slice(lo, hi - lo)), whole(pa.array(lens)), pa.array([own], pa.binary()), *small], schema.names)
                n += 1

    return bucketed(d.mapInArrow(run, schema), "block", "texts", codec="zstd")


class Block:
    """A row of text_blocks: its text and anchors."""

    def __init__(self, row: dict, length: int):
        self.block, self.data, self.length = row["block"], row["data"], length
        self.pos = np.frombuffer(row["pos"], np.int32).astype(np.int64)
        self.high, self.low = (np.frombuffer(row[c], np.uint16).astype(np.int64) for c in ("first", "last"))  # of a window: its anchor's offset
        self.h = np.frombuffer(row["h"], np.int64)

    def context(self, i: int) -> bytes:
        return self.data[self.pos[i] - self.high[i] : self.pos[i] - self.low[i] + self.length]

    def alike(self) -> tuple[np.ndarray, np.ndarray]:
        """(of, n): for each anchor, the first in the block with its hash and context; how many there are."""
        of = np.arange(len(self.pos))
        order = np.argsort(self.h, kind="stable")
        seen: dict[tuple[int, int, bytes], int] = {}
        for i in order[_paired(self.h[order])].tolist():
            of[i] = seen.setdefault((self.h[i], self.high[i], self.context(i)), i)
        return of, np.bincount(of, minlength=len(of))


def _paired(sorted_values: np.ndarray) -> np.ndarray:
    """Which of them have an equal beside them."""
    out = np.zeros(len(sorted_values), bool)
    same = sorted_values[1:] == sorted_values[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _ranks(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, common = deep_shallow(rows, group)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank, common


def _repeated(length: int):
    """Which windows of the contexts of a bucket stand in another context, or twice in one block."""

    def run(table: pa.Table) -> pa.Table:
        h, high, low, n = (table.column(c).to_numpy() for c in ("h", "high", "low", "n"))
        texts = table.column("context").to_pylist()
        data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        anchor = start + high
        group = np.unique(h, return_inverse=True)[1]
        width = -(-length // 8) * 8
        steps = np.arange(width)
        right = np.where(steps < (start + size - anchor)[:, None], data[np.minimum(anchor[:, None] + steps, len(data) - 1)], 0).astype(np.uint8)
        rank_r, common_r = _ranks(group, right)
        del right
        left = np.where(steps < high[:, None], data[np.maximum(anchor[:, None] - 1 - steps, 0)], 0).astype(np.uint8)
        rank_l, common_l = _ranks(group, left)
        del left
        found = np.zeros((len(h), -(-length // 8) * 8), bool)
        for i in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
            at = np.flatnonzero((low <= i) & (i <= high))
            cls = np.cumsum(common_r < length - i)[rank_r[at]] * (len(h) + 1) + np.cumsum(common_l < i)[rank_l[at]]
            by = np.argsort(cls, kind="stable")
            found[at[by[_paired(cls[by])]], i] = True
        hit = np.flatnonzero(found.any(1) & (n == 1))
        marks = [m.tobytes() for m in np.packbits(found[hit], axis=1)]
        return pa.table({"block": table.column("block").take(pa.array(hit)), "at": table.column("at").take(pa.array(hit)), "marks": pa.array(marks, pa.binary())})

    return run


def repeats(docs: DataFrame, length: int = LENGTH, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: maximal runs of repeated bytes), kept (the others)."""
    if length < 8:
        raise ValueError("strings of 8 bytes at least")
    spark, k = docs.sparkSession, min(ANCHOR, max(8, length // 4))
    scratch = Scratch(spark, "suffixes")
    with bounded_batches(spark, 2 * BLOCK_BYTES):
        return _repeats(docs, scratch, length, k, doc_id, text)


def _repeats(docs: DataFrame, scratch: Scratch, length: int, k: int, doc_id: str, text: str) -> DataFrame:
    blocks = text_blocks(docs, length, k, doc_id=doc_id, text=text)
    own = blocks.select("block", "data", "pos", "first", "last", "h")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, length)
                of, _ = b.alike()
                h, n = np.unique(b.h[np.unique(of)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b.block)), pa.array(h), pa.array(n)], ["block", "h", "n"])

    counted = own.mapInArrow(contexts, "block long, h long, n long")
    shared = scratch.write(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    sorted_here = F.col("n") <= HOT
    warm = shared.where(sorted_here).agg(F.sum("n")).first()[0] or 0
    of_block = counted.select("block", "h").join(shared, "h").groupBy("block").agg(F.collect_list(F.struct("h", sorted_here.alias("warm"))).alias("shared"))
    of_block = scratch.write(of_block)

    def entries(hot: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    wanted = np.array([x["h"] for x in row["shared"] if x["warm"] != hot], np.int64)
                    if not len(wanted):
                        continue
                    b = Block(row, length)
                    of, n = b.alike()
                    at = np.flatnonzero(np.isin(b.h, wanted) & (of == np.arange(len(of))))
                    for lo in range(0, len(at), 2000):
                        yield windows(b, at[lo : lo + 2000], n) if hot else sent(b, at[lo : lo + 2000], n)

        return run

    def sent(b: Block, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = (np.full(len(at), b.block), at, b.h[at], b.high[at].astype(np.int32), b.low[at].astype(np.int32), np.minimum(n[at], 2).astype(np.int32))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([b.context(i) for i in at.tolist()], pa.binary())], ["block", "at", "h", "high", "low", "n", "context"])

    def windows(b: Block, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(p - hi, p - lo + 1) for p, hi, lo in zip(b.pos[at].tolist(), b.high[at].tolist(), b.low[at].tolist(), strict=True)]])
        digest = np.frombuffer(b"".join(hashlib.blake2b(b.data[s : s + length], digest_size=16).digest() for s in starts.tolist()), np.int64).reshape(-1, 2)
        times = np.repeat(np.minimum(n[at], 2), b.high[at] - b.low[at] + 1)
        return pa.RecordBatch.from_arrays([*map(pa.array, (np.full(len(starts), b.block), starts, digest[:, 0].copy(), digest[:, 1].copy(), times))], ["block", "start", "w1", "w2", "n"])

    asked = own.join(of_block, "block")
    buckets = max(1, -(-int(warm) // BUCKET_ENTRIES))
    told = asked.where(F.exists("shared", lambda x: x["warm"])).mapInArrow(entries(False), "block long, at long, h long, high int, low int, n int, context binary")
    told = told.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).applyInArrow(_repeated(length), "block long, at long, marks binary")
    told = told.groupBy("block").agg(F.collect_list(F.struct("at", "marks")).alias("marked"))
    hot = asked.where(F.exists("shared", lambda x: ~x["warm"]))
    if shared.where(~sorted_here).limit(1).count():
        seen = scratch.write(hot.mapInArrow(entries(True), "block long, start long, w1 long, w2 long, n long"))
        twice = seen.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
        starts = seen.where("n = 1").join(twice, ["w1", "w2"]).groupBy("block").agg(F.collect_list("start").alias("starts"))
    else:
        starts = docs.sparkSession.createDataFrame([], "block long, starts array<long>")
    told, starts = scratch.write(told), scratch.write(starts)

    kind = blocks.schema["ids"].dataType.elementType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(doc_id, kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for r, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                b, data = Block(row, length), np.frombuffer(row["data"], np.uint8)
                marks = np.zeros(len(data) + 1, np.int32)

                def cover(starts: np.ndarray, ends: np.ndarray, marks=marks) -> None:
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, ends, -1)

                of, n = b.alike()
                twice = n[of] > 1
                cover((b.pos - b.high)[twice], (b.pos - b.low)[twice] + length)
                for x in row["marked"] or ():
                    s = b.pos[x["at"]] - np.flatnonzero(np.unpackbits(np.frombuffer(x["marks"], np.uint8)))
                    cover(s, s + length)
                s = np.array(row["starts"] or [], np.int64)
                cover(s, s + length)
                gone = np.cumsum(marks[:-1]) > 0
                lens = np.array(row["lens"], np.int64)
                ends = np.cumsum(lens)
                edge = np.zeros(len(data) + 1, bool)
                edge[0] = edge[ends] = True
                edge[1:-1] |= gone[1:] != gone[:-1]
                at = np.flatnonzero(edge)
                runs, upto = at[:-1], at[1:]
                here = gone[runs] if len(data) else np.zeros(0, bool)
                runs, upto = runs[here], upto[here]
                of_doc = np.searchsorted(ends, runs, side="right")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of_doc, minlength=len(lens)))]).astype(np.int32)
                begin = (ends - lens)[of_doc]
                spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(runs - begin), pa.array(upto - begin)], ["start", "end"]))
                kept = [row["data"][e - m : e] if not gone[e - m : e].any() else data[e - m : e][~gone[e - m : e]].tobytes() for e, m in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids[r].values, pa.array(lens), spans, pa.array(kept, pa.binary())], schema.names)

    return blocks.join(told, "block", "left").join(starts, "block", "left").mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, *, text: str = "text") -> DataFrame:
    """docs, less the repeated bytes of their texts; what is left of a character that lost some of its bytes becomes U+FFFD.
    Rows are told apart by their own columns packed into one, so ids may be null or repeat."""
    (name,) = unused(docs.columns, "row")
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias(name), text)
    out = repeats(packed, length, doc_id=name, text=text)
    return out.select(*[F.col(name)[c].alias(c) if c != text else F.make_valid_utf8(F.col("kept").cast("string")).alias(text) for c in docs.columns])
