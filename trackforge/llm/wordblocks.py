"""A token stream as blocks with local dictionaries.

A block is a run of documents of about ``block_bytes`` of text within one input partition. It
holds its distinct words once, dealt to buckets by their hash, and each position as the word's
number. Work for each word then needs one packed message per block and bucket instead of a row
per occurrence, whatever the length of a text or the frequency of a word. Replies come back by
block, in the order of the words asked about.

Blocks are written before they are used, so that block and word numbers can't change when a task
runs again, as a table bucketed by block: only messages and replies are shuffled, not the stream.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.llm.common import bounded_batches, delete_path, leave, shared_dir

BLOCK_BYTES = 8_000_000
MESSAGE = "block long, bucket int, n int, size int, words binary, counts binary"
_SEP = b"\xff"  # in no UTF-8 text


class _Numbered(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def pack_wide(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**64."""
    v = values.astype("<u8")
    return pack(np.concatenate([v & 0xFFFFFFFF, v >> 32]))


def unpack_wide(packed: bytes, n: int) -> np.ndarray:
    v = unpack(packed, 2 * n).astype(np.uint64)
    return v[:n] | (v[n:] << np.uint64(32))


def unpack_words(packed: bytes, size: int) -> list[bytes]:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).split(_SEP)


def whole(values: pa.Array) -> pa.Array:
    """One list that holds them all."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


#: Bytes of the tables read for each bucket of words, so that what one task gathers doesn't grow with the input.
BUCKET_BYTES = 256 << 20


def buckets_of(docs: DataFrame, text: str) -> int:
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # a table that isn't read from files says nothing of its size, or a bound near 2 ** 63
    read = sum(sizes) if max(sizes, default=0) < 1 << 62 else docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(read // BUCKET_BYTES, 1 << 20))


def word_blocks(docs: DataFrame, split: Callable[[str], list], *, doc_id: str, text: str, flag: F.Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written table of blocks: block, docs (ids), flags, lens (words per document), codes
    (packed word numbers), order (packed: the number of each word in the order of the messages),
    and messages (bucket, n, size, words, counts of each word in documents whose flag is true).

    split gives a text's words (str, or bytes of valid UTF-8). A null text is an empty one.
    """
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), (F.lit(True) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"))
    message = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(d.schema["id"].dataType)), T.StructField("flags", T.ArrayType(T.BooleanType())), T.StructField("lens", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.BinaryType()), T.StructField("order", T.BinaryType()), T.StructField("messages", T.ArrayType(message))])
    n_buckets = buckets_of(docs, text)

    def dealt(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True) if len(order) else ():
            own = _SEP.join([words[i] for i in order[a:b].tolist()])
            for to, v in zip(rows, (int(bucket[order[a]]), b - a, len(own), pa.compress(own, codec="zstd", asbytes=True), pack_wide(counts[order[a:b]])), strict=True):
                to.append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return order, pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], ["bucket", "n", "size", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held = TaskContext.get().partitionId() << 32, 0, []
        numbered, size = _Numbered(), 0
        id_type = None

        def flush() -> pa.RecordBatch:
            lens = np.array([len(c) for _, c, _ in held], np.int32)
            flags = [f for _, _, f in held]
            codes = np.concatenate([c for _, c, _ in held])
            by_use = np.argsort(-np.bincount(codes, minlength=len(numbered)), kind="stable")  # low numbers for frequent words: they pack well
            rank = np.empty(len(by_use), np.uint32)
            rank[by_use] = np.arange(len(by_use), dtype=np.uint32)
            codes = rank[codes]
            names = list(numbered)
            words = [names[i] for i in by_use.tolist()]
            if words and isinstance(words[0], str):
                words = [w.encode() for w in words]
            order, messages = dealt(words, np.bincount(codes[np.repeat(np.array(flags, bool), lens)], minlength=len(words)))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + n], pa.int64()), whole(pa.array([i for i, _, _ in held], id_type)), whole(pa.array(flags, pa.bool_())), whole(pa.array(lens, pa.int32())), pa.array([pack(codes)], pa.binary()), pa.array([pack(order)], pa.binary()), whole(messages)],
                ["block", "docs", "flags", "lens", "codes", "order", "messages"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, flags, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            for i, at in enumerate(ids):
                own = texts[i].as_py() or ""
                words = split(own)
                held.append((at, np.fromiter(map(numbered.__getitem__, words), np.uint32, len(words)), flags[i]))
                size += len(own)
                if size >= block_bytes:
                    yield flush()
                    held, numbered, size, n = [], _Numbered(), 0, n + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield flush()

    return bucketed(d.mapInArrow(run, schema), "block", "blocks")


def bucketed(df: DataFrame, by: str, name: str, *, codec: str = "snappy") -> DataFrame:
    """df, written to the shared folder as a table bucketed by a column, which the scope() it was made in drops. What is large is
    packed already, as a rule: hence the light codec."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(spark, path)

    leave(drop)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with bounded_batches(spark):
        df.write.bucketBy(parts, by).format("parquet").option("compression", codec).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._drop = drop  # for one that nothing reads any more
    return out


def messages_of(blocks: DataFrame) -> DataFrame:
    """block, bucket, n, size, words, counts: a row for each bucket of each block."""
    return blocks.select("block", F.explode("messages").alias("m")).select("block", "m.*")


def reply_order(block: dict, replies: list[np.ndarray]) -> np.ndarray:
    """Replies, in the order of the messages, by word number."""
    values = np.concatenate(replies) if replies else np.zeros(0)
    out = np.zeros_like(values)
    out[unpack(block["order"], len(values))] = values
    return out
