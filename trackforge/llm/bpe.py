"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Texts are cut into pre-tokens by the tokenizer's pattern; positions stay with their block
(wordblocks), the distinct pre-tokens of all blocks are shuffled by their hash, each is merged to
ids once, and the ids are joined back to their block, where the stream is put together again by
position. Decoding looks the ids
up in the token-byte table (as many entries as the vocabulary, sent to the executors).

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows, repeated
ids and null ids give one result per input row; an empty table gives none; other columns are
ignored. Special-token strings within a text are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.llm.wordblocks import messages_of, pack, unpack, unpack_words, word_blocks


PIECE = 500_000  # positions put together at once
LONG = 200  # bytes from which a pre-token's pairs are kept in a heap
NONE = 1 << 62  # stands for the rank of a pair that isn't a token


class Vocabulary:
    """Ranks of a tiktoken file and the pattern of its pre-tokens; small enough to send along."""

    def __init__(self, path: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.pattern = pattern
        self._split = None

    def __getstate__(self):
        return self.__dict__ | {"_split": None}

    def split(self, text: str) -> list[str]:
        self._split = self._split or regex.compile(self.pattern)
        return self._split.findall(text)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of neighbours whose union has the lowest rank, the leftmost of
        equals, is joined until none is known. Long pre-tokens keep their pairs in a heap."""
        get = self.ranks.get
        if (whole := get(word)) is not None:
            return [whole]
        if len(word) > LONG:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < NONE:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        get, n, low = self.ranks.get, len(word), (1 << 32) - 1
        end, last = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # of the part at i: where it ends, where the one before begins
        heap = [r << 64 | i << 32 | i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]  # rank, from, to
        heapify(heap)
        while heap:
            pair = heappop(heap)
            i, to = pair >> 32 & low, pair & low
            j = end[i]
            if j < 0 or j >= n or end[j] != to:  # one of the pair has been joined with another
                continue
            end[i], end[j] = to, -1
            if to < n:
                last[to] = i
                if (r := get(word[i : end[to]])) is not None:
                    heappush(heap, r << 64 | i << 32 | end[to])
            if (k := last[i]) >= 0 and (r := get(word[k:to])) is not None:
                heappush(heap, r << 64 | k << 32 | to)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def table(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out


def _encode_words(messages: DataFrame, voc) -> DataFrame:
    """block, bucket, n, m, reply (packed: ids per word, then all ids). All messages of a bucket
    meet in one task, so each distinct word is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        merge = voc.value.merge
        for b in batches:
            m, replies = [], []
            for now, size, packed in zip(b.column("bucket").to_pylist(), b.column("size").to_pylist(), b.column("words"), strict=True):
                if now != bucket:
                    bucket, known = now, {}
                words = unpack_words(packed.as_py(), size)
                for w in set(words).difference(known):
                    known[w] = merge(w)
                ids = [known[w] for w in words]
                out = np.concatenate([np.fromiter(map(len, ids), np.uint32, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)])
                m.append(len(out))
                replies.append(pack(out))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), b.column("n"), pa.array(m, pa.int32()), pa.array(replies, pa.binary())], ["to", "bucket", "n", "m", "reply"])

    return messages.select("block", "bucket", "n", "size", "words").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "to long, bucket int, n int, m int, reply binary")


def _assemble(left: pa.Table, right: pa.Table, names: list[str], id_type: pa.DataType) -> pa.Table:
    right = right.sort_by("bucket")
    sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for n, m, reply in zip(right.column("n").to_pylist(), right.column("m").to_pylist(), right.column("reply"), strict=True):
        got = unpack(reply.as_py(), m)
        sizes.append(got[:n].astype(np.int64))
        flat.append(got[n:])
    size, flat = np.concatenate(sizes), np.concatenate(flat).astype(np.int32)
    start = np.cumsum(size) - size
    block = left.slice(0, 1).to_pylist()[0] if left.num_rows else None
    if block is None:
        return pa.Table.from_arrays([pa.array([], id_type), pa.array([], pa.list_(pa.int32()))], names)
    order = unpack(block["order"], len(size))
    by_code = np.zeros(len(size), np.int64)
    by_code[order] = np.arange(len(size))
    lens = np.array(block["lens"], np.int64)
    places = by_code[unpack(block["codes"], int(lens.sum()))]
    upto = np.concatenate([[0], np.cumsum(size[places])])
    ids = np.empty(upto[-1], np.int32)
    for a in range(0, len(places), PIECE):
        own, at = places[a : a + PIECE], upto[a : a + PIECE + 1]
        ids[at[0] : at[-1]] = flat[np.arange(at[-1] - at[0]) + np.repeat(start[own] - (at[:-1] - at[0]), size[own])]
    ends = np.concatenate([[0], upto[np.cumsum(lens)]])
    pa.default_memory_pool().release_unused()
    return pa.Table.from_arrays([pa.array(block["docs"], id_type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names)


def encode(docs: DataFrame, voc: Vocabulary, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    blocks = word_blocks(docs, lambda t: shared.value.split(t), doc_id=doc_id, text=text)
    replies = _encode_words(messages_of(blocks), shared)
    out = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    id_type = blocks.select("docs").limit(0).toArrow().schema.field(0).type.value_type
    stream = blocks.select("block", "docs", "lens", "codes", "order")
    joined = stream.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(lambda l, r: _assemble(l, r, ["id", "ids"], id_type), out)
    return joined.select(F.col("id").alias(doc_id), "ids")


def decode(encoded: DataFrame, voc: Vocabulary, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The columns of encoded, without any named as the new one, and the bytes its ids stand for; a null
    list gives null."""
    if ids.lower() == to.lower():
        raise ValueError("ids and to must differ")
    encoded = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != to.lower()])
    shared = encoded.sparkSession.sparkContext.broadcast(voc.table())
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value.__getitem__
        for b in batches:
            lists = b.column(b.schema.names.index(ids))
            joined = [None if x.as_py() is None else b"".join(map(look, x.values.to_numpy().tolist())) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(joined, pa.binary())], [*b.schema.names, to])

    return encoded.mapInArrow(run, schema)
