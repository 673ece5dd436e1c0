"""Near-duplicate documents by SuperMinHash.

Every document's set of word shingles gets a SuperMinHash signature: each shingle draws a random
permutation of the slots, and its j-th slot gets j plus a random number if that is smaller; a
document is done as soon as a whole level can't change it (early stopping). Equal sets are one
class. Bands of the signature put classes into buckets; every pair of classes in a bucket is a
candidate, and every link is confirmed on the full sets:

- star round: each class is confirmed with the leader that it shares most buckets with. Leaders have
  the smaller hash, so these links are a forest of pointers, and a few jumps along them give labels;
  a large group of near copies costs one comparison a member, and a bucket of one label is done;
- a bucket that is still mixed is cut into chunks of bounded size that carry the full sets. Within a
  chunk, and between the chunks of one bucket (but those of its largest component, which are joined
  already), all pairs with different labels are compared inside the task: a parity sketch of each set (a bit per hashed place, flipped by every shingle) differs in
  at most as many bits as the sets differ in shingles, so it rules pairs out without loss; the others
  are compared by their sets and joined by union-find. Only links that join two labels come out, fewer
  than the chunk has members, and no row is made per pair;
- components of all links by large-star and small-star steps.

With 32 bands of 5 slots, a pair at a similarity of 0.8 shares no bucket with probability 3e-6; that is
the only way to lose a link.

Defined results: null, empty and word-free texts have an empty set and link with nothing; texts of
fewer words than a shingle are one shingle of all their words; rows that repeat an id and text are
one class like any copies; null ids are kept, and a component of null ids only is null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.llm.common import Scratch, unused
from trackforge.llm.components import connected
from trackforge.llm.wordblocks import pack, unpack

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
CHUNK, CHUNK_SHINGLES = 512, 500_000  # members of a chunk, and shingles, on average at most
JUMPS = 2  # along the star round's pointers
SKETCH_BITS = 1 << 27  # of all parity sketches of a chunk together
BATCH = 100_000  # shingles whose permutations are in memory at once

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    """ASCII white space parts words; only A-Z is made lower case."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(k, n)
    out = np.full(n - k + 1, _U(k))
    for j in range(k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    return np.unique(out)


def signatures(hashes: np.ndarray, doc: np.ndarray, docs: int, m: int = SLOTS) -> np.ndarray:
    """docs x m SuperMinHash values (level + fraction); doc: the document number of each hash."""
    best = np.full(docs * m, np.inf)
    old = None  # each shingle's permutation so far
    for j in range(m):
        a = mix(hashes + _U((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((a >> _U(32)) % _U(m - j)).astype(np.int64)
        fraction = (mix(a) >> _U(11)).astype(np.float64) * 2.0**-53
        if old is None:
            slot = k
        else:
            at = np.arange(len(k))
            slot = old[at, k].astype(np.int64)
            old[at, k] = old[:, j]
        np.minimum.at(best, doc * m + slot, j + fraction)
        waiting = np.isinf(best.reshape(docs, m)).any(1)
        on = waiting[doc]
        if not on.any():
            break
        if old is None:
            keep = np.flatnonzero(on)
            old = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(keep), 1))
            old[np.arange(len(keep)), k[keep]] = 0
        else:
            old = old[on]
        hashes, doc = hashes[on], doc[on]
    return best.reshape(docs, m)


def _bands(values: np.ndarray) -> np.ndarray:
    v = mix(values.view(np.uint64)).reshape(len(values), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + v[:, :, r])
    return out


def _sketch(d: DataFrame, k: int) -> DataFrame:
    schema = T.StructType([
        T.StructField("id", d.schema["id"].dataType), T.StructField("seen", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = b.column(2), b.num_rows
            start = 0
            while start < n:
                sets, size, end = [], 0, start
                while end < n and size < BATCH:
                    sets.append(shingles(texts[end].as_py(), k))
                    size += len(sets[-1])
                    end += 1
                lens = np.array([len(s) for s in sets])
                values = np.zeros((len(sets), SLOTS))
                some = np.flatnonzero(lens)
                if len(some):
                    values[some] = signatures(np.concatenate([sets[i] for i in some]), np.repeat(np.arange(len(some)), lens[some]), len(some))
                bands = _bands(values).view(np.int64)
                cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), b.column(1).slice(start, end - start), pa.array(lens, pa.int64()), pa.array(cls, pa.binary()), flat], schema.names)
                start = end

    return d.mapInArrow(run, schema)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of sorted distinct shingles."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, own = a, shingles(ta.as_py(), k)
                if _alike(own, shingles(tb.as_py(), k), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


class Chunk:
    """Members of a bucket: their class, label and set."""

    def __init__(self, cls: list[bytes], label: list[bytes], sets: list[np.ndarray]):
        self.cls, self.label, self.sets = cls, label, sets
        self.n = np.array([len(x) for x in sets])
        self._bits, self._sketch = 0, None

    def sketch(self, bits: int) -> np.ndarray:
        """members x words: bit h % bits is 1 if an odd number of a set's shingles have it."""
        if bits != self._bits:
            out = np.zeros((len(self.sets), bits // 64), np.uint64)
            h = np.concatenate(self.sets) & _U(bits - 1)
            np.bitwise_xor.at(out.reshape(-1), np.repeat(np.arange(len(self.n)), self.n) * (bits // 64) + (h >> _U(6)).astype(np.int64), _U(1) << (h & _U(63)))
            self._bits, self._sketch = bits, out
        return self._sketch

    def dump(self) -> bytes:
        """Distinct shingles once, members' shingles by number: near copies share most of them."""
        values, at = np.unique(np.concatenate(self.sets), return_inverse=True)
        parts = [b"".join(self.cls), b"".join(self.label), self.n.astype("<u4").tobytes(), values.astype("<u8").tobytes(), pack(at.astype(np.uint32))]
        return np.array([len(self.n), *map(len, parts)], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> Chunk:
        head = np.frombuffer(data, "<i8", 6)
        parts, at = [], 48
        for size in head[1:].tolist():
            parts.append(data[at : at + size])
            at += size
        n = np.frombuffer(parts[2], "<u4").astype(np.int64)
        flat = np.frombuffer(parts[3], "<u8")[unpack(parts[4], int(n.sum()))]
        cut = lambda x: [x[16 * i : 16 * i + 16] for i in range(int(head[0]))]
        return cls(cut(parts[0]), cut(parts[1]), np.split(flat, np.cumsum(n)[:-1]))


def joins(x: Chunk, y: Chunk, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between x and y (or within x, if they are the same) that connect all labels that links
    of theirs connect: each joins two labels that no earlier one had joined."""
    bits = 64
    while bits < 4 * max(int(x.n.max()), int(y.n.max())) and 2 * bits * (len(x.n) + len(y.n)) <= SKETCH_BITS:
        bits *= 2
    sx, sy = x.sketch(bits), y.sketch(bits)
    number = {c: i for i, c in enumerate(dict.fromkeys(x.label + ([] if x is y else y.label)))}
    lx, ly = (np.array([number[c] for c in z.label]) for z in (x, y))
    up = list(range(len(number)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    rows = max(1, 2_000_000 // max(1, sy.size))
    for a in range(0, len(lx), rows):
        now = np.array([top(i) for i in range(len(up))])
        both = x.n[a : a + rows, None] + y.n[None, :]
        ok = now[lx[a : a + rows]][:, None] != now[ly][None, :]
        if x is y:
            ok &= np.arange(len(ly))[None, :] > np.arange(a, min(a + rows, len(lx)))[:, None]
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        differ = np.concatenate([np.bitwise_count(sx[a + i[c : c + 65536]] ^ sy[j[c : c + 65536]]).sum(1, dtype=np.int64) for c in range(0, len(i), 65536)]) if len(i) * 3 < ok.size else np.bitwise_count(sx[a : a + rows, None, :] ^ sy[None, :, :]).sum(2, dtype=np.int64)[i, j]
        # similar sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum
        near = np.flatnonzero(differ * (100 + percent) <= both[i, j] * (100 - percent))
        for t in near[np.argsort(differ[near], kind="stable")].tolist():
            p, q = a + int(i[t]), int(j[t])
            m, n = top(lx[p]), top(ly[q])
            if m != n and _alike(x.sets[p], y.sets[q], percent):
                up[max(m, n)] = min(m, n)
                out.append((x.cls[p], y.cls[q]))
    return out


_LINKS = "a binary, b binary, bucket long, chunk int, bases int, data binary"


def _link_batch(links: list[tuple[bytes, bytes]], kept: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    a, b = [x for x, _ in links] + [None] * len(kept), [x for _, x in links] + [None] * len(kept)
    rest = [[None] * len(links) + [x[i] for x in kept] for i in range(4)]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([a, b, *rest], kinds, strict=True)], ["a", "b", "bucket", "chunk", "bases", "data"])


def _within(left: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """left: _mixed()'s. Links within each chunk; and the chunks themselves where a bucket has several."""
    rows = left.join(texts, "cls").select("bucket", "chunk", "chunks", "bases", "cls", "component", "text")
    rows = rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> tuple[list, list]:
            c = Chunk([r[0] for r in held], [r[1] for r in held], [r[2] for r in held])
            return joins(c, c, percent), ([(now[0], now[1], now[3], c.dump())] if now[2] > 1 else [])

        for b in batches:
            links = []
            for *at, cls, component, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "chunks", "bases", "cls", "component")), b.column("text"), strict=True):
                if at != now:
                    if held:
                        own, kept = close()
                        links += own
                        if kept:
                            yield _link_batch([], kept)
                    now, held = at, []
                held.append((cls, component, shingles(text.as_py(), k)))
            if links:
                yield _link_batch(links, [])
        if held:
            yield _link_batch(*close())

    return rows.mapInArrow(run, _LINKS)


def _between(chunks: DataFrame, percent: int) -> DataFrame:
    """Links between chunks of one bucket. Each chunk goes to itself and to every one before it, but for those
    of the largest component, so that a hot bucket's pairs of chunks are spread over tasks; one of a pair is
    held, the others pass by."""
    rows = chunks.select("bucket", F.explode(F.sequence(F.lit(0), F.least("chunk", F.col("bases") - 1))).alias("base"), "chunk", "data")
    rows = rows.repartition("bucket", "base").sortWithinPartitions("bucket", "base", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, own = None, None
        for b in batches:
            links = []
            for bucket, to, chunk, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "base", "chunk")), b.column("data"), strict=True):
                if (bucket, to) != base:
                    base, own = (bucket, to), None
                if chunk == to:
                    own = Chunk.load(data.as_py())
                elif own is not None:  # a chunk that happens to be empty has no pairs
                    links += joins(own, Chunk.load(data.as_py()), percent)
            if links:
                yield _link_batch(links, [])

    return rows.mapInArrow(run, _LINKS)


def _star(member: DataFrame) -> DataFrame:
    """a, b: each class b with the leader that it shares most buckets with."""
    pairs = member.where("cls <> leader").groupBy(F.col("leader").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("common"))
    return pairs.groupBy("b").agg(F.max(F.struct("common", "a")).alias("best")).select("best.a", "b")


def _labels(found: DataFrame, scratch: Scratch) -> DataFrame:
    """cls, component: a class reachable along the star links, which point from b to a."""
    now = found.select(F.col("b").alias("cls"), F.col("a").alias("component"))
    for _ in range(JUMPS):
        to = now.select(F.col("cls").alias("component"), F.col("component").alias("next"))
        now = scratch.write(now.join(to, "component", "left").select("cls", F.coalesce("next", "component").alias("component")))
    return now


def _mixed(member: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, cls, component, chunk, chunks, bases: of buckets with several components. The members of a
    bucket's largest component have chunks of their own, numbered from bases on: they aren't compared with
    each other."""
    left = member.join(labels, "cls", "left").select("bucket", "cls", "n", F.coalesce("component", "cls").alias("component"))
    parts = left.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    main = F.max(F.struct("c", "component", "s")).alias("main")
    mixed = parts.groupBy("bucket").agg(main, F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("components")).where("components > 1")
    size = lambda c, s: F.ceil(F.greatest(c / CHUNK, s / CHUNK_SHINGLES)).cast("int")
    whole, of_main, rest = size(F.col("c"), F.col("s")), size(F.col("main.c"), F.col("main.s")), size(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s"))
    mixed = mixed.select("bucket", F.col("main.component").alias("main"), F.when(whole == 1, 1).otherwise(rest).alias("bases"), F.when(whole == 1, 1).otherwise(rest + of_main).alias("chunks"))
    h, own = F.xxhash64("cls"), (F.col("component") == F.col("main")) & (F.col("chunks") > 1)
    chunk = F.when(own, F.col("bases") + F.pmod(h, F.col("chunks") - F.col("bases"))).otherwise(F.pmod(h, "bases")).cast("int")
    return left.join(mixed, "bucket").select("bucket", "cls", "component", chunk.alias("chunk"), "chunks", "bases")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest id reachable by links), kept (doc_id is the
    component's): one row per row of docs. Links: 100 * shared >= percent * union of shingle sets."""
    scratch = Scratch(docs.sparkSession, "minhash")
    sketch, component = _components(docs, scratch, k, percent, doc_id, text)
    return _finish(sketch, component).select(F.col("id").alias(doc_id), F.col("seen").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("low_of").alias("component_id"), F.col("id").eqNullSafe(F.col("low_of")).alias("kept"))


def _components(docs: DataFrame, scratch: Scratch, k: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, seen, n, cls, bands of each row; node, component of each class that has a link)."""
    d = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("seen"), F.col(text).cast("string").alias("text"))
    sketch = scratch.write(_sketch(d, k))
    classes = sketch.where("n > 0").groupBy("cls").agg(F.min(F.struct("id", "seen")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    member = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("cls"), "cls")
    shared = member.groupBy("bucket").agg(F.count("*").alias("c"), F.min(order).alias("leader")).where("c > 1").select("bucket", F.col("leader.cls").alias("leader"))
    member = scratch.write(member.join(shared, "bucket").select("bucket", "cls", "n", "leader"))
    needed = member.select("cls").distinct()
    names = classes.join(needed, "cls", "left_semi").select("cls", F.col("one.id").alias("id1"), F.col("one.seen").alias("seen1"))
    texts = scratch.write(d.join(names, d["id"].eqNullSafe(names["id1"]) & (d["seen"] == names["seen1"])).select("cls", "text").dropDuplicates(["cls"]))
    found = scratch.write(_confirm(_star(member), texts, k, percent))
    left = scratch.write(_mixed(member, _labels(found, scratch)))
    near = scratch.write(_within(left, texts, k, percent))
    far = scratch.write(_between(near.where("data is not null").select("bucket", "chunk", "bases", "data"), percent))
    links = found
    for more in (near, far):
        links = links.unionByName(more.where("a is not null").select("a", "b"))
    component = connected(links, scratch)
    scratch.keep(sketch, component)
    return sketch, component


def without_near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, in its own columns: that with the smallest id, then text hash;
    of rows that repeat both, one. Texts without words are no one's copies and all stay."""
    scratch = Scratch(docs.sparkSession, "minhash")
    sketch, component = _components(docs, scratch, k, percent, doc_id, text)
    low, id_, seen, gone = unused(docs.columns, "low", "id", "seen", "gone")
    rows = _finish(sketch, component).where("n > 0").groupBy("id", "seen", "group").agg(F.count("*").alias("copies"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "seen")).alias(low)).withColumnRenamed("group", "of")
    judged = rows.join(first, rows["group"] == first["of"]).select(F.col("id").alias(id_), F.col("seen").alias(seen), (~(F.col("id").eqNullSafe(F.col(f"{low}.id")) & (F.col("seen") == F.col(f"{low}.seen")))).alias(gone), "copies")
    special = scratch.write(judged.where(F.col(gone) | (F.col("copies") > 1)).select(id_, seen, gone), last=True)
    on = docs[doc_id].eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text]) == F.col(seen))
    out = docs.join(special, on, "left_anti")
    repeated = docs.join(special.where(~F.col(gone)), on, "left_semi").dropDuplicates([doc_id, text])
    return out.unionByName(repeated)


def _finish(sketch: DataFrame, component: DataFrame) -> DataFrame:
    """id, seen, n, group (class that names the component; null without words), low_of (smallest id)."""
    rows = sketch.select("id", "seen", "n", "cls")
    c = component.select(F.col("node").alias("cls"), "component")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("low")).join(c, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lows = classes.groupBy("component").agg(F.min("low").alias("low_of"))
    named = classes.join(lows, "component").select("cls", F.col("component").alias("group"), "low_of")
    label: Column = F.when(F.col("n") > 0, F.col("low_of")).otherwise(F.col("id"))
    return rows.join(named, "cls", "left").select("id", "seen", "n", "group", label.alias("low_of"))
