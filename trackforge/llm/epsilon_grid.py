"""Similarity join of embeddings by epsilon grid order.

Vectors are scaled to length 1, so cosine >= c is a distance of at most eps = sqrt(2 - 2c). They
are rotated to their leading principal dimensions (from sums over all vectors), put on a grid of
side eps there, and sorted by cell, first dimension first. The sequence is cut into blocks with
their bounds. Blocks are joined recursively: pairs of intervals of blocks, beginning with the
whole sequence, are opened into pairs of smaller ones, and a pair whose bounds are further apart
than eps is dropped with all below it. Pairs of single blocks that remain are compared vector by
vector: in single precision first, and in double precision where rounding could decide. The blocks of
one interval are held, and the others pass by, each sent to an interval once.

Equal vectors are one class, compared once. An interval gives, for each class, the number of vectors
it links to, and a forest that connects what is linked, so the output for near copies grows with
vectors and not with pairs, and no link is lost. Counts of links are exact, so vectors that lie within
eps of each other are all compared with each other, in tiles; that work is the square of such a group.

Defined results: null vectors, and those with null or non-finite components, or of length 0, link
with nothing; vectors of different dimension never link; tiny and huge vectors are scaled by a power
of two first, which changes no cosine; repeated rows and ids count as vectors of their own; null ids
are kept, and a component of null ids only is null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.llm.common import Scratch
from trackforge.llm.components import connected

LEADING = 6  # principal dimensions that order and bound blocks
BLOCK, BLOCK_BYTES = 4096, 2 << 20  # vectors in a block at most, and bytes
TILE = 512  # vectors of a block that are compared with another block at once
SUMS = 16  # partial sums that come to the driver
FAN = 8  # intervals that an interval opens into
SLACK = 1e-9  # added to eps against rounding; found pairs are checked exactly


def _scaled(v: np.ndarray) -> np.ndarray:
    """Times a power of two, so that the largest component is from 0.5 to 1: no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _classes(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, cls (null if the vector can't link), dim, v (bytes of doubles)."""
    d = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for x in b.column(1):
                v = None if x.as_py() is None or x.values.null_count or not len(x.values) else x.values.to_numpy(zero_copy_only=False)
                if v is not None and not (np.isfinite(v).all() and v.any()):
                    v = None
                out.append(None if v is None else (_scaled(v) + 0.0).astype("<f8").tobytes())  # -0.0 is 0.0
                dims.append(None if v is None else len(v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "v"])

    return d.mapInArrow(run, f"id {kind}, dim int, v binary").withColumn("cls", F.when(F.col("v").isNotNull(), F.unhex(F.sha2("v", 256))))


def _principal(classes: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """dim x LEADING directions of most variance, and the number of classes. Each task adds up its
    vectors, SUMS tasks add up those sums, and the driver adds up what they give."""

    def total(parts: Iterator[np.ndarray]) -> pa.RecordBatch:
        s = np.zeros((dim + 1, dim + 1))
        for x in parts:
            s += x
        return pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    def square(x: np.ndarray) -> np.ndarray:
        x = np.hstack([np.ones((len(x), 1)), _unit(x)])
        return x.T @ x

    read = lambda b: (np.frombuffer(x.as_py(), np.float64).reshape(dim + 1, dim + 1) for x in b.column(0))
    first = classes.select("v").mapInArrow(lambda batches: iter([total(square(_matrix(b.column(0), dim)) for b in batches if b.num_rows)]), "s binary")
    rows = first.repartition(SUMS).mapInArrow(lambda batches: iter([total(x for b in batches for x in read(b))]), "s binary").collect()
    s = sum((np.frombuffer(r["s"], np.float64).reshape(dim + 1, dim + 1) for r in rows), np.zeros((dim + 1, dim + 1)))
    n = max(s[0, 0], 1.0)
    mean = s[0, 1:] / n
    _, directions = np.linalg.eigh(s[1:, 1:] / n - np.outer(mean, mean))
    return directions[:, ::-1][:, : min(LEADING, dim)], int(n)


def _blocks(classes: DataFrame, dim: int, eps: float, scratch: Scratch) -> DataFrame:
    """Written: block (its place in the sequence), n, cls (joined bytes), v, mult, lo, hi (bounds)."""
    directions, count = _principal(classes, dim)
    k, most = directions.shape[1], max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    cells = [f"c{i}" for i in range(k)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.floor(_unit(_matrix(b.column("v"), dim)) @ directions / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c[:, i]) for i in range(k))], [*b.schema.names, *cells])

    kinds = ", ".join(f"{c} int" for c in cells)
    placed = scratch.write(classes.select("cls", "mult", "v").mapInArrow(place, f"cls binary, mult long, v binary, {kinds}"))
    n = min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // most))
    ordered = placed.repartitionByRange(n, *cells, "cls").sortWithinPartitions(*cells, "cls")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, m, held = TaskContext.get().partitionId(), 0, []

        def block(t: pa.Table) -> pa.RecordBatch:
            v = _matrix(t.column("v"), dim)
            y = _unit(v) @ directions
            whole = lambda a: pa.array([a], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + m], pa.int64()), pa.array([t.num_rows], pa.int32()), pa.array([b"".join(t.column("cls").to_pylist())], pa.binary()), pa.array([v.astype("<f8").tobytes()], pa.binary()), pa.array([t.column("mult").to_pylist()], pa.list_(pa.int64())), whole(y.min(0).tolist()), whole(y.max(0).tolist())],
                ["key", "n", "cls", "v", "mult", "lo", "hi"])

        for b in batches:
            held.append(b.select(["cls", "mult", "v"]))
            while sum(x.num_rows for x in held) >= most:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, most))
                m += 1
                held = t.slice(most).to_batches()
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    return scratch.write(ordered.mapInArrow(cut, "key long, n int, cls binary, v binary, mult array<long>, lo array<double>, hi array<double>"))


def _near(eps: float) -> F.Column:
    """Whether the bounds of x and y are at most eps apart: a gap in each dimension, squared."""
    gaps = F.zip_with(F.zip_with("x_lo", "y_hi", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with("y_lo", "x_hi", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: a + b)
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (eps + SLACK) ** 2


def _pairs(blocks: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """x, y (places in the sequence, x <= y) and x_key, y_key: pairs of blocks that may hold vectors within eps."""
    dims = len(blocks.select("lo").first()["lo"])
    parts = blocks.groupBy(F.shiftright("key", 32).alias("part")).agg(F.count("*").alias("n"))
    starts = {r["part"]: r["n"] for r in parts.collect()}  # one row per shuffle partition
    total, first = 0, {}
    for p in sorted(starts):
        first[p], total = total, total + starts[p]
    offset = blocks.sparkSession.createDataFrame(list(first.items()), "part long, first long")
    leaf = blocks.withColumn("part", F.shiftright("key", 32)).join(F.broadcast(offset), "part").select((F.col("first") + F.col("key").bitwiseAND(0xFFFFFFFF)).alias("i"), "key", "lo", "hi")
    leaf = scratch.write(leaf)
    levels, width = [leaf.select("i", "lo", "hi")], 1
    while width < total:
        width *= FAN
        bounds = lambda c, f: F.array(*[f(F.get(c, F.lit(j))) for j in range(dims)]).alias(c)
        levels.append(levels[-1].groupBy(F.floor(F.col("i") / FAN).alias("i")).agg(bounds("lo", F.min), bounds("hi", F.max)))
    pairs = blocks.sparkSession.createDataFrame([(0, 0)], "x long, y long")
    for level in reversed(levels[:-1]):
        side = lambda s: level.select(F.col("i").alias(s), F.floor(F.col("i") / FAN).alias(f"{s}_up"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"))  # noqa: B023, E731
        up = pairs.select(F.col("x").alias("x_up"), F.col("y").alias("y_up"))
        pairs = scratch.write(up.join(side("x"), "x_up").join(side("y"), "y_up").where("x <= y").where(_near(eps)).select("x", "y"))
    key = lambda s: leaf.select(F.col("i").alias(s), F.col("key").alias(f"{s}_key"))
    return pairs.join(key("x"), "x").join(key("y"), "y").select("x", "y", "x_key", "y_key")


def spanning(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, columns, one of the rows) of each connected part of a relation with more than no links."""
    rows, columns, out = mask.any(1), mask.any(0), []
    for start in np.flatnonzero(rows).tolist():
        if not rows[start]:
            continue
        rows[start], new = False, np.array([start])
        own_rows, own_columns = [new], []
        while len(new):
            c = np.flatnonzero(mask[new].any(0) & columns)
            columns[c] = False
            own_columns.append(c)
            new = np.flatnonzero(mask[:, c].any(1) & rows) if len(c) else c
            rows[new] = False
            own_rows.append(new)
        out.append((np.concatenate(own_rows), np.concatenate(own_columns), start))
    return out


class Block:
    def __init__(self, cls: bytes, v: bytes, mult: list[int], dim: int):
        self.cls, self.v, self.mult = cls, np.frombuffer(v, "<f8").reshape(-1, dim), np.array(mult, np.int64)
        self.norm, self.n = np.sqrt((self.v * self.v).sum(1)), len(mult)
        self.unit = (self.v / self.norm[:, None]).astype(np.float32)
        self.links = np.zeros(self.n, np.int64)

    def near(self, other: Block, cosine: float) -> np.ndarray:
        out, unsure = np.empty((self.n, other.n), bool), np.float32(1e-6 + 2e-7 * self.v.shape[1])  # more than single precision is off by
        for a in range(0, self.n, TILE):
            c = self.unit[a : a + TILE] @ other.unit.T
            sure = np.greater_equal(c, np.float32(cosine) + unsure, out=out[a : a + TILE])
            perhaps = c >= np.float32(cosine) - unsure
            if np.count_nonzero(perhaps) > np.count_nonzero(sure):
                i, j = np.nonzero(perhaps & ~sure)
                for k in range(0, len(i), 1 << 14):
                    p, q = a + i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    out[p, q] = (self.v[p] * other.v[q]).sum(1) / (self.norm[p] * other.norm[q]) >= cosine
        if other is self:
            np.fill_diagonal(out, False)
        return out

    def name(self, i: int) -> bytes:
        return self.cls[32 * i : 32 * i + 32]


class Interval:
    """Blocks that are held: counts of links, and which of their vectors are connected by now."""

    def __init__(self, cosine: float):
        self.cosine, self.blocks, self.first, self.up, self.out = cosine, {}, {}, [], []

    def hold(self, i: int, block: Block) -> None:
        self.blocks[i], self.first[i] = block, len(self.up)
        self.up.extend(range(len(self.up), len(self.up) + block.n))

    def _top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def compare(self, i: int, block: Block | None, with_: list[int]) -> None:
        """Block i (None: it is held) with the held blocks named."""
        y, base = (self.blocks[i], self.first[i]) if block is None else (block, len(self.up))
        held = len(self.up)
        self.up.extend(range(held, held + (0 if block is None else y.n)))
        for j in with_:
            x, at = self.blocks[j], self.first[j]
            mask = x.near(y, self.cosine)
            if not (r := np.flatnonzero(mask.any(1))).size:
                continue
            x.links[r] += mask[r] @ y.mult
            if x is not y:
                y.links += x.mult[r] @ mask[r]
            for rows, columns, start in spanning(mask):
                root = x.name(start)
                for z, places, offset in ((x, rows, at), (y, columns, base)):
                    for p in places.tolist():
                        a, b = self._top(at + start), self._top(offset + p)
                        if a != b:
                            self.up[max(a, b)] = min(a, b)
                            self.out.append((root, 0, z.name(p)))
        if block is not None:
            self.out += _counts(y)
            del self.up[held:]  # held vectors have smaller numbers, so no pointer leads here

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            cls, links, other = zip(*self.out, strict=True)
            self.out = []
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(links, pa.int64()), pa.array(other, pa.binary())], ["cls", "links", "other"])

    def close(self) -> Iterator[pa.RecordBatch]:
        for x in self.blocks.values():
            self.out += _counts(x)
        yield from self.rows()


def _counts(x: Block) -> list[tuple]:
    return [(x.name(i), int(x.links[i]), None) for i in np.flatnonzero(x.links).tolist()]


def _compare(pairs: DataFrame, blocks: DataFrame, dim: int, cosine: float) -> DataFrame:
    """cls, links (vectors of other classes it links to, from one interval), other (a class that the
    forest joins it to, or null)."""
    # a block goes to each interval that it meets, once, with the names of those blocks it meets there;
    # intervals are as wide as leaves every task one
    parts, many = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count()
    width = max(1, min(FAN, many // (2 * parts)))
    met = pairs.groupBy(F.floor(F.col("x") / width).alias("interval"), F.col("y").alias("i"), F.col("y_key").alias("key")).agg(F.array_sort(F.collect_set("x")).alias("with_"))
    own = pairs.groupBy("x", "x_key").agg(F.lit(1)).select(F.floor(F.col("x") / width).alias("interval"), F.col("x").alias("i"), F.col("x_key").alias("key"), F.array().cast("array<bigint>").alias("with_"))
    data = blocks.select("key", "cls", "v", "mult")
    inside = F.floor(F.col("i") / width) == F.col("interval")
    full = own.withColumn("turn", F.lit(0)).unionByName(met.where(~inside).withColumn("turn", F.lit(1))).join(data, "key")
    again = met.where(inside).withColumn("turn", F.lit(1)).select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in data.dtypes if c != "key"])
    columns = ["interval", "turn", "i", "with_", "cls", "v", "mult"]
    rows = full.select(*columns).unionByName(again.select(*columns)).repartition(max(1, min(parts, -(-many // width))), "interval").sortWithinPartitions("interval", "turn", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Interval(cosine)
        for b in batches:
            get = lambda c, k: b.column(c)[k].as_py()  # noqa: B023, E731
            for k in range(b.num_rows):
                if get("interval", k) != now:
                    yield from held.close()
                    now, held = get("interval", k), Interval(cosine)
                block = None if get("cls", k) is None else Block(get("cls", k), get("v", k), get("mult", k), dim)
                if get("turn", k) == 0:
                    held.hold(get("i", k), block)
                else:
                    held.compare(get("i", k), block, get("with_", k))
                    yield from held.rows()
        yield from held.close()

    return rows.mapInArrow(run, "cls binary, links long, other binary")


def near_vectors(vectors: DataFrame, *, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with at least this cosine), component_id (smallest id
    reachable by links), kept (vec_id is the component's): one row per row of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "grid")
    eps = (2 - 2 * cosine) ** 0.5
    rows = scratch.write(_classes(vectors, vec_id, embedding))
    classes = scratch.write(rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.count("*").alias("mult"), F.min("id").alias("low")))
    found = None
    for dim in [r["dim"] for r in classes.select("dim").distinct().collect()]:  # one pass per dimension
        own = classes.where(F.col("dim") == dim)
        blocks = _blocks(own, dim, eps, scratch)
        f = _compare(_pairs(blocks, eps, scratch), blocks, dim, cosine)
        found = f if found is None else found.unionByName(f)
    if found is None:
        found = spark.createDataFrame([], "cls binary, links long, other binary")
    found = scratch.write(found)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    connections = connected(found.where(F.col("other").isNotNull()).select(F.col("cls").alias("a"), F.col("other").alias("b")), scratch)
    scratch.keep(rows, classes, found, connections)
    component = connections.select(F.col("node").alias("cls"), "component")
    named = classes.select("cls", "mult", "low").join(component, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lows = named.groupBy("component").agg(F.min("low").alias("low_of"))
    known = named.join(lows, "component").join(links, "cls", "left").select("cls", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "low_of")
    out = rows.select("id", "cls").join(known, "cls", "left")
    label = F.when(F.col("cls").isNotNull(), F.col("low_of")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), F.col("id").eqNullSafe(label).alias("kept"))
