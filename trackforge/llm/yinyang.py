"""K-means over integer vectors by Yinyang grouping.

Centroids are put into groups once. A vector keeps an upper bound on the distance to its centroid
and one lower bound for each group on the distance to the group's other centroids. When centroids
move, the bounds widen by as much. A vector whose upper bound stays below all lower bounds is done
(the global filter); else its own distance is taken anew, and only groups whose lower bound doesn't
exceed it are scanned, with exact integer distances (the group filter). Bounds are doubles with a
margin for rounding and are compared strictly, so ties are always scanned and the results are
those of the plain method.

Vectors are packed in blocks, a table bucketed by block. Each round reads it beside the former
round's table of bounds, bucketed likewise, so nothing is shuffled but sums of blocks; the driver
gets one sum a centroid and component, a number fixed by the parameters.

Vectors that are null, have another number of components, or a null or non-finite one are left
out. A component x becomes floor(1024 * x), exactly, however large; components too large for 64-bit squares go
through Python's integers, and a distance or inertia beyond 64 bits is null. Repeated rows are vectors
of their own. Null ids are assigned, but start no centroid unless ids run short; of starts with one hash
the smaller vector comes first. With fewer vectors than centroids, there are as many centroids as vectors; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.llm.common import Scratch, bounded_batches
from trackforge.llm.wordblocks import bucketed, whole

SCALE = 1024
BLOCK = 8192
#: Bits of a piece of a block's sums; a margin for the rounding of bounds.
_LIMB, _SLACK = 40, 1e-9


def widest(dim: int) -> int:
    """Components below it have squared distances below 2**62."""
    return math.isqrt((1 << 60) // max(dim, 1))


def exact(x: float) -> int:
    return math.floor(Fraction(x) * SCALE)


@dataclass
class Groups:
    """Centroids as numbers and as arrays, and the group of each."""

    at: list[list[int]]
    group: np.ndarray

    def array(self, wide: bool) -> np.ndarray:
        top = max((abs(v) for c in self.at for v in c), default=0)
        return np.array(self.at, object if wide or top >= widest(len(self.at[0])) else np.int64)


def grouped(at: list[list[int]], n: int, rounds: int = 5) -> Groups:
    """Centroids in n groups at most, by a few rounds of k-means over them, from evenly spread starts."""
    x = np.array([[float(min(max(v, -(1 << 500)), 1 << 500)) for v in c] for c in at])
    x = x / max(float(np.abs(x).max(initial=0)), 1.0)
    seeds, own = x[np.linspace(0, len(x) - 1, n).astype(int)], np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = ((x[:, None] - seeds[None]) ** 2).sum(2).argmin(1)
        seeds = np.stack([x[own == g].mean(0) if (own == g).any() else seeds[g] for g in range(n)])
    return Groups(at, np.unique(own, return_inverse=True)[1])


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Bounds:
    """What is known of a block's vectors: own (centroid), upper, lower (a column for each group)."""

    def __init__(self, x: np.ndarray, g: Groups, before: dict | None = None, moved: list[float] | None = None):
        self.x, self.g, self.wide = x, g, x.dtype == object
        self.c, self.n_groups = g.array(self.wide), int(g.group.max()) + 1
        if before is None or self.wide or self.c.dtype == object:
            self.own, self.d = self._scan_all()
            return
        n = len(x)
        self.own = np.frombuffer(before["own"], np.int32).astype(np.int64)
        self.upper = np.frombuffer(before["upper"]) + np.array(moved)[self.own]
        most = np.array([max(m for m, k in zip(moved, g.group, strict=True) if k == j) for j in range(self.n_groups)])
        self.lower = np.frombuffer(before["lower"]).reshape(n, self.n_groups) - most
        self._filter()

    def _scan_all(self) -> tuple[np.ndarray, np.ndarray]:
        each = np.stack([_squares(self.x, c) for c in self.c], 1)
        own = np.array([min(range(len(r)), key=r.__getitem__) for r in each.tolist()]) if each.dtype == object else each.argmin(1)
        d = each[np.arange(len(own)), own]
        if each.dtype == object:  # no bounds: such blocks are scanned each time
            self.upper, self.lower = np.full(len(own), np.inf), np.zeros((len(own), self.n_groups))
        else:
            self.upper, self.lower = _root(d), self._lowest(_root(each), own)
        return own, d

    def _lowest(self, roots: np.ndarray, own: np.ndarray) -> np.ndarray:
        roots = roots.copy()
        roots[np.arange(len(own)), own] = np.inf
        return np.stack([roots[:, self.g.group == j].min(1, initial=np.inf) for j in range(self.n_groups)], 1)

    def _filter(self) -> None:
        reach = lambda u: u * (1 + _SLACK) + _SLACK
        at = np.flatnonzero(reach(self.upper) >= self.lower.min(1))
        d = _squares(self.x[at], self.c[self.own[at]])
        self.upper[at] = _root(d)
        still = reach(self.upper[at]) >= self.lower[at].min(1)
        at, d = at[still], d[still]
        best, best_d, was = self.own[at].copy(), d.copy(), self.own[at]
        scanned = reach(self.upper[at])[:, None] >= self.lower[at]
        for j in range(self.n_groups):
            rows = np.flatnonzero(scanned[:, j])
            members = np.flatnonzero(self.g.group == j)
            each = np.stack([_squares(self.x[at[rows]], self.c[m]) for m in members], 1)
            low = each.argmin(1)
            new, new_d = members[low], each[np.arange(len(rows)), low]
            better = (new_d < best_d[rows]) | ((new_d == best_d[rows]) & (new < best[rows]))
            best[rows[better]], best_d[rows[better]] = new[better], new_d[better]
            roots = _root(each)
            roots[members[None] == was[rows, None]] = np.inf
            self.lower[at[rows], j] = roots.min(1, initial=np.inf)
        # lower bounds leave the own centroid out: where it changed, the former one counts and the new one doesn't
        for j in range(self.n_groups):
            changed = np.flatnonzero((best != was) & ((self.g.group[best] == j) | (self.g.group[was] == j)))
            members = np.flatnonzero(self.g.group == j)
            roots = np.stack([_root(_squares(self.x[at[changed]], self.c[m])) for m in members], 1)
            roots[members[None] == best[changed, None]] = np.inf
            self.lower[at[changed], j] = roots.min(1, initial=np.inf)
        self.own[at], self.upper[at] = best, _root(best_d)

    def sums(self) -> list[int]:
        """Of each centroid: its vectors' sums by component, and their number; in pieces of 40 bits."""
        k, dim = self.c.shape
        flat: list[int] = []
        for j in range(k):
            mine = self.x[self.own == j]
            flat += [int(v) for v in (mine.sum(0) if len(mine) else [0] * dim)] + [len(mine)]
        out, mask = [], (1 << _LIMB) - 1
        while any(flat) or not out:
            out += [(abs(v) & mask) * (1 if v >= 0 else -1) for v in flat]
            flat = [(abs(v) >> _LIMB) * (1 if v >= 0 else -1) for v in flat]
        return out


def _pack(x: np.ndarray) -> bytes:
    return ",".join(str(v) for v in x.ravel()).encode() if x.dtype == object else x.tobytes()


def _unpack(packed: bytes, wide: bool, dim: int) -> np.ndarray:
    return np.array([int(v) for v in packed.split(b",")], object).reshape(-1, dim) if wide else np.frombuffer(packed, np.int64).reshape(-1, dim)


def vector_blocks(vectors: DataFrame, *, vec_id: str, vector: str, dim: int, block: int = BLOCK) -> DataFrame:
    """block, ids, wide, x (packed integers): the vectors that count, a bucketed table."""
    d = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("e"))
    kind = d.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("wide", T.BooleanType()), T.StructField("x", T.BinaryType())])
    limit = widest(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lists = batch.column(1)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
            good = np.isfinite(x).all(1)
            for wide in (False, True):
                fits = good & ((np.abs(x) < limit / SCALE).all(1) != wide)
                at = np.flatnonzero(fits)
                for i in range(0, len(at), block):
                    rows = at[i : i + block]
                    own = np.array([[exact(v) for v in r] for r in x[rows].tolist()], object) if wide else np.floor(x[rows] * SCALE).astype(np.int64)
                    ids = batch.column(0).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), whole(ids), pa.array([wide]), pa.array([_pack(own)], pa.binary())], ["block", "ids", "wide", "x"])
                    n += 1

    return bucketed(d.mapInArrow(run, schema), "block", "vectors")


def starts(vectors: DataFrame, k: int, seed: int, *, vec_id: str, vector: str, dim: int) -> list[list[int]]:
    """The k vectors that count whose ids have the smallest hashes."""
    e = F.col("e")
    d = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256).alias("h"), F.col(vector).cast("array<double>").alias("e"))
    d = d.where((F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))
    return [[exact(v) for v in r["e"]] for r in d.orderBy(F.asc_nulls_last("h"), "e").limit(k).collect()]


_STATE = "block long, own binary, upper binary, lower binary, sums array<long>"


def _step(dim: int, g: Groups, moved: list[float] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bounds(_unpack(row["x"], row["wide"], dim), g, row if moved else None, moved)
                values = (row["block"], b.own.astype(np.int32).tobytes(), b.upper.tobytes(), b.lower.tobytes(), b.sums())
                yield pa.RecordBatch.from_pylist([dict(zip(("block", "own", "upper", "lower", "sums"), values, strict=True))], pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("own", "upper", "lower")], ("sums", pa.list_(pa.int64()))]))

    return run


def _means(state: DataFrame, at: list[list[int]]) -> list[list[int]]:
    """The centroids' vectors' means, rounded down; of one without vectors, itself."""
    width, total = len(at[0]) + 1, [0] * (len(at) * (len(at[0]) + 1))
    for r in state.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        total[r["i"] % len(total)] += int(r["v"]) << _LIMB * (r["i"] // len(total))
    each = [total[j * width : (j + 1) * width] for j in range(len(at))]
    return [[v // s[-1] for v in s[:-1]] if s[-1] else c for s, c in zip(each, at, strict=True)]


def _away(a: list[int], b: list[int]) -> float:
    """No less than the distance of two centroids."""
    d = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    return math.sqrt(d) * (1 + _SLACK) + _SLACK if d < 1 << 1000 else math.inf


def cluster(vectors: DataFrame, k: int = 8, *, rounds: int = 10, seed: int = 3, dim: int = 64, groups: int | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: a row for each vector that
    counts. groups: of centroids; a tenth of k, but two, by default."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "yinyang")
    kind = vectors.schema[vec_id].dataType
    found = T.StructType([T.StructField(vec_id, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    at = starts(vectors, k, seed, vec_id=vec_id, vector=vector, dim=dim)
    if not at:
        extra = {"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")}
        return spark.createDataFrame([], found).withColumns(extra)
    g = grouped(at, min(groups or max(2, k // 10), len(at)))
    blocks = vector_blocks(vectors, vec_id=vec_id, vector=vector, dim=dim)
    with bounded_batches(spark):
        state, moved = None, None
        for _ in range(rounds):
            d = blocks.drop("ids") if state is None else blocks.drop("ids").join(state.drop("sums"), "block")
            former, state = state, bucketed(d.mapInArrow(_step(dim, g, moved), _STATE), "block", "bounds")
            if former is not None:
                former._drop()
            new = _means(state, g.at)
            moved = [_away(a, b) for a, b in zip(new, g.at, strict=True)]
            same, g = new == g.at, Groups(new, g.group)
            if same:  # all further rounds repeat this one
                break

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.select([c for c in batch.schema.names if c != "ids"]).to_pylist()):
                    x = _unpack(row["x"], row["wide"], dim)
                    b = Bounds(x, g, row if moved else None, moved)
                    d = [int(v) if v < 1 << 63 else None for v in _squares(x, b.c[b.own])]
                    yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(b.own, pa.int32()), pa.array(d, pa.int64())], names)

        names = [vec_id, "cluster", "distance"]
        d = blocks if state is None else blocks.join(state.drop("sums"), "block")
        out = scratch.write(d.mapInArrow(last, found))
    fits = lambda v: F.expr(f"try_cast({v} as long)")
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sha = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(g.at)]
    each = out.groupBy("cluster").agg(total.alias("own"), F.count("*").alias("n"))  # as many rows as centroids
    every = each.agg(F.when(F.count("own") == F.count("*"), F.sum("own")).alias("every"))
    each = each.crossJoin(F.broadcast(every)).join(F.broadcast(spark.createDataFrame(sha, "cluster int, centroid_sha256 string")), "cluster")
    each = each.select("cluster", fits("own").alias("cluster_inertia"), fits("every").alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(each), "cluster").select(*names, "cluster_inertia", "inertia", "centroid_sha256")
