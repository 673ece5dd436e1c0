"""Kalman filters along tracks that are longer than a task, as scans over an associative product.

A filter step is an element (A, b, C, eta, J): what it makes of any state before it, with a mean A m + b and a
covariance C + ... that eta and J correct for what is seen [Särkkä and García-Fernández, 2021]. Elements of
neighbours combine into one, so a chunk of rows is one element, found by pairs; a walk over the
chunks' elements, a few numbers each, gives the state at which each chunk begins, and the filter then
runs in all chunks at once. Steps are those of the sequential filters, so the results are theirs, to rounding.
For places and speeds, whose steps may be hours long, covariances go first, as products of matrices without
a negative number; with them, what a chunk makes of a place and speed is linear.

Whether a vehicle moves has a memory of its own: it flips after some seconds of turning speed. Flips are
the runs of runs.py: where the next one is depends on the row and direction of the last alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.core import Track
from trackforge.operators import runs
from trackforge.sources.shared import written


@dataclass
class Elements:
    """A stack of n steps: states of d numbers, means of several columns that share covariances."""

    a: np.ndarray  # n, d, d
    b: np.ndarray  # n, d, columns
    c: np.ndarray  # n, d, d
    eta: np.ndarray  # n, d, columns
    j: np.ndarray  # n, d, d

    def __getitem__(self, at: slice) -> Elements:
        return Elements(self.a[at], self.b[at], self.c[at], self.eta[at], self.j[at])

    def then(self, late: Elements) -> Elements:
        """Each step followed by one of the other stack."""
        one, t = np.eye(self.a.shape[1]), lambda m: np.swapaxes(m, 1, 2)
        e = late.a @ np.linalg.inv(one + self.c @ late.j)
        g = t(self.a) @ np.linalg.inv(one + late.j @ self.c)
        return Elements(e @ self.a, e @ (self.b + self.c @ late.eta) + late.b, e @ self.c @ t(late.a) + late.c, g @ (late.eta - late.j @ self.b) + self.eta, g @ late.j @ self.a + self.j)

    def product(self) -> Elements:
        """All steps as one, by pairs of neighbours."""
        x = self
        while (n := len(x.a)) > 1:
            rest = x[n - 1 :] if n % 2 else None
            x = x[0 : n - n % 2 : 2].then(x[1::2])
            if rest is not None:
                x = Elements(*(np.concatenate([u, v]) for u, v in zip(x.parts(), rest.parts(), strict=True)))
        return x

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.b, self.c, self.eta, self.j

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray, d: int, columns: int) -> Elements:
        sizes = [d * d, d * columns, d * d, d * columns, d * d]
        shapes = [(1, d, d), (1, d, columns), (1, d, d), (1, d, columns), (1, d, d)]
        return cls(*(p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes, strict=True)))


def walk_steps(z: np.ndarray, q: float, r: float) -> Elements:
    """A random walk's steps: sights z (one column), NaN for none."""
    n, known = len(z), ~np.isnan(z)
    cube = lambda v: np.broadcast_to(np.asarray(v, float), (n,)).reshape(n, 1, 1)
    k, s = np.where(known, q / (q + r), 0.0), q + r
    y = np.where(known, z, 0.0)
    return Elements(cube(1 - k), cube(k * y), cube((1 - k) * q), cube(np.where(known, y / s, 0.0)), cube(np.where(known, 1 / s, 0.0)))


#: A constant-velocity filter's covariance (place and speed along an axis, alike on both axes) is kept as p11, p12, p22 and
#: its determinant. A step is then made of sums and products of what isn't negative, so that no digits cancel, however long
#: the step: (1 - gain) * p11 has none left when a row follows hours after the last.


def fresh(p0: float) -> tuple[float, float, float, float]:
    """The covariance at a start."""
    return p0, 0.0, p0, p0 * p0


def gains(dt: np.ndarray, on: np.ndarray, q: float, r: float, p0: float, cov: tuple[float, float, float, float]) -> np.ndarray:
    """Each step's gains of place and speed, and what stays of the place before and, by second, of the speed:
    n x 4. Zeros where not on, from where the covariance is that of a start again."""
    out = np.zeros((len(dt), 4))
    p11, p12, p22, det = cov
    for i, (d, moves) in enumerate(zip(dt.tolist(), on.tolist(), strict=True)):
        if not moves:
            p11, p12, p22, det = fresh(p0)
            continue
        s11, s12, s22 = p11 + 2 * d * p12 + d * d * p22 + q, p12 + d * p22, p22 + q
        n, det = s11 + r, det + q * (p22 + s11)
        out[i] = s11 / n, s12 / n, r / n, (p11 + d * p12 + q + r) / n
        p11, p12, p22, det = r * s11 / n, r * s12 / n, (det + r * s22) / n, r * det / n
    return out


def covariance_steps(dt: np.ndarray, on: np.ndarray, q: float, r: float, p0: float) -> np.ndarray:
    """Steps of the covariance as matrices of what isn't negative, that map (1, p11, p12, p22, determinant) to a multiple
    of what follows: n x 5 x 5."""
    m = np.zeros((len(dt), 5, 5))
    ahead = np.stack([np.ones_like(dt), 2 * dt, dt * dt], 1)  # of the place, from p11, p12, p22
    m[:, 0, 0], m[:, 0, 1:4] = q + r, ahead
    m[:, 1, 0], m[:, 1, 1:4] = r * q, r * ahead
    m[:, 2, 2], m[:, 2, 3] = r, r * dt
    m[:, 3, 0], m[:, 3, 1:4], m[:, 3, 4] = q * q + r * q, q * ahead, 1
    m[:, 3, 3] += q + r
    m[:, 4, 0], m[:, 4, 1:4], m[:, 4, 4] = r * q * q, r * q * ahead, r
    m[:, 4, 3] += r * q
    m[~on] = np.outer([1.0, *fresh(p0)], [1.0, 0, 0, 0, 0])
    return m


def covariance_product(m: np.ndarray) -> np.ndarray:
    """All steps as one, by pairs of neighbours; the largest number is 1."""
    while len(m) > 1:
        rest = m[len(m) - len(m) % 2 :]
        m = np.concatenate([m[1::2] @ m[0 : len(m) - len(rest) : 2], rest])
        m = m / m.max((1, 2), keepdims=True)
    return m[0]


def place_map(z: np.ndarray, dt: np.ndarray, on: np.ndarray, rest: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What steps with gains g make of a state (place and speed along both axes): (from, to, slope), 2 x 2 each. The first
    sight at rest, from, becomes to, and what a state differs from it by, is multiplied by the slope."""
    start = np.stack([z[0], np.zeros(2)])
    x, u, a = start[0], start[1], np.eye(2)
    for i, d in enumerate(dt.tolist()):
        if on[i]:
            (g1, g2, k1, k2), ahead = g[i], x + d * u
            x, u, a = ahead + g1 * (z[i] - ahead), u + g2 * (z[i] - ahead), np.array([[k1, k1 * d], [-g2, k2]]) @ a
        else:
            x, u, a = rest[i], np.zeros(2), np.zeros((2, 2))
    return np.stack([start, np.stack([x, u]), a])


class Moving(runs.Chunk):
    """Flips of whether a vehicle moves. Node 0 is the track's first row, standing; node 1 + 2 * row + state a flip into
    that state at a row."""

    def __init__(self, time: np.ndarray, speed: np.ndarray, move: float, stop: float, hold: float):
        n = len(time)
        self.time, self.hold, self.rows, self.n = time, hold, n, 2 * n + 1
        self.turns = [speed > move, speed < stop]
        self.fires, self.ends, self.begins = [], [], []
        for turns in self.turns:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], turns, [False]]).astype(int)))
            begin, end = edge[::2], edge[1::2] - 1  # maximal stretches of turning rows
            first = np.minimum(np.searchsorted(time, time[begin] + hold) if len(begin) else begin, n)
            for k in range(len(begin)):  # the sum may round otherwise than the difference that decides
                first[k] = self._fire(begin[k], end[k], time[begin[k]], int(first[k]))
            own = np.zeros(n, np.int64) - 1
            for k, (u, v) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                own[u : v + 1] = k
            self.begins.append(own)
            self.ends.append(end)
            self.fires.append(np.where(first <= end, first, n))
        self.later = [np.minimum.accumulate(np.append(f, n)[::-1])[::-1] for f in self.fires]  # the first firing row of a stretch or one after it
        self.next = np.full(self.n, self.n)
        self.next[0] = self._flip(0, 0, np.nan)
        for row in range(n - 1):
            for state in (0, 1):
                self.next[1 + 2 * row + state] = self._flip(row + 1, state, np.nan)

    def _fire(self, begin: int, end: int, since: float, guess: int) -> int:
        """The first row from begin to end at which it has been turning for long enough; beyond the end: none."""
        k = max(begin, guess - 1)
        while k <= end and not self.time[k] - since >= self.hold:
            k += 1
        return k

    def _flip(self, row: int, state: int, since: float) -> int:
        """The node of the first flip from a row on, in a state, turning since then (NaN: not)."""
        k = int(self.begins[state][row]) if row < self.rows else -1
        if k >= 0:
            end, start = int(self.ends[state][k]), self.time[row] if since != since else since
            at = self._fire(row, end, start, int(np.searchsorted(self.time, start + self.hold)))
            if at > end:
                at = int(self.later[state][k + 1])
        else:
            after = int(np.searchsorted(self.ends[state], row))
            at = int(self.later[state][after])
        return 1 + 2 * at + (1 - state) if at < self.rows else self.n

    def states(self, rows: np.ndarray) -> np.ndarray:
        state = np.where(rows == 0, 0, (rows - 1) & 1)
        first = np.where(rows == 0, 0, (rows - 1) // 2 + 1)
        return np.array([self._open(int(s), int(f), np.nan) for s, f in zip(state, first, strict=True)]).reshape(-1, 2)

    def _open(self, state: int, first: int, since: float) -> tuple[float, float]:
        """(state, since when it has been turning at the chunk's end) of one that didn't flip from a row on."""
        if not self.rows or first >= self.rows:
            return state, since
        k = int(self.begins[state][-1])
        if k < 0:
            return state, np.nan
        begin = int(np.flatnonzero(self.begins[state] == k)[0])
        if begin > first:
            return state, self.time[begin]
        return state, since if since == since else self.time[first]

    def enter(self, states: np.ndarray) -> np.ndarray:
        return np.array([self._flip(0, int(s), t) for s, t in states], np.int64)

    def passed(self, states: np.ndarray) -> np.ndarray:
        return np.array([self._open(int(s), 0, t) for s, t in states]).reshape(-1, 2)

    def moves(self, nodes: np.ndarray, going: int) -> np.ndarray:
        """Whether it moves at each row, from the nodes reached and the run that goes on into the chunk."""
        node = going & 0xFFFFFFFF if going >= 0 else 0
        out = np.full(self.rows, bool(node and (node - 1) & 1))
        for k in nodes.tolist():
            if k:
                out[(k - 1) // 2 :] = bool((k - 1) & 1)
        return out


def filtered(df: DataFrame, t: Track, columns: list[str], rows: int, before: int, passes: list[tuple[Callable, Callable]], finish: Callable, added: list[tuple[str, T.DataType]], make: runs.Make | None = None) -> DataFrame:
    """df with the columns that finish(columns, before, extra) gives for each chunk.

    passes: (summary(columns, before, extra), walk(summaries)) one after the other. A chunk's summary is a few numbers; from
    those of a track's chunks in order, a row each, the walk makes the states at which they begin. extra: (nodes, run going
    on) of the chunk where make is given, and the states of the passes before.
    """
    table = runs.chunks(df, t, columns, rows, before, 0)
    if make:
        e = runs.entries(table, columns, make).withColumnRenamed("track", "of").withColumnRenamed("chunk", "of_chunk")
        table = table.join(written(e, "entries"), F.col("track").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk"))).drop("of", "of_chunk")
    track = table.schema["track"]
    doubles = T.ArrayType(T.DoubleType())

    def each(batches: Iterator[pa.RecordBatch], states: int) -> Iterator[tuple[pa.RecordBatch, int, dict, int, tuple]]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = lambda c, i=i, batch=batch: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                own = {name: np.concatenate([one(f"before_c{k}"), one(f"c{k}")]) for k, name in enumerate(columns)}
                halo, extra = len(one("before_c0")), ()
                if make:
                    c, entry, going = make(own, halo, 0), batch.column("entry")[i].as_py(), batch.column("run")[i].as_py()
                    extra = (c, c.reached(c.n if entry is None else entry), -1 if going is None else going)
                yield batch, i, own, halo, (*extra, *[one(f"state{k}") for k in range(states)])

    def entered(table: DataFrame, k: int, summary: Callable, walk: Callable) -> DataFrame:
        """table with the states of pass k."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, i, own, halo, extra in each(batches, k):
                flat = np.ravel(summary(own, halo, extra)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("track").slice(i, 1), batch.column("chunk").slice(i, 1), pa.array([flat])], ["track", "chunk", "flat"])

        def walked(table: pa.Table) -> pa.Table:
            chunk = table.column("chunk").to_numpy()
            flat = np.stack([table.column("flat")[i].values.to_numpy() for i in np.argsort(chunk)])
            return pa.table({"track": table.column("track"), "chunk": pa.array(np.sort(chunk), pa.int32()), f"state{k}": pa.array([np.ravel(s).tolist() for s in walk(flat)])})

        summed = written(table.mapInArrow(sums, T.StructType([track, T.StructField("chunk", T.IntegerType()), T.StructField("flat", doubles)])), "sums")
        states = summed.groupBy("track").applyInArrow(walked, T.StructType([track, T.StructField("chunk", T.IntegerType()), T.StructField(f"state{k}", doubles)]))
        states = written(states, "states").withColumnRenamed("track", "of").withColumnRenamed("chunk", "of_chunk")
        return table.join(states, F.col("track").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk"))).drop("of", "of_chunk")

    for k, (summary, walk) in enumerate(passes):
        table = entered(table, k, summary, walk)
    schema = T.StructType([T.StructField("_track", track.dataType), T.StructField("_seq", table.schema["seq"].dataType.elementType), *[T.StructField(n, k) for n, k in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, own, halo, extra in each(batches, len(passes)):
            made = finish(own, halo, extra)
            seq = batch.column("seq")[i].values
            yield pa.RecordBatch.from_arrays([batch.column("track").take(pa.array(np.full(len(seq), i))), seq, *[pa.array(made[n], from_pandas=True) for n, _ in added]], schema.names)

    out = table.mapInArrow(run, schema)
    rest = df.drop(*[n for n, _ in added])
    return rest.join(out, F.col(t.track).eqNullSafe(F.col("_track")) & (F.col(t.seq) == F.col("_seq"))).drop("_track", "_seq")


def walk_states(flat: np.ndarray) -> list[np.ndarray]:
    """(mean, covariance) of a random walk at which chunks begin: from their elements, and the first sight in each (NaN: none)."""
    size = flat.shape[1] - 1
    known = flat[~np.isnan(flat[:, size]), size]
    one = lambda v: np.full((1, 1, 1), float(v))
    state, out = Elements(one(0), one(known[0] if len(known) else 0), one(1), one(0), one(0)), []
    for f in flat:
        out.append(np.array([state.b[0, 0, 0], state.c[0, 0, 0]]))
        state = state.then(Elements.of(f[:size], 1, 1))
    return out


def covariance_states(flat: np.ndarray, p0: float) -> list[np.ndarray]:
    """The covariances at which chunks begin, from their products."""
    w, out = np.array([1.0, *fresh(p0)]), []
    for m in flat.reshape(-1, 5, 5):
        out.append(w[1:])
        w = m @ w
        w = w / w[0]
    return out


def place_states(flat: np.ndarray) -> list[np.ndarray]:
    """The states at which chunks begin, from their maps."""
    maps = flat.reshape(-1, 3, 2, 2)
    state, out = maps[0, 0], []
    for start, end, slope in maps:
        out.append(state)
        state = end + slope @ (state - start)
    return out
