"""Runs along tracks that are longer than a task: where one ends depends on where it began.

A track is cut into chunks of consecutive rows. Within a chunk the row where a run from each row
would end, its next row, is found for all rows at once; rows whose run goes on beyond the chunk are
open, and ask the chunks after it. Pointer jumping gives the open row that each row of a chunk
leads to, so a chunk is a map from the row it is entered at to the row entered next, somewhere
later. A walk over these maps, a few numbers a chunk, says where each chunk is entered; the runs of
a chunk are then the rows reachable from there, found in all chunks at once.

Time and place must be numbers; null is NaN. Rows of a track are told apart by seq. Chunks are asked in rounds, as many
as the longest run has chunks; each is a small job over open rows alone and the chunks asked.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.core import Track
from trackforge.sources.shared import written


class Chunk(ABC):
    """A chunk's columns, with some rows of its neighbours around it."""

    n: int
    next: np.ndarray  # of each row, the first row of the run after the one that begins there; n: beyond the chunk

    @abstractmethod
    def states(self, rows: np.ndarray) -> np.ndarray:
        """What a later chunk needs to know of open rows: a line of numbers each."""

    @abstractmethod
    def enter(self, states: np.ndarray) -> np.ndarray:
        """The row at which runs in these states end here; n: none."""

    def passed(self, states: np.ndarray) -> np.ndarray:
        """States that no row here ends, after this chunk."""
        return states

    def last(self) -> np.ndarray:
        """The open row that each row leads to, by pointer jumping."""
        to = np.where(self.next < self.n, self.next, np.arange(self.n))
        while (to[to] != to).any():
            to = to[to]
        return to

    def reached(self, entry: int) -> np.ndarray:
        """The rows at which runs begin, from the one that the chunk is entered at."""
        out, to = [], self.next.tolist()
        while entry < self.n:
            out.append(entry)
            entry = to[entry]
        return np.array(out, np.int64)


#: From columns and the number of rows before and after that are neighbours', a chunk.
Make = Callable[[dict[str, np.ndarray], int, int], Chunk]


#: Values in lists that make a batch of many short chunks' lines; a batch for each line would cost more than its work.
GATHERED = 100_000


def gathered(lines: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Lines (an array of one row, or of a list's values, or a number for each column) as batches of many."""

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        if isinstance(values[0], pa.Array):
            return pa.concat_arrays(values)
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        offsets = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(values).astype(kind.value_type.to_pandas_dtype())))

    held, size = [], 0
    for line in lines:
        held.append(line)
        size += 1 + sum(len(v) for v in line if isinstance(v, np.ndarray))
        if size >= GATHERED:
            yield pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def chunks(df: DataFrame, t: Track, columns: list[str], rows: int, before: int, after: int) -> DataFrame:
    """track, part (the chunk's id), chunk (its number within the track, from 1), n, seq and the columns as lists,
    and the neighbours' rows as before_ and after_ lists. The cut is written, so that it doesn't change."""
    d = df.select(F.col(t.track).alias("track"), F.col(t.seq).alias("seq"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    kinds = d.schema
    schema = T.StructType([T.StructField("track", kinds["track"].dataType), T.StructField("part", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("seq", T.ArrayType(kinds["seq"].dataType)), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 33, [], 0

        def flush(last: bool) -> pa.RecordBatch:
            """The chunks of what is held, but for the last one, which may go on."""
            nonlocal first, held, size
            own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            codes = own.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            at = np.flatnonzero(np.diff(codes)) + 1
            starts = np.concatenate([np.arange(lo, hi, rows) for lo, hi in zip([0, *at.tolist()], [*at.tolist(), len(codes)], strict=True)])
            offsets = pa.array((np.append(starts, len(codes)) if last else starts).astype(np.int32))
            n, rest = len(offsets) - 1, own.slice(offsets[-1].as_py())
            held, size = [rest], rest.num_rows
            lists = [pa.ListArray.from_arrays(offsets, own.column(c)) for c in ("seq", *names)]
            first += n
            return pa.RecordBatch.from_arrays([own.column("track").take(pa.array(starts[:n])), pa.array(np.arange(first - n, first)), pa.array(np.diff(offsets.to_numpy())), *lists], schema.names)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > 2 * rows:
                yield flush(False)
        if size:
            yield flush(True)

    cutted = written(d.repartitionByRange("track", "seq").sortWithinPartitions("track", "seq").mapInArrow(cut, schema), "chunks")
    w = Window.partitionBy("track").orderBy("part")
    edge = lambda c, n, side: F.slice(c, 1, n) if side else F.slice(c, F.greatest(F.size(c) - (n - 1), F.lit(1)), F.lit(n))
    ends = cutted.select("track", "part", *[edge(c, after, True).alias(f"head_{c}") for c in names if after], *[edge(c, before, False).alias(f"tail_{c}") for c in names if before])
    halo = {f"after_{c}": F.slice(F.flatten(F.collect_list(f"head_{c}").over(w.rowsBetween(1, after))), 1, after) if after else F.array().cast("array<double>") for c in names}
    earlier = {c: F.flatten(F.collect_list(f"tail_{c}").over(w.rowsBetween(-before, -1))) if before else F.array().cast("array<double>") for c in names}
    halo |= {f"before_{c}": edge(v, before, False) if before else v for c, v in earlier.items()}
    numbered = ends.select("part", F.row_number().over(w).alias("chunk"), *[v.alias(c) for c, v in halo.items()])
    return cutted.join(written(numbered, "halos"), "part")


def _each(batches: Iterator[pa.RecordBatch], columns: list[str], make: Make) -> Iterator[tuple[pa.RecordBatch, int, Chunk]]:
    for batch in batches:
        flat = {}
        for name in (f"{side}c{k}" for k in range(len(columns)) for side in ("before_", "", "after_")):
            c = batch.column(name)
            flat[name] = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy().tolist()

        def one(name: str, i: int, flat: dict = flat) -> np.ndarray:
            values, at = flat[name]
            return values[at[i] : at[i + 1]]

        for i in range(batch.num_rows):
            cols = {name: np.concatenate([one(f"before_c{k}", i), one(f"c{k}", i), one(f"after_c{k}", i)]) for k, name in enumerate(columns)}
            yield batch, i, make(cols, len(one("before_c0", i)), len(one("after_c0", i)))


def entries(table: DataFrame, columns: list[str], make: Make) -> DataFrame:
    """track, chunk, entry (row at which the chunk is entered, if any), run (the run that goes on into it: chunk << 32 | row)."""
    track = table.schema["track"].dataType
    field = lambda name, kind: T.StructField(name, kind)
    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    # open rows in [lo, hi] of a chunk that no chunk before ``to`` ends lead to its row goal, and from there to its open row (then)
    answer = T.StructType([field("track", track), field("chunk", T.IntegerType()), field("to", T.IntegerType()), *[field(c, ints) for c in ("lo", "hi", "goal", "then")], field("rows", ints), field("states", doubles)])

    nothing = np.zeros(0, np.int64)

    def lines_of(batches: Iterator[pa.RecordBatch], lines: Callable[[pa.RecordBatch, int, Chunk], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
        """lines(batch, i, chunk) of all chunks: chunk, to, lo, hi, goal, then, rows, states, with the track put before them."""
        made = ((batch.column("track").slice(i, 1), *line) for batch, i, c in _each(batches, columns, make) for line in lines(batch, i, c))
        head = next(made, None)
        if head is not None:
            kinds = [head[0].type, pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 5, pa.list_(pa.float64())]
            yield from gathered(chain([head], made), pa.schema(list(zip(answer.names, kinds, strict=True))))

    def asks(batch: pa.RecordBatch, i: int, c: Chunk) -> Iterator[tuple]:
        rows, number = np.flatnonzero(c.next >= c.n), batch.column("chunk")[i].as_py()
        start = np.zeros(1 if number == 1 else 0, np.int64)
        # the track's first row is its entry: what chunk 0 leads to
        yield 0 if number == 1 else -1, number, start, start, start, c.last()[start], nothing, nothing
        yield number, number + 1, *(nothing,) * 4, rows, c.states(rows).ravel()

    def replies(batch: pa.RecordBatch, i: int, c: Chunk) -> Iterator[tuple]:
        rows = batch.column("rows")[i].values.to_numpy()
        states = batch.column("states")[i].values.to_numpy().reshape(len(rows), -1)
        goal = c.enter(states)
        ends, to, asked = goal < c.n, batch.column("to")[i].as_py(), batch.column("asked")[i].as_py()
        # rows that go on part the ranges, too; rows answered before lie in ranges, but the walk takes the first answer
        cut = np.flatnonzero(np.diff(goal, prepend=-1))
        upto = np.append(cut[1:], len(goal))[: len(cut)] - 1
        cut, upto = cut[ends[cut]], upto[ends[cut]]
        g = goal[cut]
        yield asked, to, rows[cut], rows[upto], g, c.last()[g], nothing, nothing
        if not ends.all():
            yield asked, to + 1, *(nothing,) * 4, rows[~ends], c.passed(states[~ends]).ravel()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return lines_of(batches, asks)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return lines_of(batches, replies)

    said = [written(table.mapInArrow(ask, answer), "asked")]
    while True:
        open_ = said[-1].where(F.size("rows") > 0).select(F.col("track").alias("of"), F.col("chunk").alias("asked"), "to", "rows", "states")
        d = table.join(open_, F.col("track").eqNullSafe(F.col("of")) & (table["chunk"] == F.col("to")))
        got = written(d.mapInArrow(reply, answer), "asked")
        said.append(got)
        if not got.where(F.size("rows") > 0).limit(1).count():
            break

    known = said[0]
    for x in said[1:]:
        known = known.unionByName(x)
    known = known.where((F.size("lo") > 0) | (F.col("chunk") == -1)).select("track", "chunk", "to", "lo", "hi", "goal", "then")

    def walk(t: pa.Table) -> pa.Table:
        leads: dict[int, list[tuple]] = {}
        for r in t.select(["chunk", "to", "lo", "hi", "goal", "then"]).to_pylist():
            leads.setdefault(r["chunk"], []).append(r)
        for answers in leads.values():
            answers.sort(key=lambda r: r["to"])
        size = max(r["to"] for r in leads[0] + leads.get(-1, []))
        entry, run = [None] * (size + 1), [None] * (size + 1)
        chunk, row, going = 0, 0, None
        while True:
            hit = next(((r, k) for r in leads.get(chunk, ()) for k in range(len(r["lo"])) if r["lo"][k] <= row <= r["hi"][k]), None)
            to = hit[0]["to"] if hit else size + 1
            for c in range(chunk + 1, min(to, size) + 1):
                run[c] = going
            if not hit:
                break
            entry[to], row, chunk = hit[0]["goal"][hit[1]], hit[0]["then"][hit[1]], to
            going = chunk << 32 | row
        return pa.table({"track": t.column("track").combine_chunks().take(pa.array(np.zeros(size, np.int64))), "chunk": pa.array(range(1, size + 1), pa.int32()), "entry": pa.array(entry[1:], pa.int32()), "run": pa.array(run[1:], pa.int64())})

    schema = T.StructType([field("track", track), field("chunk", T.IntegerType()), field("entry", T.IntegerType()), field("run", T.LongType())])
    return known.groupBy("track").applyInArrow(walk, schema)


def over_chunks(table: DataFrame, entered: DataFrame, columns: list[str], make: Make, finish: Callable[[Chunk, np.ndarray, int, int], dict[str, np.ndarray]], added: list[tuple[str, T.DataType]]) -> DataFrame:
    """finish(chunk, starts of runs, number of the chunk, run that goes on into it or -1) on every chunk: track, seq,
    and the columns added, of the rows that it names as ``rows``."""
    e = entered.withColumnRenamed("track", "of").withColumnRenamed("chunk", "of_chunk")
    d = table.join(e, F.col("track").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk")))
    schema = T.StructType([table.schema["track"], T.StructField("seq", table.schema["seq"].dataType.elementType), *[T.StructField(n, k) for n, k in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(batch: pa.RecordBatch, made: list[tuple[int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
            counts, seq = [len(m["rows"]) for _, m in made], batch.column("seq")
            at = np.repeat([i for i, _ in made], counts)
            rows = np.concatenate([m["rows"] for _, m in made]).astype(np.int64) + seq.offsets.to_numpy()[at]
            new = [pa.array(np.concatenate([m[n] for _, m in made]), from_pandas=True) for n, _ in added]
            return pa.RecordBatch.from_arrays([batch.column("track").take(pa.array(at)), seq.values.take(pa.array(rows)), *new], schema.names)

        held, size, of = [], 0, None
        for batch, i, c in _each(batches, columns, make):
            if held and (batch is not of or size >= GATHERED):
                yield flush(of, held)
                held, size = [], 0
            entry, going = batch.column("entry")[i].as_py(), batch.column("run")[i].as_py()
            made = finish(c, c.reached(c.n if entry is None else entry), batch.column("chunk")[i].as_py(), -1 if going is None else going)
            held.append((i, made))
            size, of = size + len(made["rows"]), batch
        if held:
            yield flush(of, held)

    return d.mapInArrow(run, schema)


def number_of(starts: np.ndarray, n: int, chunk: int, going: int) -> np.ndarray:
    """The run of each row of a chunk."""
    at = np.searchsorted(starts, np.arange(n), side="right") - 1
    own = (chunk << 32) | np.append(starts, 0)
    return np.where(at >= 0, own[at], going)


class Spaced(Chunk):
    """Runs that end at the first row ``least`` away from their first. Boxes around 2, 4, 8, ... rows let a search
    pass over all rows that are too near at once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: float):
        self.x, self.y, self.n, self.least = x, y, len(x), least
        self.boxes = [np.stack([x, x, y, y])]
        with np.errstate(invalid="ignore"):
            while self.boxes[-1].shape[1] > 1:
                b = self.boxes[-1]
                b = b if b.shape[1] % 2 == 0 else np.concatenate([b, b[:, -1:]], 1)
                self.boxes.append(np.stack([np.fmin(b[0, ::2], b[0, 1::2]), np.fmax(b[1, ::2], b[1, 1::2]), np.fmin(b[2, ::2], b[2, 1::2]), np.fmax(b[3, ::2], b[3, 1::2])]))
        self.next = self._first_far(x, y, np.arange(1, self.n + 1))

    def _first_far(self, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
        at, level, out = start.copy(), np.zeros(len(start), np.int64), np.full(len(start), self.n)
        todo = np.flatnonzero(at < self.n)
        while len(todo):
            new, levels = np.zeros(len(todo), bool), level[todo]
            for k in np.unique(levels).tolist():
                here = levels == k
                rows = todo[here]
                b = self.boxes[k][:, at[rows] >> k]
                with np.errstate(invalid="ignore"):
                    dx, dy = np.maximum(x[rows] - b[0], b[1] - x[rows]), np.maximum(y[rows] - b[2], b[3] - y[rows])
                    far = np.sqrt(dx * dx + dy * dy) >= self.least  # as whole tracks and SQL compute it
                if k == 0:
                    out[rows[far]] = at[rows[far]]
                    new[np.flatnonzero(here)[far]] = True
                level[rows[far]] -= 1  # look closer
                near = rows[~far]
                at[near] = ((at[near] >> k) + 1) << k
                up = (at[near] & ((2 << k) - 1)) == 0
                level[near[up]] = min(k + 1, len(self.boxes) - 1)
            todo = todo[~new]
            todo = todo[at[todo] < self.n]
        return out

    def states(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([self.x[rows], self.y[rows]], 1)

    def enter(self, states: np.ndarray) -> np.ndarray:
        return self._first_far(states[:, 0], states[:, 1], np.zeros(len(states), np.int64))
