"""The features of one large GeoJSON collection, read by ranges of its bytes.

What a byte of JSON means depends on all before it, but only through two things: whether it stands in a
string, and how deep. For a range, both at its end follow from both at its start by a map of a few
numbers, found in all ranges at once; composed in order, these give the state that each range
begins in. Then every range reads the features that begin in it, to their ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trackforge.sources.pbf import files_of, located, range_size

RANGE = 32 << 20
_QUOTE, _ESCAPE = ord('"'), ord("\\")


@dataclass
class Marks:
    """A range's quotes that aren't escaped, and the depth that its brackets outside of strings change."""

    data: np.ndarray
    inside: np.ndarray  # whether each byte is in a string (its quotes: the first is, the last isn't)
    step: np.ndarray

    @classmethod
    def of(cls, data: bytes, before: bytes, in_string: bool) -> Marks:
        a = np.frombuffer(data, np.uint8)
        quote = a == _QUOTE
        slash = np.flatnonzero(a == _ESCAPE)
        run = len(before) - len(before.rstrip(b"\\"))  # of backslashes that end in front of the range
        if len(slash) or run:
            begins = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
            size = np.diff(np.append(begins, len(slash)))
            if len(slash) and slash[0] == 0:
                size[0] += run
            ends = slash[begins] + np.diff(np.append(begins, len(slash)))  # the byte after a run of them
            if run and (not len(slash) or slash[0] > 0):
                size, ends = np.append(size, run), np.append(ends, 0)
            ends = ends[(size % 2 == 1) & (ends < len(a))]
            quote[ends] = False
        inside = (np.cumsum(quote) + in_string) % 2 == 1
        step = np.where((a == ord("{")) | (a == ord("[")), 1, 0) - np.where((a == ord("}")) | (a == ord("]")), 1, 0)
        return cls(a, inside, np.where(inside, 0, step))


def _before(f, start: int) -> bytes:
    """Enough of what stands in front of a range to count the backslashes that end there."""
    size = 64
    while True:
        at = max(0, start - size)
        f.seek(at)
        held = f.read(start - at)
        if at == 0 or held.rstrip(b"\\"):
            return held
        size *= 8


def features(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """value: the text of each feature of a file, or of a folder's (hidden ones aside), by tasks of a range each."""
    files = [x for x in files_of(path, "") if os.path.basename(x.path)[0] not in "._" and x.size]
    size = range_size(size, RANGE, sum(f.size for f in files))
    rows = [(k, f.path, at, min(at + size, f.size), f.size) for k, f in enumerate(files) for at in range(0, f.size, size)]
    if not rows:
        return spark.createDataFrame([], "value string")
    ranges = spark.createDataFrame(rows, "file long, path string, start long, end long, size long").repartition(len(rows), "path", "start")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = located(path)[0]
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(r["path"]) as f:
                    before = _before(f, r["start"])
                    f.seek(r["start"])
                    data = f.read(r["end"] - r["start"])
                out = [Marks.of(data, before, s) for s in (False, True)]
                values = [r["file"], r["start"], bool(out[0].inside[-1]), *[int(m.step.sum()) for m in out]]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["file", "start", "flips", "outside", "inside"])

    state: dict[tuple[int, int], tuple[bool, int]] = {}
    last, in_string, depth = None, False, 0
    for r in sorted(ranges.mapInArrow(summary, "file long, start long, flips boolean, outside long, inside long").collect()):
        if r["file"] != last:
            last, in_string, depth = r["file"], False, 0
        state[r["file"], r["start"]] = in_string, depth
        depth += r["inside"] if in_string else r["outside"]
        in_string ^= r["flips"]
    known = spark.createDataFrame([(*r, *state[r[0], r[2]]) for r in rows], "file long, path string, start long, end long, size long, in_string boolean, depth long").repartition(len(rows), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = located(path)[0]
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(r["path"]) as f:
                    before = _before(f, r["start"])
                    f.seek(r["start"])
                    data = f.read(r["end"] - r["start"])
                    m = Marks.of(data, before, r["in_string"])
                    depth = r["depth"] + np.cumsum(m.step)
                    # an element of the collection's array is an object three deep
                    begin = np.flatnonzero((m.step == 1) & (m.data == ord("{")) & (depth == 3))
                    end = np.flatnonzero((m.step == -1) & (depth == 2))
                    upto = np.append(end, -1)[np.searchsorted(end, begin)]
                    texts = [data[a : b + 1] for a, b in zip(begin.tolist(), upto.tolist(), strict=True) if b >= 0]
                    if len(begin) and upto[-1] < 0:
                        texts.append(_rest(f, data[begin[-1] :], data[: begin[-1]] or before, r["end"]))
                yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["value"])

    return known.mapInArrow(read, "value string")


def _rest(f, held: bytes, before: bytes, at: int) -> bytes:
    """The whole of an object that begins held: reads on, twice as far each time, until it is closed."""
    size = 1 << 16
    while True:
        f.seek(at)
        more = f.read(size)
        whole = held + more
        depth = np.cumsum(Marks.of(whole, before, False).step)
        closed = np.flatnonzero(depth == 0)
        if len(closed):
            return whole[: closed[0] + 1]
        if len(more) < size:
            raise ValueError("a feature doesn't end")
        size *= 2
