"""OSM extracts in PBF: read by byte ranges, as Arrow batches, and written.

A file is a run of blobs, each behind a small header. A task gets a range of bytes and reads the blobs
whose headers begin in it: it looks for the first header by its fixed bytes and takes it for one if the
blob behind it is followed by another header or the file's end. So the driver reads nothing but sizes.

Filters on kind reach the reader, which then passes over the other groups of a block, and so does the
option ``keys`` (tags, parted by commas): only elements with one of them are made, and a block whose
strings have none is passed over as a whole.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

ELEMENT = "kind string, id long, lon double, lat double, refs array<long>, tags map<string,string>"
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])
#: Fixed values of the format: what headers begin with, and the most bytes of a header and of a blob.
_HEAD = re.compile(rb"\x0a\x07OSMData|\x0a\x09OSMHeader")
_MOST_HEAD, _MOST_BLOB = 64 << 10, 32 << 20
#: Bytes of a range; elements of a written block.
RANGE, BLOCK = 32 << 20, 8000


def located(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path or re.match(r"\w+:/", path) else os.path.abspath(path))


def files_of(path: str, ending: str) -> list[FileInfo]:
    """The file, or those of a folder that end so."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == FileType.Directory:
        return sorted((f for f in system.get_file_info(FileSelector(inner)) if f.path.endswith(ending)), key=lambda f: f.path)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    return [info]


# Protocol buffers


def varints(b: bytes) -> np.ndarray:
    """Packed unsigned numbers."""
    a = np.frombuffer(b, np.uint8)
    end = np.flatnonzero(a < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    out, size = np.zeros(len(end), np.uint64), end - start
    for k in range(int(size.max(initial=-1)) + 1):
        at = np.flatnonzero(size >= k)
        out[at] |= (a[start[at] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64)


def signed(v: np.ndarray) -> np.ndarray:
    u = v.view(np.uint64)
    return (u >> np.uint64(1)).view(np.int64) ^ -(v & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers, and the bytes of what is nested or fixed."""
    at, n = 0, len(b)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = b[at]
            at += 1
            out |= (x & 127) << shift
            if x < 128:
                return out
            shift += 7

    while at < n:
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 2: 0, 5: 4}[key & 7] or number()
            yield key >> 3, b[at : at + size]
            at += size


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(*parts: tuple[int, int | bytes]) -> bytes:
    return b"".join(_varint(n << 3 | (0 if isinstance(v, int) else 2)) + (_varint(v) if isinstance(v, int) else _varint(len(v)) + v) for n, v in parts)


def packed(values: Iterable[int], *, zigzag: bool = False) -> bytes:
    return b"".join(_varint((v << 1 if v >= 0 else -2 * v - 1) if zigzag else v) for v in values)


# Reading


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class PbfSource(DataSource):
    """spark.read.format("track_osm_pbf").load(path): kind (node, way), id, lon, lat, refs, tags of a file or of a
    folder's files. Options: keys, and range (bytes of a task). Written, a folder gets a file for each task."""

    @classmethod
    def name(cls) -> str:
        return "track_osm_pbf"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(self.options["path"], int(self.options.get("range", RANGE)), [k for k in self.options.get("keys", "").split(",") if k])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PbfWriter(self.options["path"], overwrite)


#: Tasks that files are cut into, about, where ranges are smaller than they need be.
_TASKS = 256


def range_size(asked: int, usual: int, total: int) -> int:
    """Bytes of a range: as asked for, but so many that the tasks don't grow with the files until ranges are of the usual size."""
    return max(asked, min(usual, -(-total // _TASKS)))


class PbfReader(DataSourceReader):
    def __init__(self, path: str, size: int, keys: list[str]):
        self.path, self.size, self.keys, self.kinds = path, size, keys, {"node", "way"}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds &= set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = list(files_of(self.path, ".pbf"))
        size = range_size(self.size, RANGE, sum(f.size for f in files))
        return [Range(f.path, at, min(at + size, f.size), f.size) for f in files for at in range(0, f.size, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with located(self.path)[0].open_input_file(partition.path) as f:
            at = first_header(f, partition.start, partition.end, partition.size)
            while at is not None and at < partition.end:
                kind, start, size = header_at(f, at, partition.size)
                if kind == b"OSMData":
                    f.seek(start)
                    blob = dict(fields(f.read(size)))
                    yield from elements(blob[1] if 1 in blob else zlib.decompress(blob[3]), self.kinds, self.keys)
                at = start + size if start + size < partition.size else None


def header_at(f: BinaryIO, at: int, size: int) -> tuple[bytes, int, int] | None:
    """(type, where the blob begins, its size) of the header at a place; None if there is none."""
    f.seek(at)
    head = f.read(4)
    if len(head) < 4 or not 0 < (n := struct.unpack(">i", head)[0]) <= _MOST_HEAD:
        return None
    try:
        own = dict(fields(f.read(n)))
    except (IndexError, KeyError):
        return None
    kind, blob = own.get(1), own.get(3)
    good = kind in (b"OSMData", b"OSMHeader") and isinstance(blob, int) and 0 <= blob <= _MOST_BLOB and at + 4 + n + blob <= size
    return (kind, at + 4 + n, blob) if good else None


def first_header(f: BinaryIO, start: int, end: int, size: int, step: int = 1 << 20) -> int | None:
    """Where the first header begins that begins in [start, end)."""
    at = start
    while at < end:
        f.seek(at)
        part = f.read(min(step, end - at) + 16)  # a header's first bytes may lie beyond the step
        for m in _HEAD.finditer(part):
            here = at + m.start() - 4
            if here >= end:
                return None
            if here >= start and (h := header_at(f, here, size)) and (h[1] + h[2] == size or header_at(f, h[1] + h[2], size)):
                return here
        at += step
    return None


def _tagged(keys: np.ndarray, values: np.ndarray, counts: np.ndarray, strings: list[str]) -> pa.Array:
    words = pa.array(strings, pa.string())
    return pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), words.take(pa.array(keys)), words.take(pa.array(values)))


def _batch(kind: str, ids: np.ndarray, tags: pa.Array, keep: np.ndarray, lon=None, lat=None, refs=None) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array([kind]).take(pa.array(np.zeros(n, np.int64))), pa.array(ids), *[pa.nulls(n, pa.float64()) if v is None else pa.array(v) for v in (lon, lat)], pa.nulls(n, _ARROW.field("refs").type) if refs is None else refs, tags]
    out = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
    return out if keep.all() else out.take(pa.array(np.flatnonzero(keep)))


def elements(block: bytes, kinds: set[str], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Nodes and ways of a primitive block."""
    top: dict[int, list] = {}
    for n, v in fields(block):
        top.setdefault(n, []).append(v)
    strings = [v.decode("utf-8", "replace") for n, v in fields(top[1][0]) if n == 1]
    wanted = np.array([i for i, s in enumerate(strings) if s in keys], np.int64)
    if keys and not len(wanted):
        return
    unit, lat0, lon0 = (top.get(n, [d])[0] for n, d in ((17, 100), (19, 0), (20, 0)))
    lat0, lon0 = (v - (1 << 64) if v >= 1 << 63 else v for v in (lat0, lon0))
    place = lambda v, offset: 1e-9 * (offset + unit * v)

    def keep(k: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not keys:
            return np.ones(len(counts), bool)
        return np.bincount(np.repeat(np.arange(len(counts)), counts), np.isin(k, wanted), len(counts)) > 0

    for group in top.get(2, []):
        plain: dict[str, list[dict]] = {"node": [], "way": []}
        for n, v in fields(group):
            if n == 2 and "node" in kinds:
                m = dict(fields(v))
                ids, lats, lons = (np.cumsum(signed(varints(m[k]))) for k in (1, 8, 9))
                flat = varints(m.get(10, b""))
                # keys and values of each node, then a 0
                ends = []
                at = 0
                for _ in ids if len(flat) else ():
                    while flat[at]:
                        at += 2
                    ends.append(at)
                    at += 1
                ends = np.array(ends if len(flat) else np.zeros(len(ids)), np.int64)
                counts = (np.diff(ends, prepend=-1) - 1) // 2 if len(flat) else ends
                pairs = np.delete(flat, ends) if len(flat) else flat
                k = pairs[::2]
                yield _batch("node", ids, _tagged(k, pairs[1::2], counts, strings), keep(k, counts), place(lons, lon0), place(lats, lat0))
            elif n in (1, 3) and (kind := "node" if n == 1 else "way") in kinds:
                plain[kind].append(dict(fields(v)))
        for kind, found in plain.items():
            if not found:
                continue
            k, v = ([varints(m.get(n, b"")) for m in found] for n in (2, 3))
            counts = np.array([len(x) for x in k])
            k, v = np.concatenate(k), np.concatenate(v)
            tags, good = _tagged(k, v, counts, strings), keep(k, counts)
            ids = np.array([m[1] for m in found], np.uint64).view(np.int64)
            if kind == "node":
                lat, lon = (signed(np.array([m[n] for m in found], np.uint64).view(np.int64)) for n in (8, 9))
                yield _batch(kind, signed(ids), tags, good, place(lon, lon0), place(lat, lat0))
            else:
                refs = [np.cumsum(signed(varints(m.get(8, b"")))) for m in found]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in refs])]), pa.int32())
                yield _batch(kind, ids, tags, good, refs=pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(refs))))


# Writing


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    path: str


class PbfWriter(DataSourceArrowWriter):
    """A file a task, under another name until all tasks are done. Places are kept to 1e-7 degrees."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, inner = located(self.path)
        system.create_dir(inner)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.osm.pbf"
        out = Written(f"{inner}/_{name}.tmp", f"{inner}/{name}")
        with system.open_output_stream(out.temporary) as f:
            f.write(blob(b"OSMHeader", message((4, b"OsmSchema-V0.6"), (4, b"DenseNodes"))))
            for batch in batches:
                for kind in ("node", "way"):
                    own = batch.filter(pc.equal(batch.column("kind"), kind))
                    for at in range(0, own.num_rows, BLOCK):
                        f.write(blob(b"OSMData", block_of(kind, own.slice(at, BLOCK))))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = located(self.path)
        new = {m.path for m in messages if m}
        if self.overwrite:
            for f in files_of(self.path, ".pbf"):
                system.delete_file(f.path)
        for m in messages:
            if m:
                system.move(m.temporary, m.path)
        assert len(new) == len([m for m in messages if m])

    def abort(self, messages: list[Written | None]) -> None:
        system = located(self.path)[0]
        for m in messages:
            if m:
                system.delete_file(m.temporary)


def blob(kind: bytes, data: bytes) -> bytes:
    body = message((2, len(data)), (3, zlib.compress(data)))
    head = message((1, kind), (3, len(body)))
    return struct.pack(">i", len(head)) + head + body


def block_of(kind: str, rows: pa.RecordBatch) -> bytes:
    """A primitive block of nodes (dense) or of ways."""
    strings: dict[str, int] = {"": 0}
    number = lambda s: strings.setdefault(s, len(strings))
    tags = [[(number(k), number(v)) for k, v in t or ()] for t in rows.column("tags").to_pylist()]
    ids = rows.column("id").to_pylist()
    steps = lambda v: packed(np.diff(np.array(v, np.int64), prepend=0).tolist(), zigzag=True)
    if kind == "node":
        lat, lon = (np.round(rows.column(c).to_numpy(zero_copy_only=False) * 1e7).astype(np.int64) for c in ("lat", "lon"))
        flat = [x for t in tags for x in (*(y for pair in t for y in pair), 0)] if any(tags) else []
        group = message((2, message((1, steps(ids)), (8, steps(lat)), (9, steps(lon)), (10, packed(flat)))))
    else:
        refs = rows.column("refs").to_pylist()
        group = b"".join(message((3, message((1, i), (2, packed(k for k, _ in t)), (3, packed(v for _, v in t)), (8, steps(x or []))))) for i, t, x in zip(ids, tags, refs, strict=True))
    return message((1, message(*[(1, s.encode()) for s in strings])), (2, group))
