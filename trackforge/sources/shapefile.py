"""Shapefiles with their attributes: read by ranges of records, as Arrow batches, and written.

The .shx index has eight bytes a record, so a task finds its records by itself; without one, a file
is a task's. Attributes are read from the .dbf by their places, those of the option ``columns`` only, if
it is given. A .prj that isn't WGS 84 in degrees is an error unless the option ``crs`` is "any".
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from trackforge.sources.pbf import files_of, located

LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Records of a task.
RECORDS = 50_000
#: Fixed value: the coordinate system as files name it.
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
_SPARK = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "boolean": T.BooleanType()}
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_()}


@dataclass(frozen=True)
class Attribute:
    """A column of a .dbf: its name here, kind, and place in a record."""

    name: str
    kind: str
    at: int
    size: int


def beside(path: str, ending: str) -> str:
    return path[: -len("shp")] + ending


def attributes(head: bytes, taken: tuple[str, ...] = ("id", "part", "geometry")) -> tuple[list[Attribute], int, int, int]:
    """(columns, records, bytes before them, bytes of each) of a .dbf's first bytes. Names that are taken get
    an underscore in front."""
    n, start, size = struct.unpack("<IHH", head[4:12])
    out, at, names = [], 1, {t.lower() for t in taken}
    for k in range(32, start - 1, 32):
        if head[k] == 0x0D:
            break
        name, kind, width, digits = head[k : k + 11].split(b"\0")[0].decode("latin1"), chr(head[k + 11]), head[k + 16], head[k + 17]
        while name.lower() in names:
            name = "_" + name
        names.add(name.lower())
        own = {"N": "double" if digits or width > 18 else "long", "F": "double", "D": "date", "L": "boolean"}.get(kind, "string")
        out.append(Attribute(name, own, at, width))
        at += width
    return out, n, start, size


def values(kind: str, cells: list[bytes], encoding: str) -> pa.Array:
    def one(c: bytes) -> object:
        t = c.decode(encoding, "replace").strip(" \0")
        if kind == "string":
            return t or None
        try:
            if kind in ("long", "double"):
                return (int if kind == "long" else float)(t)
            if kind == "date":
                return date(int(t[:4]), int(t[4:6]), int(t[6:8]))
            return {"t": True, "y": True, "f": False, "n": False}[t.lower()]
        except (ValueError, KeyError):  # blanks and stars stand for nothing
            return None

    return pa.array([one(c) for c in cells], _ARROW[kind])


def lines(body: bytes) -> list[np.ndarray]:
    """The parts of a record's shape, as arrays of x, y."""
    kind = struct.unpack_from("<i", body)[0] % 10
    if kind == 1:
        return [np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)]
    if kind == 8:
        return [np.frombuffer(body, "<f8", 2 * struct.unpack_from("<i", body, 36)[0], 40).reshape(-1, 2)]
    if kind in (3, 5):
        parts, points = struct.unpack_from("<2i", body, 36)
        starts = np.frombuffer(body, "<i4", parts, 44)
        return np.split(np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2), starts[1:])
    return []


@dataclass
class Records(InputPartition):
    path: str
    first: int
    count: int  # -1: all, without an index


class ShapefileSource(DataSource):
    """spark.read.format("track_shapefile").load(path): id, part, geometry, and the attributes, of a .shp file or of
    a folder's. Options: columns, crs, encoding, records (of a task). Written, a folder gets a file for each
    task, a record for each row; columns other than geometry are attributes."""

    @classmethod
    def name(cls) -> str:
        return "track_shapefile"

    def _columns(self) -> list[Attribute]:
        wanted = self.options.get("columns")
        files = files_of(self.options["path"], ".shp")
        if not files:
            return []
        system = located(self.options["path"])[0]
        if not system.get_file_info(beside(files[0].path, "dbf")).is_file:
            return []
        with system.open_input_file(beside(files[0].path, "dbf")) as f:
            head = f.read(32)
            every = attributes(head + f.read(struct.unpack("<H", head[8:10])[0] - 32))[0]
        names = {c.strip().lower() for c in wanted.split(",")} if wanted is not None else None
        return [a for a in every if names is None or a.name.lower() in names]

    def schema(self) -> T.StructType:
        own = [T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("geometry", LINE)]
        return T.StructType(own + [T.StructField(a.name, _SPARK[a.kind]) for a in self._columns()])

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options["path"], int(self.options.get("records", RECORDS)), self.options.get("crs", "wgs84"), self.options.get("encoding", "utf-8"), [f.name for f in schema.fields[3:]])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShapefileWriter(self.options["path"], overwrite, schema)


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, records: int, crs: str, encoding: str, columns: list[str]):
        self.path, self.records, self.crs, self.encoding, self.columns = path, records, crs, encoding, columns

    def partitions(self) -> list[InputPartition]:
        system, out = located(self.path)[0], []
        for f in files_of(self.path, ".shp"):
            if system.get_file_info(beside(f.path, "prj")).is_file and self.crs != "any":
                with system.open_input_file(beside(f.path, "prj")) as p:
                    text = p.read().decode("latin1")
                if re.match(r"\s*PROJCS", text) or not re.search(r"WGS[_ ]?(19)?84", text):
                    raise ValueError(f"{f.path}: not in degrees of WGS 84 but {text[:60]!r}; reproject it, or set crs to any")
            index = system.get_file_info(beside(f.path, "shx"))
            n = (index.size - 100) // 8 if index.is_file else -1
            out += [Records(f.path, k, min(self.records, n - k)) for k in range(0, n, self.records)] if n >= 0 else [Records(f.path, 0, -1)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        system = located(self.path)[0]
        n = partition.count
        with system.open_input_file(partition.path) as f:
            if struct.unpack(">i", f.read(4))[0] != 9994:
                raise ValueError(f"{partition.path}: not a shapefile")
            if n >= 0:
                with system.open_input_file(beside(partition.path, "shx")) as x:
                    x.seek(100 + 8 * partition.first)
                    place = np.frombuffer(x.read(8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
                at, end = (int(place[0, 0]), int((place.sum(1) + 8).max())) if n else (0, 0)
                f.seek(at)
                data, starts = f.read(end - at), (place[:, 0] - at).tolist()
            else:
                f.seek(100)
                data, starts, k = f.read(), [], 0
                while k + 8 <= len(data):
                    starts.append(k)
                    k += 8 + 2 * struct.unpack_from(">i", data, k + 4)[0]
        shapes = [(struct.unpack_from(">i", data, k)[0], lines(data[k + 8 : k + 8 + 2 * struct.unpack_from(">i", data, k + 4)[0]])) for k in starts]
        rows = [i for i, (_, parts) in enumerate(shapes) for _ in parts]
        xy = [p for _, parts in shapes for p in parts]
        flat = np.concatenate([np.zeros((0, 2)), *xy])
        geometry = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in xy])]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["x", "y"]))
        out = [pa.array([shapes[i][0] for i in rows], pa.int64()), pa.array([k for _, parts in shapes for k in range(len(parts))], pa.int32()), geometry.cast(_POINTS)]
        if self.columns:
            with system.open_input_file(beside(partition.path, "dbf")) as d:
                head = d.read(32)
                every, _, start, size = attributes(head + d.read(struct.unpack("<H", head[8:10])[0] - 32))
                d.seek(start + size * partition.first)
                table = d.read(size * len(shapes))
            by = {a.name: a for a in every}
            for c in self.columns:
                a = by[c]
                out.append(values(a.kind, [table[size * i + a.at : size * i + a.at + a.size] for i in rows], self.encoding))
        yield pa.RecordBatch.from_arrays(out, ["id", "part", "geometry", *self.columns])


# Writing

_PARTS = ("shp", "shx", "dbf", "prj")
_WIDTHS = {"string": 254, "long": 18, "double": 24, "date": 8, "boolean": 1}


@dataclass
class Files(WriterCommitMessage):
    temporary: str
    path: str


class ShapefileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, schema: T.StructType):
        self.path, self.overwrite, self.schema = path, overwrite, schema
        if "geometry" not in schema.names or schema["geometry"].dataType.simpleString().split("<")[0] != "array":
            raise ValueError("a column geometry, an array of x, y, is needed")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        from pyspark import TaskContext

        system, inner = located(self.path)
        system.create_dir(inner)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        out = Files(f"{inner}/_{name}", f"{inner}/{name}")
        kinds = {f.name: {"int": "long", "bigint": "long", "smallint": "long", "float": "double"}.get(f.dataType.simpleString(), f.dataType.simpleString().replace("bigint", "long")) for f in self.schema.fields if f.name != "geometry"}
        kinds = {c: k if k in _WIDTHS else "string" for c, k in kinds.items()}
        low, high, at, n = np.full(2, np.inf), np.full(2, -np.inf), 50, 0
        size = 1 + sum(_WIDTHS[k] for k in kinds.values())
        open_ = {p: system.open_output_stream(f"{out.temporary}.{p}") for p in ("shp.body", "shx.body", "dbf.body")}
        for batch in batches:
            for row in batch.to_pylist():
                xy = np.array([(p["x"], p["y"]) for p in row["geometry"] or ()], "<f8").reshape(-1, 2)
                n += 1
                if len(xy):
                    a, b = xy.min(0), xy.max(0)
                    low, high = np.minimum(low, a), np.maximum(high, b)
                    body = struct.pack("<i4d3i", 3, *a, *b, 1, len(xy), 0) + xy.tobytes()
                else:
                    body = struct.pack("<i", 0)
                open_["shp.body"].write(struct.pack(">2i", n, len(body) // 2) + body)
                open_["shx.body"].write(struct.pack(">2i", at, len(body) // 2))
                at += 4 + len(body) // 2
                open_["dbf.body"].write(b" " + b"".join(cell(row[c], k) for c, k in kinds.items()))
        for f in open_.values():
            f.close()
        box = [0.0] * 4 if not n or not np.isfinite(low).all() else [*low, *high]
        heads = {p: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 3, *box, 0, 0, 0, 0) for p, words in (("shp", at), ("shx", 50 + 4 * n))}
        names = b"".join(c.encode("utf-8")[:10].ljust(11, b"\0") + {"string": b"C", "long": b"N", "double": b"F", "date": b"D", "boolean": b"L"}[k] + b"\0" * 4 + bytes([_WIDTHS[k], 12 if k == "double" else 0]) + b"\0" * 14 for c, k in kinds.items())
        heads["dbf"] = struct.pack("<4BIHH20x", 3, 95, 7, 26, n, 33 + len(names), size) + names + b"\r"
        for p, head in heads.items():
            with system.open_output_stream(f"{out.temporary}.{p}") as to, system.open_input_stream(f"{out.temporary}.{p}.body") as body:
                to.write(head)
                while part := body.read(1 << 20):
                    to.write(part)
            system.delete_file(f"{out.temporary}.{p}.body")
        with system.open_output_stream(f"{out.temporary}.prj") as to:
            to.write(WGS84.encode())
        return out

    def commit(self, messages: list[Files | None]) -> None:
        system = located(self.path)[0]
        if self.overwrite:
            for f in files_of(self.path, ".shp"):
                for p in _PARTS:
                    if not os.path.basename(f.path).startswith("_") and system.get_file_info(beside(f.path, p)).is_file:
                        system.delete_file(beside(f.path, p))
        for m in messages:
            for p in reversed(_PARTS) if m else ():  # the .shp last: it makes the others seen
                system.move(f"{m.temporary}.{p}", f"{m.path}.{p}")

    def abort(self, messages: list[Files | None]) -> None:
        system = located(self.path)[0]
        for m in messages:
            for p in _PARTS if m else ():
                system.delete_file(f"{m.temporary}.{p}")


def cell(v: object, kind: str) -> bytes:
    width = _WIDTHS[kind]
    if v is None or v != v:
        return b" " * width
    text = {"double": lambda: repr(float(v)), "date": lambda: v.strftime("%Y%m%d"), "boolean": lambda: "T" if v else "F"}.get(kind, lambda: str(v))()
    raw = text.encode()
    if kind == "string":
        return raw[:width].decode("utf-8", "ignore").encode().ljust(width)
    if len(raw) > width:
        raise ValueError(f"{text} takes more than {width} characters")
    return raw.rjust(width)
