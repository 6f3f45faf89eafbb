"""Vertex tables of PLY files: the Spark data source `ply`, and a binary writer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import placed

#: The format's types.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
PLY_OF = {"tinyint": ("char", "<i1"), "smallint": ("short", "<i2"), "int": ("int", "<i4"), "float": ("float", "<f4"), "double": ("double", "<f8"), "boolean": ("uchar", "<u1")}
UNSIGNED = {"uchar": ("uchar", "<u1"), "ushort": ("ushort", "<u2")}


def header(path: str):
    """(encoding, number of vertices, [(name, dtype)], byte where the data begins)."""
    fields, count, encoding, inside = [], 0, "", False
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is no PLY file")
        for line in iter(f.readline, b""):
            words = line.decode("ascii", "replace").split()
            if words[:1] == ["format"]:
                encoding = words[1]
            elif words[:1] == ["element"]:
                inside = words[1] == "vertex"
                count = int(words[2]) if inside else count
            elif words[:1] == ["property"] and inside:
                if words[1] == "list":
                    raise ValueError("list properties of vertices are not supported")
                fields.append((words[2], TYPES[words[1]]))
            elif words[:1] == ["end_header"]:
                return encoding, count, fields, f.tell()
    raise ValueError(f"{path} has no end_header")


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 1_000_000))

    def partitions(self):
        count = header(self.path)[1]
        return [_Rows(a, min(a + self.rows, count)) for a in range(0, count, self.rows)] or [_Rows(0, 0)]

    def read(self, p):
        encoding, _, fields, at = header(self.path)
        if encoding == "ascii":
            with open(self.path, "rb") as f:
                f.seek(at)
                for i, line in enumerate(f):
                    if i >= p.last:
                        break
                    if i >= p.first:
                        words = line.split()
                        yield (i, *[float(w) if t[0] == "f" else int(w) for w, (_, t) in zip(words, fields)])
            return
        order = "<" if encoding == "binary_little_endian" else ">"
        dtype = np.dtype([(n, order + t) for n, t in fields])
        rows = np.fromfile(self.path, dtype, count=p.last - p.first, offset=at + p.first * dtype.itemsize)
        wide = {"i1": "i1", "u1": "i2", "i2": "i2", "u2": "i4", "i4": "i4", "u4": "i8", "f4": "f4", "f8": "f8"}  # as SPARK has them
        values = [pa.array(np.arange(p.first, p.first + len(rows))), *(pa.array(rows[n].astype(wide[t])) for n, t in fields)]
        yield pa.RecordBatch.from_arrays(values, names=["point_id", *(n for n, _ in fields)])


class PlySource(DataSource):
    """point_id (the vertex's number) and the vertex's properties; splits by rows."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        return ", ".join(["point_id bigint", *[f"`{n}` {SPARK[t]}" for n, t in header(self.options["path"])[2]]])

    def reader(self, schema):
        return _Reader(self.options)


def assembled(points: DataFrame, bands: dict[str, str] | None = None, rgb: tuple[str, str, str] | None = None, extras: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """(table, types) of a point file: point_id, x, y, z as doubles, bands (name: column) as floats,
    three columns of 0..255 as red, green, blue, and further columns as they are."""
    columns = [F.col("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]]
    columns += [F.col(c).cast("float").alias(n) for n, c in (bands or {}).items()]
    colours = dict(zip(("red", "green", "blue"), rgb or ()))
    columns += [F.col(c).cast("int").alias(n) for n, c in colours.items()]
    return points.select(*columns, *extras), dict.fromkeys(colours, "uchar")


def write(df: DataFrame, path: str, order: str, types: dict[str, str] | None = None) -> int:
    """Writes df's columns but `order` as a binary little-endian vertex table in that order, by executors at their
    rows' places (placed.py).  Returns the rows.  8-byte integers have no PLY type and are refused.  types: unsigned
    types of some columns.
    """
    kinds = {f.name: UNSIGNED[types[f.name]] if types and f.name in types else PLY_OF.get(f.dataType.simpleString()) for f in df.schema.fields}
    columns = [(f.name, kinds[f.name]) for f in df.schema.fields if f.name != order]
    bad = [n for n, t in columns if t is None]
    if bad:
        raise ValueError(f"columns without a PLY type: {bad}")
    total = df.count()
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {total}", *[f"property {t[0]} {n}" for n, t in columns], "end_header"]
    placed.save_records(df, order, path, ("\n".join(lines) + "\n").encode(), np.dtype([(n, t[1]) for n, t in columns]), total)
    return total
