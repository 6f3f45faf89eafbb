"""Single files whose rows lie at known places: matrices, vertex tables, archives of arrays.

A row's place follows from its number, so each task writes its rows where they belong, and a task that is run
again writes the same bytes.  They go to a file beside the wanted one, which takes its name once all tasks are
done and all rows are there; if one fails, it is removed.  The driver writes headers; no row passes it.

The file lies on a mount that driver and executors share.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.ordinals import numbered

NUMBER = "_number"


def _descr(dtype: np.dtype):
    return dtype.descr if dtype.names else dtype.str


@dataclass
class _Done(WriterCommitMessage):
    rows: int
    runs: list  # (stream, first row, bytes, crc32) of each stretch of rows in a row


class _Writer(DataSourceArrowWriter):
    """streams: (columns, dtype, where row 0 starts); several columns make a record, one a value or a list of values."""

    def __init__(self, options):
        self.path, self.part, self.total = options["path"], options["part"], int(options["rows"])
        self.members = json.loads(options.get("members", "null"))
        self.streams = [(c, np.dtype([tuple(f) for f in d] if isinstance(d, list) else d), at, n) for c, d, at, n in json.loads(options["streams"])]

    def write(self, iterator):
        rows, runs = 0, []
        with open(self.part, "r+b") as f:
            for batch in iterator:
                number = batch.column(batch.schema.get_field_index(NUMBER)).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(number) != 1) + 1).tolist(), len(number)]
                for s, (columns, dtype, at, per_row) in enumerate(self.streams):
                    values = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                    if dtype.names:
                        table = np.empty(len(number), dtype)
                        for name, v in zip(dtype.names, values):
                            table[name] = v.to_numpy(zero_copy_only=False)
                    else:
                        table = (values[0].flatten() if per_row else values[0]).to_numpy(zero_copy_only=False).astype(dtype)
                    width = dtype.itemsize * (per_row or 1)
                    data = memoryview(np.ascontiguousarray(table).view(np.uint8)) if len(table) else memoryview(b"")
                    for i, j in zip(edges, edges[1:]):
                        if j > i:
                            piece, first = data[i * width : j * width], int(number[i])
                            f.seek(at + first * width)
                            f.write(piece)
                            last = next((r for r in reversed(runs) if r[0] == s), None)
                            if last and last[1] * width + last[2] == first * width:
                                last[2], last[3] = last[2] + len(piece), zlib.crc32(piece, last[3])
                            else:
                                runs.append([s, first, len(piece), zlib.crc32(piece)])
                rows += len(number)
        return _Done(rows, runs)

    def commit(self, messages):
        if sum(m.rows for m in messages if m) != self.total:
            self.abort(messages)
            raise ValueError(f"{sum(m.rows for m in messages if m)} rows were written, not {self.total}")
        if self.members:
            runs = sorted(tuple(r) for m in messages if m for r in m.runs)
            with open(self.part, "r+b") as f:
                _finish_archive(f, self.members, runs)
        os.replace(self.part, self.path)

    def abort(self, messages):
        if os.path.exists(self.part):
            os.remove(self.part)


class PlacedFile(DataSource):
    @classmethod
    def name(cls):
        return "placed_file"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def _save(rows: DataFrame, path: str, head: bytes, size: int, total: int, streams: list, members: list | None = None) -> None:
    """rows with NUMBER, as a file of this size that begins with `head`."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(head)
        f.truncate(size)
    rows.sparkSession.dataSource.register(PlacedFile)
    made = [(columns, _descr(dtype), at, per_row) for columns, dtype, at, per_row in streams]
    out = rows.write.format("placed_file").mode("append").option("path", path).option("part", part).option("rows", str(total)).option("streams", json.dumps(made))
    try:
        (out.option("members", json.dumps(members)) if members else out).save()
    finally:
        if os.path.exists(part):  # the job failed before it had a writer
            os.remove(part)


def _npy_header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    text = str({"descr": dtype.str, "fortran_order": False, "shape": shape}).encode()
    text += b" " * (-(len(text) + 11) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text


def save_matrix(df: DataFrame, column: str, order: str, path: str, rows: int, shape: tuple[int, int], dtype: str = "<f4") -> None:
    """An array column as a .npy matrix, `rows` rows by `order`; further rows of the shape are 0."""
    kind = np.dtype(dtype)
    head = _npy_header(kind, shape)
    table = numbered(df.select(order, column), order, name=NUMBER).select(NUMBER, column)
    _save(table, path, head, len(head) + shape[0] * shape[1] * kind.itemsize, rows, [([column], kind, len(head), shape[1])])


def save_records(df: DataFrame, order: str, path: str, head: bytes, dtype: np.dtype, rows: int) -> None:
    """A header, and a record of df's columns of the dtype's names for each row, by `order`."""
    names = list(dtype.names)
    table = numbered(df.select(order, *[c for c in names if c != order]), order, name=NUMBER)
    _save(table, path, head, len(head) + rows * dtype.itemsize, rows, [(names, dtype, len(head), 0)])


def save_archive(df: DataFrame, order: str, path: str, types: dict[str, str], rows: int) -> None:
    """Columns as the .npy members of a .npz archive (a zip file without compression), rows by `order`."""
    streams, members, at = [], [], 0
    for c, kind in types.items():
        dtype = np.dtype(kind)
        head, name = _npy_header(dtype, (rows,)), f"{c}.npy"
        start = at + len(_local(name, 0, 0))
        members.append({"name": name, "at": at, "head": head.hex(), "size": len(head) + rows * dtype.itemsize, "width": dtype.itemsize})
        streams.append(([c], dtype, start + len(head), 0))
        at = start + members[-1]["size"]
    table = numbered(df.select(*dict.fromkeys([order, *types])), order, name=NUMBER)
    _save(table, path, b"", at, rows, streams, members)


def _local(name: str, crc: int, size: int) -> bytes:
    """A member's header; sizes stand in 8 bytes each."""
    extra = struct.pack("<HHQQ", 1, 16, size, size)
    return struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name.encode() + extra


def _finish_archive(f, members: list[dict], runs: list[tuple]) -> None:
    """Writes the headers and the directory, from the checksums of the stretches that tasks wrote (sorted)."""
    directory = b""
    for s, m in enumerate(members):
        head = bytes.fromhex(m["head"])
        crc = zlib.crc32(head)
        for _, _, n, part in [r for r in runs if r[0] == s]:
            crc = joined_crc32(crc, part, n)
        f.seek(m["at"])
        f.write(_local(m["name"], crc, m["size"]) + head)
        extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["at"])
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(m["name"]), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + m["name"].encode() + extra
    f.seek(0, os.SEEK_END)
    start, n = f.tell(), len(members)
    f.write(directory)
    f.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(directory), start))
    f.write(struct.pack("<4sIQI", b"PK\6\7", 0, start + len(directory), 1))
    f.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
        if not vector:
            break
    return out


def joined_crc32(first: int, second: int, size: int) -> int:
    """The checksum of two pieces one after the other, by theirs and the second one's size: appending zero bytes
    is a linear map over bits, and its powers of two are made by squaring."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [_times(step, row) for row in step]
    while size:
        if size & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        size >>= 1
    return first ^ second
