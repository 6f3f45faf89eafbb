"""Cubes of spectral images: a text header and raw values, band after band.

The Spark data source `envi` gives a row for each band and line.  Files are read through
Hadoop-independent paths that every executor sees; a partition is a run of lines of some bands.
"""

from __future__ import annotations

import operator
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

#: The format's type codes.
DTYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
#: Bytes of a cube that a partition reads, at least one run of lines of a band.
PART_BYTES = 8 << 20
#: Cubes up to which a partition is of one cube.  Of more, those whose data file is no greater than WHOLE are opened by
#: executors alone, PACK of them in a partition.
FEW, PACK, WHOLE = 256, 64, 64 << 20
DATA_SUFFIXES = (".cue", ".CUE", ".bin", ".BIN", ".dat", ".DAT")


def _typed(text: str):
    text = text.strip()
    try:
        return float(text) if "." in text or "e" in text.lower() else int(text)
    except ValueError:
        return text


def parse_header(text: str) -> dict:
    """Lower-cased keys; numbers typed, {lists} split at commas, empty items dropped."""
    out = {}
    for m in re.finditer(r"^\s*([^=\n{}]+?)\s*=\s*(\{[^}]*\}|[^\n]*)", text, re.MULTILINE):
        key, value = m.group(1).strip().lower(), m.group(2).strip()
        if value.startswith("{"):
            out[key] = [_typed(x) for x in value[1:-1].split(",") if x.strip()]
        else:
            out[key] = _typed(value)
    return out


def wavelengths(header: dict) -> list[float]:
    values = header.get("wavelength", [])
    return [float(v) for v in (values if isinstance(values, list) else [values]) if isinstance(v, (int, float))]


def headers(folder: str) -> list[str]:
    """Headers *_REF.hdr (any case) of a folder, or all headers if there are none, by name."""
    names = sorted((n for n in os.listdir(folder) if n.lower().endswith(".hdr")), key=str.lower)
    some = [n for n in names if n.lower().endswith("_ref.hdr")] or names
    unique = {os.path.realpath(os.path.join(folder, n)).lower(): os.path.join(folder, n) for n in reversed(some)}
    return sorted(unique.values(), key=lambda p: os.path.basename(p).lower())


def data_file(header_path: str) -> str:
    stem = os.path.splitext(header_path)[0]
    for suffix in DATA_SUFFIXES:
        if os.path.exists(stem + suffix):
            return stem + suffix
    raise FileNotFoundError(f"no data file beside {header_path}")


def cube(header_path: str) -> tuple[np.ndarray, dict]:
    """(memory-mapped bands x lines x samples, header)."""
    with open(header_path, encoding="utf-8", errors="replace") as f:
        h = parse_header(f.read())
    code = int(h["data type"])
    if code not in DTYPES:
        raise ValueError(f"data type {code} is not supported")
    if str(h.get("interleave", "bsq")).lower() != "bsq":
        raise ValueError("only bsq cubes are supported")
    dtype = np.dtype(DTYPES[code]).newbyteorder("<" if int(h.get("byte order", 0)) == 0 else ">")
    shape = (int(h["bands"]), int(h["lines"]), int(h["samples"]))
    path, offset = data_file(header_path), int(h.get("header offset", 0))
    payload = os.path.getsize(path) - offset
    if payload % dtype.itemsize or payload // dtype.itemsize != shape[0] * shape[1] * shape[2]:
        raise ValueError(f"{path} holds {payload} bytes, not {shape} values of {dtype}")
    return np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=shape), h


def described(path: str) -> tuple:
    """What a header says: scene_id, samples, lines, bands, data_type, number of wavelengths, suffix of the data file, offset, scale."""
    with open(path, encoding="utf-8", errors="replace") as f:
        h = parse_header(f.read())
    numbers = [int(h[k]) for k in ("samples", "lines", "bands", "data type")]
    return (scene_name(path), *numbers, len(wavelengths(h)), os.path.splitext(data_file(path))[1], float(h.get("header offset", 0)), float(h.get("reflectance scale factor", 1.0)))


def scene_name(path: str) -> str:
    return re.sub(r"(?i)_ref$", "", os.path.splitext(os.path.basename(path))[0])


_INVENTORY = "scene_id string, samples int, lines int, bands int, data_type int, wavelengths long, suffix string, header_offset double, scale double"


def inventory(spark, folder: str):
    """A row for each cube of a folder; the driver lists names, and executors read headers."""
    names = [x.split()[0] for x in _INVENTORY.split(", ")]

    def read(batches):
        for b in batches:
            yield pd.DataFrame([described(p) for p in b["path"]], columns=names)

    return spark.createDataFrame([(p,) for p in headers(folder)], "path string").mapInPandas(read, _INVENTORY)


def _write_header(header_path: str, dtype: np.dtype, shape: tuple[int, int, int], bands_nm, offset: int, scale: float) -> None:
    code = {v: k for k, v in DTYPES.items()}[dtype.newbyteorder("=").str[1:]]
    b, lines, samples = shape
    with open(header_path, "w") as f:
        f.write(
            f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {b}\nheader offset = {offset}\ndata type = {code}\ninterleave = bsq\n"
            f"byte order = {int(dtype.byteorder == '>')}\nreflectance scale factor = {scale}\nwavelength = {{{', '.join(map(str, bands_nm))}}}\n"
        )


def write_cube(header_path: str, values: np.ndarray, bands_nm=(), offset: int = 0, scale: float = 1.0) -> None:
    _write_header(header_path, values.dtype, values.shape, bands_nm, offset, scale)
    with open(os.path.splitext(header_path)[0] + ".dat", "wb") as f:
        f.write(b"\0" * offset + values.tobytes())


def write_bands(header_path: str, n_bands: int, planes: dict[int, np.ndarray], bands_nm=(), offset: int = 0, scale: float = 1.0) -> None:
    """A cube of which only some bands (numbers from 1) are written; the others are holes in the file, and read as 0."""
    some = next(iter(planes.values()))
    _write_header(header_path, some.dtype, (n_bands, *some.shape), bands_nm, offset, scale)
    with open(os.path.splitext(header_path)[0] + ".dat", "wb") as f:
        f.truncate(offset + n_bands * some.nbytes)
        for band, plane in planes.items():
            f.seek(offset + (band - 1) * some.nbytes)
            f.write(plane.tobytes())


class _Lines(InputPartition):
    def __init__(self, header: str, bands: tuple[int, ...], first: int, last: int):
        self.header, self.bands, self.first, self.last = header, bands, first, last


class _Pack(InputPartition):
    def __init__(self, headers: tuple[str, ...]):
        self.headers = headers


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strip = options["path"], int(options.get("lines", 256))
        self.tests: dict[str, list] = {"scene_id": [], "band": [], "line": []}

    def _passes(self, column: str, value) -> bool:
        return all(test(value, than) for test, than in self.tests[column])

    def partitions(self):
        found = [h for h in (headers(self.path) if os.path.isdir(self.path) else [self.path]) if self._passes("scene_id", scene_name(h))]
        if len(found) <= FEW:
            return [run for h in found for run in self._runs(h)]
        small, out = [], []
        for h in found:
            if os.path.getsize(data_file(h)) <= WHOLE:
                small.append(h)
            else:
                out += self._runs(h)
        return out + [_Pack(tuple(small[at : at + PACK])) for at in range(0, len(small), PACK)]

    def _runs(self, header: str) -> list[_Lines]:
        out = []
        values, _ = cube(header)
        n_bands, n_lines = values.shape[:2]
        strip = min(self.strip, n_lines)
        bands = [b for b in range(n_bands) if self._passes("band", b + 1)]
        starts = [a for a in range(0, n_lines, strip) if any(self._passes("line", y) for y in range(a, min(a + strip, n_lines)))]
        some = max(1, PART_BYTES // max(1, strip * values.shape[2] * values.itemsize))
        for at in range(0, len(bands), some):
            out += [_Lines(header, tuple(bands[at : at + some]), a, min(a + strip, n_lines)) for a in starts]
        return out

    def read(self, p):
        for run in [p] if isinstance(p, _Lines) else (run for h in p.headers for run in self._runs(h)):
            yield from self._read(run)

    def _read(self, p):
        values, h = cube(p.header)
        scale = float(h.get("reflectance scale factor", 1.0) or 1.0)
        lines = [y for y in range(p.first, p.last) if self._passes("line", y)]
        for band in p.bands:
            rows = values[band, p.first : p.last][[y - p.first for y in lines]].astype("f8") / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            columns = [pa.array([scene_name(p.header)] * len(lines)), pa.array([band + 1] * len(lines), pa.int32()), pa.array(lines, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["scene_id", "band", "line", "reflectance"])


class _PushingReader(_Reader):
    """Comparisons of scene_id, band and line with constants decide which files, bands and lines are read at all."""

    def pushFilters(self, filters):
        test = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
        for f in filters:
            known = getattr(f, "attribute", ()) and len(f.attribute) == 1 and f.attribute[0] in self.tests
            if known and type(f) in test and f.value is not None:
                self.tests[f.attribute[0]].append((test[type(f)], f.value))
            elif known and isinstance(f, In):
                self.tests[f.attribute[0]].append((lambda x, among: x in among, tuple(f.value)))
            elif not (known and isinstance(f, IsNotNull)):
                yield f


class EnviSource(DataSource):
    @classmethod
    def name(cls):
        return "envi"

    def schema(self):
        return "scene_id string, band int, line int, reflectance array<double>"

    def reader(self, schema):
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


def scan(spark, path: str, lines: int = 256):
    """The cubes of a folder as rows; conditions on scene, band and line reach the files.  Spark takes conditions to Python
    sources only with spark.sql.python.filterPushdown.enabled, which is set for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EnviSource)
    return spark.read.format("envi").option("path", path).option("lines", str(lines)).option("pushdown", "true").load()
