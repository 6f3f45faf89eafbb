"""Stores of arrays and tables: typed scans, one-file CSV, matrices, archives, candidates, documents.

Files that other programs open by path (.npy, .npz, CSV in one file, JSON) lie on a mount that
driver and executors share.  Executors write the rows of matrices and archives at their places; the
driver joins the part files of a CSV.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from . import placed
from .shared import plain_path

BOM = "﻿"


def scan_parquet(spark: SparkSession, path: str, columns: list[str], equals: dict | None = None) -> DataFrame:
    """Some columns of the rows where others equal given values; both reach the scan."""
    out = spark.read.parquet(path)
    for c, value in (equals or {}).items():
        out = out.where(F.col(c).isNull() if value is None else F.col(c) == F.lit(value))
    return out.select(*columns)


def scan_csv(spark: SparkSession, path: str, types: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """CSV with a header (and maybe a byte-order mark): the columns of `types`, or some of them,
    typed; a text that isn't of its type is null, a column that the file lacks an error."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    have = {c.lstrip(BOM): c for c in raw.columns}
    wanted = columns or list(types)
    lacking = [c for c in wanted if c not in have]
    if lacking:
        raise ValueError(f"columns {lacking} are missing in {path}")
    return raw.select(*[F.col(f"`{have[c]}`").try_cast(types.get(c, "string")).alias(c) for c in wanted])


def append_csv(df: DataFrame, path: str) -> None:
    """Adds df's rows to one CSV file; the header, with a byte-order mark before it, comes with the first."""
    parts = plain_path(df.sparkSession)
    df.write.option("header", False).csv("file://" + parts)
    fresh = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "ab") as out:
        if fresh:
            out.write((BOM + ",".join(df.columns) + "\n").encode())
        for name in sorted(n for n in os.listdir(parts) if n.startswith("part-")):
            with open(os.path.join(parts, name), "rb") as f:
                shutil.copyfileobj(f, out)
    shutil.rmtree(parts)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Columns side by side: the n-th row of each by its order.  Numbers differ: an error."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    number = lambda df, order: numbered(df, *order).withColumnRenamed("observation_id", "_nth")
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns}
    return number(left, left_order).join(number(right, right_order).withColumnsRenamed(clash), "_nth").drop("_nth")


def inferred_rows(spark: SparkSession, counts: list[int | None] = (), tables: list[str] = ()) -> int:
    """The greatest of known counts and of the tables' numbers of rows; none above 0: an error."""
    found = [int(c) for c in counts if c is not None]
    for path in tables:
        if os.path.exists(path):
            found.append((spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)).count())
    if max(found, default=0) <= 0:
        raise ValueError("no number of rows could be inferred")
    return max(found)


def write_matrix(df: DataFrame, column: str, order: str, path: str, rows: int | None = None) -> tuple[int, int]:
    """The array column as a .npy matrix of 4-byte floats, rows by `order`, written by executors at their places
    (placed.py).  Rows of several lengths, or more than the `rows` foreseen: an error."""
    lo, hi, n = df.select(F.size(column).alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    if lo != hi:
        raise ValueError(f"rows of {lo} to {hi} values make no matrix")
    if rows is not None and n > rows:
        raise ValueError(f"{n} rows, but a matrix of {rows}")
    shape = (n if rows is None else rows, hi or 0)
    placed.save_matrix(df, column, order, path, n, shape)
    return shape


def read_matrix(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """(row, values) of a .npy matrix, read by executors in runs of rows."""
    shape = np.load(path, mmap_mode="r").shape

    def load(batches):
        for b in batches:
            for first in b["id"]:
                part = np.load(path, mmap_mode="r")[first : first + rows]
                yield pd.DataFrame({"row": np.arange(first, first + len(part)), "values": list(part.astype(float))})

    return spark.range(0, shape[0], rows).mapInPandas(load, "row long, values array<double>")


def write_arrays(df: DataFrame, order: str, path: str, types: dict[str, str]) -> int:
    """Columns as the .npy members of a .npz archive, rows by `order`, written by executors at their places in the one file."""
    n = df.count()
    placed.save_archive(df, order, path, types, n)
    return n


def read_arrays(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """(name, row, value) of the arrays of numbers in a .npz archive without compression, read by executors in runs of rows."""
    runs = []
    with zipfile.ZipFile(path) as z, open(path, "rb") as raw:
        for info in z.infolist():
            with z.open(info) as f:
                np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                header = f.tell()
            raw.seek(info.header_offset + 26)
            at = info.header_offset + 30 + sum(int.from_bytes(raw.read(2), "little") for _ in range(2)) + header
            runs += [(info.filename.removesuffix(".npy"), dtype.str, at, first, min(rows, shape[0] - first)) for first in range(0, shape[0], rows)]

    def load(batches):
        for b in batches:
            for name, kind, at, first, n in b.itertuples(index=False):
                part = np.fromfile(path, kind, n, offset=at + first * np.dtype(kind).itemsize)
                yield pd.DataFrame({"name": name, "row": np.arange(first, first + n), "value": part.astype(float)})

    listed = spark.createDataFrame(runs, "name string, kind string, at long, first long, n long")
    return listed.mapInPandas(load, "name string, row long, value double")


#: A candidate's fields, their types, and what stands in an empty slot (None: NaN).
CANDIDATE_FIELDS = {
    "score": ("float", float("-inf")), "scene_code": ("int", -1), "u": ("float", None), "v": ("float", None), "range_m": ("float", None),
    "offaxis_deg": ("float", None), "border_dist_px": ("float", None), "dir_x": ("float", None), "dir_y": ("float", None), "dir_z": ("float", None),
    "view_zenith_deg": ("float", None), "view_azimuth_deg": ("float", None), "local_view_cos_signed": ("float", None), "local_view_angle_deg": ("float", None),
    "solar_zenith_deg": ("float", None), "solar_azimuth_deg": ("float", None), "relative_azimuth_deg": ("float", None), "sun_dir_x": ("float", None),
    "sun_dir_y": ("float", None), "sun_dir_z": ("float", None), "local_solar_cos": ("float", None), "local_solar_incidence_deg": ("float", None),
    "is_backlit": ("tinyint", -1), "surface_view_cos": ("float", None), "surface_verticality": ("float", None), "normal_confidence": ("float", None),
}
#: What some of them are called in candidates.
_CANDIDATE_NAMES = {"score": "coarse_score", "solar_azimuth_deg": "sun_azimuth_deg", "sun_dir_x": "sun_x", "sun_dir_y": "sun_y", "sun_dir_z": "sun_z"}


def store_candidates(kept: DataFrame, points: DataFrame, k: int, path: str) -> dict:
    """Every point's k slots, an array for each field; empty slots hold the field's fill value, and so do fields that
    are unknown or that kept lacks.  The manifest beside the table names fields, points and slots and is
    written last, so a store without one is not whole."""
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    source = {n: n if n in kept.columns else _CANDIDATE_NAMES.get(n, n) for n in CANDIDATE_FIELDS}
    values = [(F.col(c) if c in kept.columns else F.lit(None)).cast(CANDIDATE_FIELDS[n][0]).alias(n) for n, c in source.items()]
    per = kept.groupBy("point_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*values)))).alias("m"))
    met = points.select("point_id").join(per, "point_id", "left")

    def field(name, kind, fill):
        empty = F.lit(float("nan") if fill is None else fill).cast(kind)
        return F.transform(slots, lambda s: F.coalesce(F.col("m")[s][name], empty)).alias(name)

    table = met.select("point_id", *[field(n, *of) for n, of in CANDIDATE_FIELDS.items()])
    table.write.parquet(os.path.join(path, "slots"))
    manifest = {"points": points.count(), "slots": k, "fields": {n: {"type": t, "fill": None if f is None else str(f)} for n, (t, f) in CANDIDATE_FIELDS.items()}}
    save_text(points.sparkSession, os.path.join(path, "manifest.json"), json.dumps(manifest))
    return manifest


def open_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The store's table, after its manifest was held against it: fields, points, and slots of each."""
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(os.path.join(path, "manifest.json")).collect()))
    lacking = sorted(set(CANDIDATE_FIELDS) - set(manifest["fields"]))
    table = spark.read.parquet(os.path.join(path, "slots"))
    lacking += sorted(set(manifest["fields"]) - set(table.columns))
    if lacking:
        raise ValueError(f"{path} lacks fields {lacking}")
    n, lo, hi = table.agg(F.count("*"), F.min(F.size("scene_code")), F.max(F.size("scene_code"))).first()
    if n != manifest["points"] or (n and (lo, hi) != (manifest["slots"],) * 2):
        raise ValueError(f"{path} holds {n} points of {lo} to {hi} slots, not {manifest['points']} of {manifest['slots']}")
    return table


def stored_candidates(make, points: DataFrame, k: int, path: str, source: dict) -> DataFrame:
    """The store under path, if it is whole and was made of this source (names and numbers that tell whether an input
    changed, such as sizes and times of files); else make() gives the candidates, which are stored anew.
    A pointer names the store's folder and source; it is written once the new store is whole."""
    spark, pointer = points.sparkSession, os.path.join(path, "current.json")
    source = json.loads(json.dumps(source))
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.text(pointer).collect()))
        if found["source"] == source:
            return open_candidates(spark, os.path.join(path, found["folder"]))
    except (AnalysisException, ValueError):  # no pointer, or no whole store
        pass
    folder = uuid.uuid4().hex
    store_candidates(make(), points, k, os.path.join(path, folder))
    save_text(spark, pointer, json.dumps({"folder": folder, "source": source}))
    return open_candidates(spark, os.path.join(path, folder))


def candidates_of(store: DataFrame) -> DataFrame:
    """The store's filled slots as rows (point_id, slot, fields)."""
    rows = store.select("point_id", F.posexplode(F.arrays_zip(*CANDIDATE_FIELDS)).alias("slot", "c")).select("point_id", "slot", "c.*")
    return rows.where("scene_code >= 0")


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """A folder of one text file, through Spark's file systems."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: The annotation table's columns.
ANNOTATION_COLUMNS = ("scene_id", "annotation_status", "u_top", "v_top", "u_base", "v_base", "top_anchor_x", "top_anchor_y", "top_anchor_z",
                      "base_anchor_x", "base_anchor_y", "base_anchor_z", "note")


def annotations(marks: DataFrame, anchors: DataFrame) -> DataFrame:
    """marks(scene_id, annotation_status, u_top, ...) that aren't pending, with the target's anchors
    (one row: top_x, ..., base_z) repeated on each, in the table's columns."""
    named = anchors.select(*[F.col(f"{end}_{c}").alias(f"{end}_anchor_{c}") for end in ("top", "base") for c in "xyz"])
    out = marks.where("annotation_status <> 'pending'").crossJoin(F.broadcast(named))
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in ANNOTATION_COLUMNS])


def catalogue(text: str) -> list[dict]:
    """The entries of a catalogue of grids: JSON, a list or an object with `candidates`."""
    tree = json.loads(text)
    entries = tree["candidates"] if isinstance(tree, dict) else tree
    bad = [e for e in entries if not {"name", "src_crs", "dst_crs"} <= set(e)]
    if bad:
        raise ValueError(f"entries without a name or a system: {bad}")
    return entries
