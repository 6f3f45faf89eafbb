"""Tables and documents: CSV, Parquet, JSON, XLSX, configuration trees, output names."""

from __future__ import annotations

import json
import os
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(path: str) -> list[list[str | None]]:
    """The first sheet's cells as text; empty cells are None."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        sheet = min(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_MAIN}c"):
                column = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A")).group():
                    column = column * 26 + ord(ch) - 64
                v = c.find(f"{_MAIN}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                text = inline if c.get("t") == "inlineStr" else None if v is None else v.text
                cells[column - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """csv and txt (a byte-order mark is dropped from the first name), parquet, json, xlsx."""
    kind = os.path.splitext(path)[1].lower()
    if kind in (".csv", ".txt"):
        reader = spark.read.option("header", True).option("encoding", "UTF-8")
        out = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        return out.withColumnsRenamed({c: c.lstrip("﻿") for c in out.columns if c.startswith("﻿")})
    if kind == ".parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if kind == ".json":
        return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)
    if kind in (".xlsx", ".xls"):
        rows = xlsx_rows(path)
        names = [str(n or f"column_{i}") for i, n in enumerate(rows[0])]
        body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
        return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
    raise ValueError(f"tables of kind {kind} are not supported")


def resolve(df: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns by alias; names match after trimming, lowering and dropping blanks and parentheses."""
    plain = lambda s: re.sub(r"[ ()]", "", s.strip().lower())
    have = {plain(c): c for c in df.columns}
    picked = []
    for name, others in aliases.items():
        found = next((have[plain(a)] for a in others if plain(a) in have), None)
        if found is None and name in required:
            raise ValueError(f"no column for {name} among {df.columns}")
        picked.append((F.col(f"`{found}`") if found else F.lit(None)).alias(name))
    return df.select(*picked)


def offsets(df: DataFrame) -> DataFrame:
    """scene_id, du, dv: the last finite offset of each scene, by file order `_row`."""
    good = df.where("abs(offset_u_px) < double('inf') and abs(offset_v_px) < double('inf')")  # neither null nor NaN nor infinite
    last = F.max_by(F.struct("offset_u_px", "offset_v_px"), "_row")
    return good.groupBy("scene_id").agg(last.alias("o")).select("scene_id", F.col("o.offset_u_px").alias("du"), F.col("o.offset_v_px").alias("dv"))


def merged(base: dict, over: dict) -> dict:
    """A deep merge; over wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str) -> dict:
    """A YAML or JSON tree; `base_config` is read first (its keys that begin with _ are dropped),
    then `overrides`, then the file's own values."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            tree = json.load(f)
        else:
            import yaml

            tree = yaml.safe_load(f) or {}
    base = tree.pop("base_config", None)
    over = tree.pop("overrides", None) or {}
    out: dict = {}
    if base:
        out = {k: v for k, v in load_config(os.path.join(os.path.dirname(path), base)).items() if not k.startswith("_")}
    return merged(merged(out, over), tree)


def flattened(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted key, value as JSON) of a tree's leaves."""
    out = []
    for k, v in tree.items():
        out += flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else [(prefix + k, json.dumps(v))]
    return out


def output_folder(root: str, input_name: str, band_mode: str = "subset") -> str:
    if band_mode not in ("subset", "all"):
        raise ValueError(f"unknown band mode {band_mode}")
    stem = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", os.path.splitext(os.path.basename(input_name))[0]).strip(" .") or "run"
    return os.path.join(root, stem + ("_allbands" if band_mode == "all" else ""))


def output_path(root: str, input_name: str, name: str, band_mode: str = "subset") -> str:
    """An absolute name stays as it is; any other lies in the run's folder, never above it."""
    if os.path.isabs(name):
        return os.path.normpath(name)
    parts = [p for p in re.split(r"[/\\]", name) if p not in ("", ".", "..")]
    return os.path.join(output_folder(root, input_name, band_mode), *parts)


def band_metadata(df: DataFrame, width: int) -> DataFrame:
    """band_number, band_index and wavelength_nm with defaults by file order `_row`; indices fit width."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy("_row"))
    have = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    out = df.select(
        have("band_number", nth).cast("int").alias("band_number"),
        have("band_index_zero_based", nth - 1).cast("int").alias("band_index"),
        (F.col("wavelength_nm") if "wavelength_nm" in df.columns else F.lit(None)).cast("double").alias("wavelength_nm"),
    )
    if out.where(~F.col("band_index").between(0, width - 1)).limit(1).count():
        raise ValueError(f"a band index is outside 0..{width - 1}")
    return out.orderBy("band_index")


def gain_table(df: DataFrame, bands: list[int] | None = None) -> DataFrame:
    """scene_id, band and gain of a table of gains: finite ones above 1e-12, of these bands."""
    lacking = {"scene_id", "band_number", "gain"} - set(df.columns)
    if lacking:
        raise ValueError(f"columns {sorted(lacking)} are missing")
    out = df.select("scene_id", F.col("band_number").try_cast("int").alias("band"), F.col("gain").try_cast("double").alias("gain"))
    out = out.where(F.col("gain").isNotNull() & ~F.isnan("gain") & (F.col("gain") > 1e-12) & (F.col("gain") < float("inf")))
    return out.where(F.col("band").isin(bands)) if bands else out


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """csv with a header or parquet, by the path's suffix; append adds part files."""
    writer = df.write.mode("append" if append else "errorifexists")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith(".parquet"):
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for {path}")


#: The directional table's columns whose types are not double.
BRF_TYPES = {"observation_id": "long", "point_id": "long", "scene_id": "string", "scene_code": "int", "blocker_count": "int", "is_clear": "boolean", "is_backlit": "boolean", "selection_method": "string", "brf_quality_level": "string"}


def observation_bundle(df: DataFrame, required: list[str]) -> DataFrame:
    """A directional table with the required columns, typed: texts of levels in lower case, raw
    weights at least 0 (unknown ones 1), rows without a point left out."""
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"columns {lacking} are missing")
    out = df.select(*[F.col(c).try_cast(BRF_TYPES.get(c, "double" if c in required else df.schema[c].dataType.simpleString())).alias(c) for c in df.columns])
    fixed = {c: F.lower(F.col(c)) for c in ("brf_quality_level", "selection_method") if c in out.columns}
    if "view_weight_raw" in out.columns:
        w = F.col("view_weight_raw")
        fixed["view_weight_raw"] = F.when(w.isNull() | F.isnan(w), 1.0).otherwise(F.greatest(w, F.lit(0.0)))
    out = out.withColumns(fixed)
    return out.where("point_id is not null") if "point_id" in out.columns else out
