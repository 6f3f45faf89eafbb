"""Products: stretched colours, quality tables, manifests."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def stretched(df: DataFrame, columns: list[str], low: float = 0.0005, high: float = 0.9995) -> DataFrame:
    """Each column between its percentiles as 0..255, rounded half to even; unknown values are 0."""
    found = ranks.percentiles(ranks.long(df, columns), "x", [low, high, 0.0, 1.0], "name")
    out = df
    for c in columns:
        lo, hi, least, most = found[c][1] if c in found else (0.0, 1.0, 0.0, 1.0)
        lo, hi = (least, most) if hi <= lo else (lo, hi)
        hi = lo + 1e-6 if hi <= lo else hi
        unit = F.least(F.greatest((F.col(c) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(f"{c}_u8", F.coalesce(F.when(~F.isnan(c), F.rint(unit * 255.0)), F.lit(0.0)).cast("int"))
    return out.select(*df.columns, *[f"{c}_u8" for c in columns])


def rgb_bands(numbers: list[int]) -> tuple[int, int, int] | None:
    """The preferred triple of bands, if the table has one."""
    for triple in ((73, 51, 31), (76, 51, 26)):
        if set(triple) <= set(numbers):
            return triple
    return None


def quality_table(fused: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, value (text): the number of points and means over those with a weight."""
    valid = fused.where("weight_sum > 0")
    row = valid.agg(F.count("*").alias("points"), *[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics])
    cells = [F.struct(F.lit("points").alias("metric"), F.col("points").cast("double").alias("value"))]
    cells += [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def manifest(path: str, products: dict[str, DataFrame], same_rows: list[str]) -> dict:
    """Writes the products' row counts as JSON, replacing the file at once; refuses if counts that
    must agree don't.  Nothing is ever deleted."""
    counts = {n: df.count() for n, df in products.items()}
    if len({counts[n] for n in same_rows}) > 1:
        raise ValueError(f"row counts differ: { {n: counts[n] for n in same_rows} }")
    out = {"rows": counts, "columns": {n: df.columns for n, df in products.items()}}
    with open(path + ".new", "w") as f:
        json.dump(out, f, indent=1)
    os.replace(path + ".new", path)
    return out


def cleaned(folder: str, manifest_path: str, redundant: list[str]) -> list[tuple[str, bool]]:
    """Removes intermediate files that the products make redundant: (name, whether it was removed) of each.  A manifest
    of whole products must stand there; files outside the folder, folders, and the manifest's own products stay."""
    with open(manifest_path) as f:
        products = set(json.load(f)["rows"])
    out, root = [], os.path.realpath(folder)
    for name in redundant:
        path = os.path.realpath(os.path.join(root, name))
        gone = os.path.commonpath([root, path]) == root and os.path.isfile(path) and os.path.splitext(os.path.basename(path))[0] not in products
        if gone:
            os.remove(path)
        out.append((name, gone))
    return out


def adjusted(table: DataFrame, bands: dict[str, int], listed: tuple[int, ...] = ()) -> tuple[DataFrame, list[dict]]:
    """(table, log): 1 taken off the bands (column: number) that are listed, and what was done to each."""
    log = [{"band": n, "column": c, "subtracted": 1.0 if n in listed else 0.0} for c, n in bands.items()]
    return table.withColumns({e["column"]: F.col(e["column"]) - e["subtracted"] for e in log if e["subtracted"]}), log


def curves(bins: DataFrame) -> DataFrame:
    """One row for each angle and variable of angular_bins(): a drawing (SVG) of the mean with its
    confidence band over the bins that have observations, and bars of their counts.  Bins are few
    by construction; a drawing is made from one group of them."""

    def draw(b):
        b = b.sort_values("bin")
        known = b[b["n"] > 0]
        x = (b["bin_left"] + b["bin_right"]) / 2
        span = lambda v: (v.min(), v.max() if v.max() > v.min() else v.min() + 1.0)
        px = lambda v, lo, hi: 50 + 540 * (v - lo) / (hi - lo)
        x0, x1 = b["bin_left"].min(), b["bin_right"].max()
        parts = ['<svg xmlns="http://www.w3.org/2000/svg" width="640" height="480">']
        for at, n in zip(x, b["n"]):
            high = 100.0 * n / max(1, b["n"].max())
            parts.append(f'<rect x="{px(at, x0, x1) - 4:.1f}" y="{460 - high:.1f}" width="8" height="{high:.1f}" fill="#9ab"/>')
        if len(known):
            ci = known["ci95"].fillna(0.0)
            y0, y1 = span(pd.concat([known["mean"] - ci, known["mean"] + ci]))
            py = lambda v: 330 - 300 * (v - y0) / (y1 - y0)
            at = [px((l + r) / 2, x0, x1) for l, r in zip(known["bin_left"], known["bin_right"])]
            around = [(a, py(m + c)) for a, m, c in zip(at, known["mean"], ci)] + [(a, py(m - c)) for a, m, c in zip(at, known["mean"], ci)][::-1]
            points = lambda p: " ".join(f"{u:.1f},{v:.1f}" for u, v in p)
            parts.append(f'<polygon points="{points(around)}" fill="#48c" opacity="0.3"/>')
            parts.append(f'<polyline points="{points(zip(at, map(py, known["mean"])))}" fill="none" stroke="#148"/>')
        parts.append(f'<text x="50" y="20">{b["variable"].iloc[0]} by {b["angle"].iloc[0]}</text></svg>')
        return pd.DataFrame({"angle": [b["angle"].iloc[0]], "variable": [b["variable"].iloc[0]], "points": [len(known)], "svg": ["".join(parts)]})

    return bins.groupBy("angle", "variable").applyInPandas(draw, "angle string, variable string, points long, svg string")


def notes(bins: DataFrame) -> DataFrame:
    """line, text: a Markdown table that says, for each angle and variable, how many observations
    there are, and in which bin the mean is least and greatest."""
    met = bins.where("n > 0").groupBy("angle", "variable").agg(
        F.sum("n").alias("n"), F.min_by("bin_left", F.struct("mean", "bin")).alias("low"), F.max_by("bin_left", F.struct("mean", "bin")).alias("high")
    )
    text = F.format_string("| %s | %s | %d | %.0f | %.0f |", "angle", "variable", "n", "low", "high")
    head = bins.sparkSession.createDataFrame([(0, "| angle | variable | observations | least mean from | greatest mean from |"), (1, "|-|-|-|-|-|")], "line int, text string")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy("angle", "variable")) + 1  # as many rows as angles times variables
    return head.union(met.select(nth.alias("line"), text.alias("text")))


def collected(report: DataFrame, products: dict[str, str]) -> DataFrame:
    """report (a row for each scene) with the product files that exist: a column for each name, its bytes or null."""
    sizes = {n: os.path.getsize(p) if os.path.isfile(p) else None for n, p in products.items()}
    return report.withColumns({f"bytes_{n}": F.lit(v).cast("long") for n, v in sizes.items()})


def previews(pixels: DataFrame, lines: int, samples: int) -> DataFrame:
    """pixels(scene_id, line, sample, red, green, blue): (scene_id, png), a picture for each scene, made where its pixels
    are grouped; a picture's size is bounded by its scene's, and pixels without a row stay black."""
    import numpy as np
    import pyarrow as pa

    def draw(rows):
        plane = np.zeros((lines, samples, 3), np.uint8)
        at = tuple(rows.column(c).to_numpy() for c in ("line", "sample"))
        for i, c in enumerate(("red", "green", "blue")):
            plane[(*at, i)] = rows.column(c).to_numpy()
        return pa.table({"scene_id": pa.array([rows.column("scene_id")[0].as_py()], pa.string()), "png": pa.array([png(plane)], pa.binary())})

    return pixels.groupBy("scene_id").applyInArrow(draw, "scene_id string, png binary")


#: Pictures whose pixels are held at a time.
PICTURES = 64


def pixels_of(pictures: DataFrame) -> DataFrame:
    """(scene_id, pixels): the pixels (red, green, blue) of pictures(scene_id, png) that png() made, line by line; arrays of a few pictures at a time."""
    import struct
    import zlib

    import numpy as np
    import pyarrow as pa

    def pixels(data):
        samples, lines = struct.unpack(">II", data[16:24])
        at, raw = 8, b""
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            raw += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += 12 + size
        plane = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(lines, 1 + 3 * samples)
        return plane[:, 1:].reshape(lines * samples, 3)

    def read(batches):
        for b in batches:
            for start in range(0, b.num_rows, PICTURES):
                some = b.slice(start, PICTURES)
                drawn = [pixels(x) for x in some.column("png").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in drawn])]).astype(np.int32)
                values = np.concatenate(drawn).astype(np.int32)
                colours = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)], names=["red", "green", "blue"])
                yield pa.RecordBatch.from_arrays([some.column("scene_id"), pa.ListArray.from_arrays(pa.array(ends), colours)], names=["scene_id", "pixels"])

    return pictures.select("scene_id", "png").mapInArrow(read, "scene_id string, pixels array<struct<red: int, green: int, blue: int>>")


def write_preview(df: DataFrame, path: str, lines: int, samples: int) -> None:
    """df(line, sample, red, green, blue) as one PNG file: a scene's preview."""
    made = previews(df.withColumn("scene_id", F.lit("")), lines, samples).first()
    import numpy as np

    with open(path, "wb") as f:
        f.write(made.png if made else png(np.zeros((lines, samples, 3), np.uint8)))


def png(pixels) -> bytes:
    """An array (lines, samples, 3) of bytes as a PNG."""
    import struct
    import zlib

    lines, samples, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(lines))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", samples, lines, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
