"""Values of images at observations: bilinear, Gaussian-filtered and patch sampling.

Pixels are never exploded: observations are ranged by scene and line, and a task passes through its
range in this order, a strip of lines of the memory-mapped cube after the other.  Ranges hold about as many
rows each, whatever scene or line has most, as a spread of the rows' own ends the order's key.
Cubes must lie where all executors see them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import STORED_PLUS_ONE
from ..sources import envi
from .sizes import small

#: Bytes of spectra that a task holds at a time, and of the planes that it filters together.
HELD, PLANES = 32 << 20, 32 << 20


def bilinear(plane: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values of planes (..., lines, samples) at u, v; coordinates are brought inside the image."""
    lines, samples = plane.shape[-2:]
    u, v = np.clip(u, 0, samples - 1), np.clip(v, 0, lines - 1)
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    x1, y1 = np.minimum(x0 + 1, samples - 1), np.minimum(y0 + 1, lines - 1)
    fx, fy = u - x0, v - y0
    top = plane[..., y0, x0] * (1 - fx) + plane[..., y0, x1] * fx
    low = plane[..., y1, x0] * (1 - fx) + plane[..., y1, x1] * fx
    return top * (1 - fy) + low * fy


def gaussian_kernel(sigma: float = 8.0, truncate: float = 3.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian(plane: np.ndarray, sigma: float = 8.0, truncate: float = 3.0) -> np.ndarray:
    """A separable filter; beyond the edge the nearest value repeats."""
    k = gaussian_kernel(sigma, truncate)
    r = len(k) // 2
    out = plane.astype(np.float64)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(wide, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return out


def patch_offsets(radius: int, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(du, dv, weight) of a square patch; a weight falls with the distance.  A sigma of 0 or less
    stands for half the radius, 1 at least."""
    radius = max(0, int(radius))
    sigma = sigma if sigma > 0 else max(radius / 2.0, 1.0)
    d = np.arange(-radius, radius + 1)
    du, dv = (x.ravel() for x in np.meshgrid(d, d))
    w = np.exp(-0.5 * (du**2 + dv**2) / sigma**2)
    return du, dv, w / w.sum()


def patch(planes: np.ndarray, u, v, radius=2, sigma=1.15, reducer="weighted_mean", sampling="nearest") -> np.ndarray:
    """Reduced values of the patches around u, v for planes (bands, lines, samples): (bands, n).
    Places off the image and NaN take no part; a patch without values is NaN."""
    du, dv, w = patch_offsets(radius, sigma)
    x, y = np.asarray(u)[:, None] + du, np.asarray(v)[:, None] + dv
    lines, samples = planes.shape[-2:]
    inside = (x >= 0) & (x <= samples - 1) & (y >= 0) & (y <= lines - 1)
    if sampling == "nearest":
        xi, yi = np.clip(np.rint(x), 0, samples - 1).astype(int), np.clip(np.rint(y), 0, lines - 1).astype(int)
        values = planes[:, yi, xi].astype(np.float64)
    else:
        values = bilinear(planes, x, y).astype(np.float64)
    values = np.where(inside, values, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        if reducer == "median":
            out = np.full(values.shape[:2], np.nan)
            some = np.isfinite(values).any(axis=2)
            out[some] = np.nanmedian(values[some], axis=1)
            return out
        weights = np.where(np.isfinite(values), 1.0 if reducer == "mean" else w, 0.0)
        return np.where(weights.sum(axis=2) > 0, (np.nan_to_num(values) * weights).sum(axis=2) / weights.sum(axis=2), np.nan)


class _Sampler:
    """Spectra at places of one cube at a time; places come in the order of their lines."""

    def __init__(self, bands: list[int], method: str, strip: int, settings: dict):
        self.index = [b - 1 for b in bands]
        self.shift = np.array([1.0 if b in STORED_PLUS_ONE else 0.0 for b in bands])
        self.method, self.strip, self.settings = method, strip, settings
        self.halo = {"bilinear": 1, "gaussian": len(gaussian_kernel()) // 2 + 1}.get(method, int(settings.get("radius", 2)) + 1)
        self.rows = max(256, HELD // (8 * len(bands)))
        self.path, self.cube, self.scale = None, None, 1.0

    def open(self, path: str) -> None:
        if path != self.path:
            self.cube, h = envi.cube(path)
            self.path, self.scale = path, float(h.get("reflectance scale factor", 1.0) or 1.0)

    def spectra(self, path: str, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """(n, bands) at places of one strip."""
        self.open(path)
        lines, samples = self.cube.shape[1:]
        low = min(max(0, int(np.floor(v.min())) - self.halo), lines - 1)
        high = max(min(lines, int(np.ceil(v.max())) + self.halo + 1), low + 1)
        out = np.empty((len(u), len(self.index)))
        some = max(1, PLANES // (8 * (high - low) * samples))
        for at in range(0, len(self.index), some):
            part = np.stack([self.cube[i, low:high].astype(np.float64) for i in self.index[at : at + some]])
            if self.method == "gaussian":
                part = np.stack([gaussian(p) for p in part])
            if self.method in ("bilinear", "gaussian"):
                out[:, at : at + some] = bilinear(part, u, v - low).T
            else:
                cells = len(part) * (2 * self.halo + 1) ** 2
                for i in range(0, len(u), max(1, (HELD >> 3) // cells)):
                    to = i + max(1, (HELD >> 3) // cells)
                    out[i:to, at : at + some] = patch(part, u[i:to], v[i:to] - low, **self.settings).T
        return out / self.scale - self.shift

    def finished(self, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Rows of one strip (or of no known scene) without their last three columns, with their spectra."""
        rows = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        path, u, v = rows.columns[-3:]
        if path.null_count:
            values = pa.nulls(len(rows), pa.list_(pa.float64()))
        else:
            found = self.spectra(path[0].as_py(), u.to_numpy(), v.to_numpy())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
        return pa.RecordBatch.from_arrays([*rows.columns[:-3], values], names=[*rows.schema.names[:-3], "spectrum"])

    def walk(self, batches):
        held, kept, key = [], 0, None
        for batch in batches:
            path, _, v = batch.columns[-3:]
            strips = np.floor(v.to_numpy() / self.strip)
            codes = path.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if len(batch) else np.zeros(0, int)
            cuts = np.flatnonzero((strips[1:] != strips[:-1]) | (codes[1:] != codes[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                for i in range(a, b, self.rows):
                    piece = batch.slice(i, min(b, i + self.rows) - i)
                    own = (path[a].as_py(), strips[a])
                    if held and (own != key or kept + len(piece) > self.rows):
                        yield self.finished(held)
                        held, kept = [], 0
                    held, kept, key = [*held, piece], kept + len(piece), own
        if held:
            yield self.finished(held)


def sampled(
    views: DataFrame, paths: DataFrame, bands: list[int], method: str = "bilinear", strip: int = 64, first: int | None = None, unknown: str = "skip",
    offsets: DataFrame | None = None, **settings,
) -> DataFrame:
    """views(observation_id, scene_id, u, v) and paths(scene_id, header): adds spectrum, an array of
    the bands (numbers from 1), index bands corrected.  Views without finite places take no part;
    views of unknown scenes take none either, or with unknown="null" get a null spectrum.
    first: only so many views with the least observation_id.  offsets(scene_id, du, dv): pixels by which a scene's
    places are moved before they are sampled; u and v stay as they are."""
    good = views.where("u is not null and v is not null and not isnan(u) and not isnan(v) and abs(u) < double('inf') and abs(v) < double('inf')")
    if first is not None:
        good = good.orderBy("observation_id").limit(first)
    met = good.join(small(paths.select("scene_id", F.col("header").alias("_header"))), "scene_id", "inner" if unknown == "skip" else "left")
    moved = [F.lit(0.0), F.lit(0.0)]
    if offsets is not None:
        met = met.join(small(offsets.select("scene_id", F.col("du").alias("_du"), F.col("dv").alias("_dv"))), "scene_id", "left")
        moved = [F.coalesce(c, F.lit(0.0)) for c in ("_du", "_dv")]
    met = met.select(*views.columns, "_header", *[(F.col(c).cast("double") + m).alias(f"_{c}") for c, m in zip("uv", moved)])
    spread = met.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    n = int(views.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(n, "_header", F.floor("_v"), "_spread").sortWithinPartitions("_header", "_v").drop("_spread")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in views.schema.fields) + ", spectrum array<double>"
    return ranged.mapInArrow(lambda batches: _Sampler(bands, method, strip, settings).walk(batches), schema)


def audited(sampled_: DataFrame) -> DataFrame:
    """One row: observations, missing spectra, and spectra with a value that isn't finite."""
    odd = F.exists("spectrum", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return sampled_.agg(F.count("*").alias("n"), F.count_if(F.col("spectrum").isNull()).alias("missing"), F.count_if(odd).alias("not_finite"))


def finite_or_abort(sampled_: DataFrame) -> DataFrame:
    """The audit's row, or an error if a spectrum is missing or holds a value that isn't finite."""
    found = audited(sampled_).first()
    if found.missing or found.not_finite or not found.n:
        raise ValueError(f"of {found.n} spectra {found.missing} are missing and {found.not_finite} are not finite")
    return sampled_.sparkSession.createDataFrame([tuple(found)], "n long, missing long, not_finite long")


def reproduced(old: DataFrame, new: DataFrame, column: str, most: float = 2e-6) -> DataFrame:
    """One row: the greatest and mean difference of two fusions of the same points, and whether it is small."""
    d = F.abs(F.col("o") - F.col("n"))
    met = old.select("point_id", F.col(column).alias("o")).join(new.select("point_id", F.col(column).alias("n")), "point_id")
    return met.agg(F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff")).withColumn("same", F.col("max_diff") <= most)
