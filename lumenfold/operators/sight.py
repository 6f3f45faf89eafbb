"""Which points can be in which images: scenes near points, and cells in a camera's view.

Points lie in small cells, and these in larger ones; each has the box of its points.  A camera
sees a pyramid up to its range.  Large cells meet the scenes in reach by an equi-join of a grid, and
those whose box is outside a side of the pyramid go; then the small cells of what is left. Only
points of cells that pass meet a scene, by an equi-join of cells, and are projected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera as C
from ..sources import shared
from .sizes import compiled, small, tasks

#: Rows of cells and scenes (some thirty numbers each) up to which their side is broadcast.
BROADCAST_CELLS = 50_000
#: Pairs that a task makes, as they are many times the rows that it reads.
TASK_PAIRS = 250_000
#: Metres: the sides of small and large cells.
FINE, COARSE = 2.0, 32.0
#: A small cell's columns.
CELL = ("_kx", "_ky", "_kz")


def near_scenes(points: DataFrame, scenes: DataFrame, reach: float) -> DataFrame:
    """points(x, y, ...) with each of scenes(cam_x, cam_y, ...) that can be within reach of them: those of the
    own and the surrounding cells of a grid as wide as the reach."""
    around = scenes
    for c in "xy":
        own = F.floor(F.col(f"cam_{c}") / reach)
        around = around.withColumn(f"_cell_{c}", F.explode(F.array(*[own + d for d in (-1, 0, 1)])))
    placed = points.withColumns({f"_cell_{c}": F.floor(F.col(c) / reach) for c in "xy"})
    return placed.join(small(around), ["_cell_x", "_cell_y"]).drop("_cell_x", "_cell_y")


def in_pyramid(max_range: float, width=1886, height=1886, fov_h=35.0, fov_v=35.0, flip_u=False, flip_v=False) -> Column:
    """Whether the box lo_x .. hi_z can hold a point that the camera cam_x .., r11 .. r33 sees within the range.
    False only where all of the box is outside; a flip mirrors the image, and not what is in it."""
    fx, fy, cx, cy = C.intrinsics(width, height, fov_h, fov_v)
    right, down, ahead = ([F.col(f"r{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3))
    sides = [[cx * a + s * fx * r for a, r in zip(ahead, right)] for s in (1.0, -1.0)] + [[cy * a + s * fy * d for a, d in zip(ahead, down)] for s in (1.0, -1.0)] + [ahead]
    lo, hi = ([F.col(f"{end}_{c}") - F.col(f"cam_{c}") for c in "xyz"] for end in ("lo", "hi"))
    out = F.lit(True)
    for normal in sides:
        most = sum((F.greatest(n * a, n * b) for n, a, b in zip(normal, lo, hi)), F.lit(0.0))
        out = out & (most >= -1e-3)
    gap = [F.greatest(a, -b, F.lit(0.0)) for a, b in zip(lo, hi)]
    return out & (gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= (max_range + 1e-6) ** 2)


def _box(of: DataFrame, *by: str) -> DataFrame:
    return of.groupBy(*by).agg(F.sum("_points").alias("_points"), *[f(f"{end}_{c}").alias(f"{end}_{c}") for end, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])


def seen_cells(points: DataFrame, scenes: DataFrame, max_range: float, **image) -> DataFrame:
    """(_kx, _ky, _kz, _points, and scenes' columns) of small cells, with their number of points, and the scenes that can see into them, written."""
    scenes = shared.written(scenes)  # else what makes a frame would be repeated in each expression on it
    keys, large = [*CELL], ["_lx", "_ly", "_lz"]
    ends = {f"{end}_{c}": F.col(c).cast("double") for end in ("lo", "hi") for c in "xyz"}
    fine = _box(points.select(*[F.floor(F.col(c) / FINE).alias(k) for c, k in zip("xyz", keys)], F.lit(1).alias("_points"), *[v.alias(k) for k, v in ends.items()]), *keys)
    fine = shared.written(fine).withColumns({k: F.floor(F.col(s) * FINE / COARSE) for k, s in zip(large, keys)})
    middle = {c: (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in "xy"}
    sees = in_pyramid(max_range, **image)
    first = near_scenes(_box(fine, *large).withColumns(middle), scenes, max_range + COARSE).where(sees).select(*large, *scenes.columns)
    return shared.written(fine.join(first, large).where(sees).select(*keys, "_points", *scenes.columns))


def pairs(points: DataFrame, scenes: DataFrame, max_range: float, **image) -> DataFrame:
    """points(x, y, z, ...) with each of scenes(cam_x .., r11 .. r33, ...) that can see into their cell."""
    return met(points, seen_cells(points, scenes, max_range, **image)).drop(*CELL)


def met(points: DataFrame, seen: DataFrame) -> DataFrame:
    """points(x, y, z, ...) with their cell and the scenes that seen_cells() found for it.  Both sides are dealt by the number of pairs,
    which is known beforehand: by their bytes they would go to a few tasks.  All pairs of a point are in one task, and steps that group by the
    cell and the point need no exchange."""
    keys = [*CELL]
    compiled(points.sparkSession)
    cells, number = seen.agg(F.count("*"), F.sum("_points")).first()
    n = tasks(points.sparkSession, number, TASK_PAIRS)
    seen = seen.drop("_points")
    placed = points.withColumns({f"_k{c}": F.floor(F.col(c) / FINE) for c in "xyz"})
    if cells <= BROADCAST_CELLS:
        by = ["point_id"] if "point_id" in points.columns else []
        return placed.repartition(n, *by).join(F.broadcast(seen), keys)
    return placed.repartition(n, *keys).join(seen.repartition(n, *keys), keys)
