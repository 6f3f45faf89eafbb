"""Rays against points by voxels.

A ray's tube is the space within `radius` of it.  Each ray is cut into slabs of voxels along the
coordinate in which it moves most; in a slab the ray spans an interval of the other two
coordinates, and the voxels there whose centre is near enough to the line are those that the tube can
cross.  Points are in one voxel each, so the join is an equi-join by voxels, and a dense voxel's points can be
split.  Voxels are large ones first, with the boxes of their points: only the stretches of a ray that pass a
box within the radius are cut into small voxels, so their number goes by what is near a ray, and not by its length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, minus, unit, vec
from ..sources import shared
from .sizes import tasks

#: Rays up to which their voxels (some 1,000 of a 300 m tube, 5 numbers each) are broadcast.
BROADCAST_RAYS = 200
#: Small voxels along a side of a large one.
LARGE = 16
#: Rays that a task cuts into voxels.
TASK_RAYS = 1000


def voxels(rays: DataFrame, radius: float, nearest, farthest, side: float, *keep: str) -> DataFrame:
    """rays(scene_code, cam_x.., fwd_x.. of length 1): (scene_code, keep, vx, vy, vz) of the voxels that the tubes can cross.
    nearest and farthest: numbers or columns."""
    cam, fwd = [F.col(f"cam_{c}") for c in "xyz"], [F.col(f"fwd_{c}") for c in "xyz"]
    steep = [F.abs(f) for f in fwd]
    # the coordinates in the order main, next, last, where the ray moves most in the main one
    main = F.when((steep[0] >= steep[1]) & (steep[0] >= steep[2]), 0).when(steep[1] >= steep[2], 1).otherwise(2)
    turn = lambda v, k: F.when(F.col("_m") == 0, v[k]).when(F.col("_m") == 1, v[(1 + k) % 3]).otherwise(v[(2 + k) % 3])
    out = rays.withColumn("_m", main).withColumns({f"_c{k}": turn(cam, k) for k in range(3)} | {f"_d{k}": turn(fwd, k) for k in range(3)})
    out = out.withColumns({"_near": F.lit(nearest), "_far": F.lit(farthest)}).select("scene_code", *keep, *[f"_{x}{k}" for x in "cd" for k in range(3)], "_m", "_near", "_far")
    ends = [F.col("_c0") + F.col("_d0") * t for t in (F.col("_near"), F.col("_far"))]
    cell = lambda x: F.floor(x / side)
    out = out.withColumn("_v0", F.explode(F.sequence(cell(F.least(*ends) - radius), cell(F.greatest(*ends) + radius))))
    # a point of the tube in this slab is within the radius of a point of the line in this stretch
    low, high = F.col("_v0") * side - radius, (F.col("_v0") + 1) * side + radius
    for k in (1, 2):
        reach = [F.col(f"_c{k}") + (x - F.col("_c0")) / F.col("_d0") * F.col(f"_d{k}") for x in (low, high)]
        out = out.withColumn(f"_v{k}", F.explode(F.sequence(cell(F.least(*reach) - radius), cell(F.greatest(*reach) + radius))))
    rel = [(F.col(f"_v{k}") + 0.5) * side - F.col(f"_c{k}") for k in range(3)]
    along = rel[0] * F.col("_d0") + rel[1] * F.col("_d1") + rel[2] * F.col("_d2")
    apart = rel[0] * rel[0] + rel[1] * rel[1] + rel[2] * rel[2] - along * along
    half = side * math.sqrt(3) / 2
    out = out.where((apart <= (radius + half + 1e-6) ** 2) & along.between(F.col("_near") - half - 1e-6, F.col("_far") + half + 1e-6))
    place = [F.col(f"_v{k}") for k in range(3)]
    back = lambda i: F.when(F.col("_m") == 0, place[i]).when(F.col("_m") == 1, place[(i + 2) % 3]).otherwise(place[(i + 1) % 3])
    return out.select("scene_code", *keep, *[back(i).alias(f"v{c}") for i, c in enumerate("xyz")])


def stretches(rays: DataFrame, points: DataFrame, radius: float, nearest: float, farthest: float, side: float) -> DataFrame:
    """rays' columns with lx, ly, lz, _from and _to: the stretch of a ray from which a point in that large voxel can be within the radius."""
    large = ["lx", "ly", "lz"]
    ends = [f(c).alias(f"{end}_{c}") for end, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
    boxes = points.where("not isnan(x + y + z)").groupBy(*[F.floor(F.col(c) / (side * LARGE)).alias(f"l{c}") for c in "xyz"]).agg(*ends)
    crossed = voxels(rays, radius, nearest, farthest, side * LARGE, *[c for c in rays.columns if c != "scene_code"])
    out = crossed.withColumnsRenamed({f"v{c}": f"l{c}" for c in "xyz"}).join(boxes, large)
    out = out.withColumns({"_from": F.lit(float(nearest)), "_to": F.lit(float(farthest))})
    for c in "xyz":
        at, by = F.col(f"cam_{c}"), F.col(f"fwd_{c}")
        lo, hi = F.col(f"lo_{c}") - (radius + 1e-6) - at, F.col(f"hi_{c}") + (radius + 1e-6) - at
        moves = F.abs(by) > 1e-9  # else its place is the same at all distances, to less than the margin
        enters, leaves = F.least(lo / by, hi / by) - 1e-6, F.greatest(lo / by, hi / by) + 1e-6
        out = out.where(moves | ((lo <= 1e-6) & (hi >= -1e-6)))
        out = out.withColumns({"_from": F.when(moves, F.greatest("_from", enters)).otherwise(F.col("_from")), "_to": F.when(moves, F.least("_to", leaves)).otherwise(F.col("_to"))})
    return out.where("_from <= _to").select(*rays.columns, *large, "_from", "_to")


def met(scenes: DataFrame, points: DataFrame, radius: float, nearest: float, farthest: float) -> DataFrame:
    """(scene_code, x, y, z, cam_x.., fwd_x..) of points and the rays whose tubes cross their voxel."""
    rays = scenes.select("scene_code", "cam_x", "cam_y", "cam_z", *[c.alias(f"fwd_{n}") for n, c in zip("xyz", unit(vec("fwd_x", "fwd_y", "fwd_z")))])
    rays = shared.written(rays)  # else what makes a frame would be repeated in each expression on it
    side = 2.0 * radius
    count = rays.count()
    dealt = rays.repartition(tasks(rays.sparkSession, count, TASK_RAYS))
    near = shared.written(stretches(dealt, points, radius, nearest, farthest, side))
    own, large = [c for c in rays.columns if c != "scene_code"], ["lx", "ly", "lz"]
    crossed = voxels(near, radius, F.col("_from"), F.col("_to"), side, *own, *large)
    inside = [F.floor(F.col(f"v{c}") / LARGE) == F.col(f"l{c}") for c in "xyz"]  # so a voxel comes from one stretch
    crossed = crossed.where(inside[0] & inside[1] & inside[2]).drop(*large)
    placed = points.select("x", "y", "z").withColumns({f"v{c}": F.floor(F.col(c) / side) for c in "xyz"})
    return placed.join(F.broadcast(crossed) if count <= BROADCAST_RAYS else crossed, ["vx", "vy", "vz"])


def tube(scenes: DataFrame, points: DataFrame, radius: float = 1.0, nearest: float = 1.0, farthest: float = 300.0) -> DataFrame:
    """scene_code and along (metres from the camera) of the points within the tubes of scenes(scene_code, cam_x.., fwd_x..)."""
    rel = minus(vec("x", "y", "z"), vec("cam_x", "cam_y", "cam_z"))
    pairs = met(scenes, points, radius, nearest, farthest).withColumns(dict(zip(("_x", "_y", "_z"), rel)))
    rel = vec("_x", "_y", "_z")
    pairs = pairs.withColumn("along", dot(rel, vec("fwd_x", "fwd_y", "fwd_z")))
    apart = F.greatest(dot(rel, rel) - F.col("along") * F.col("along"), F.lit(0.0))
    return pairs.where(F.col("along").between(nearest, farthest) & (apart <= radius * radius))
