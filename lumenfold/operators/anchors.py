"""Grid candidates, rays to points, centres, target points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks, rays
from ..functions import camera as C
from ..functions import mapgrid
from ..functions.vectors import dot, minus, unit, vec
from ..sources import shared


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def grid_scores(cameras: DataFrame, box: DataFrame) -> DataFrame:
    """cameras(name, cam_x, cam_y, az_residual, zen_residual) of each candidate grid: hits in the
    points' box with a margin, median distance and residuals (999 if unknown), and the score."""
    met = cameras.crossJoin(F.broadcast(box))
    inside, center = F.lit(True), []
    for c in "xy":
        lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
        margin = F.greatest(F.lit(30.0), (hi - lo) * 0.2)
        inside = inside & F.col(f"cam_{c}").between(lo - margin, hi + margin)
        center.append(F.col(f"cam_{c}") - (lo + hi) * 0.5)
    hits = met.groupBy("name").agg(F.count_if(inside).alias("hits"))
    gap = F.sqrt(center[0] * center[0] + center[1] * center[1])
    values = {"distance": gap, "az": F.col("az_residual"), "zen": F.col("zen_residual")}
    long = met.select("name", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("x")) for k, v in values.items()])).alias("v")).select("name", "v.*")
    middle = ranks.medians(long, "x", "name", "kind")
    at = middle.groupBy("name").agg(*[F.max(F.when(F.col("kind") == k, F.col("median"))).alias(k) for k in values])
    out = hits.join(at, "name", "left").withColumns({k: F.coalesce(k, F.lit(999.0)) for k in ("az", "zen")})
    return out.withColumn("score", F.col("hits") * 1000.0 - F.col("distance") - 2.0 * F.col("az") - 2.0 * F.col("zen"))


def choose_grid(cameras: DataFrame, box: DataFrame, catalogue: list[dict], forced: str = "") -> tuple[str, DataFrame]:
    """(name of the best entry, scores by falling score) of cameras(cam_lon, cam_lat, az_residual,
    zen_residual); with a forced name only that entry is scored."""
    some = [c for c in catalogue if not forced or c["name"] == forced]
    if not some:
        raise ValueError("no grid to choose from")
    placed = None
    for entry in some:
        x, y = mapgrid.candidate(F.col("cam_lon"), F.col("cam_lat"), entry)
        part = cameras.select(F.lit(entry["name"]).alias("name"), x.alias("cam_x"), y.alias("cam_y"), "az_residual", "zen_residual")
        placed = part if placed is None else placed.union(part)
    scores = grid_scores(placed, box).orderBy(F.desc("score"), "name")
    return scores.first()["name"], scores


def first_hits(scenes: DataFrame, points: DataFrame, radius=1.0, min_points=8, nearest=1.0, farthest=300.0, quantile=0.05, depth=1.0) -> DataFrame:
    """scenes(scene_code, cam_x.., fwd_x..): hit_count and anchor_range of the first surface along
    each ray (null where too few points are met).  The surface is the median of the points in the tube that
    are up to `depth` behind its low quantile, but of min_points at least: the tube's first ones.
    Rays meet the points of the voxels that their tubes cross."""
    tube = shared.written(rays.tube(scenes, points, radius, nearest, farthest).select("scene_code", "along"))
    order = ranks.Sorted(tube, "along", "scene_code")
    limits = order.percentiles({"low": quantile}).select("scene_code", (F.col("low") + depth).alias("limit"))
    close = tube.join(limits, "scene_code").groupBy("scene_code").agg(F.count_if(F.col("along") <= F.col("limit")).alias("close"))
    first = F.least(F.greatest("close", F.lit(min_points)), F.col("n"))
    found = order.at({"below": F.floor((first - 1) / 2), "above": F.floor(first / 2)}, close)
    found = found.select("scene_code", F.col("n").alias("hit_count"), F.when(F.col("n") >= min_points, (F.col("below") + F.col("above")) / 2).alias("anchor_range"))
    return scenes.join(found, "scene_code", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0).cast("long")))


def resolved(hits: DataFrame, ground: DataFrame, method: str = "first_hit_pointcloud", fallback: str = "ray_ground_intersection", aim: bool = False) -> DataFrame:
    """anchor_source and anchor_x, y, z.  Method first_hit_pointcloud: the first hit, else (with
    fallback bref_target_xy) the marked target on the ground, else where the ray meets the
    ground, else none; any other method starts with the marked target.  Marked targets are
    columns target_x and target_y.  With aim, fwd_x, y, z turn towards the anchor."""
    rows = hits.crossJoin(F.broadcast(ground.select("ground_z")))
    cam, fwd = vec("cam_x", "cam_y", "cam_z"), unit(vec("fwd_x", "fwd_y", "fwd_z"))
    marked = "target_x" in hits.columns and (method != "first_hit_pointcloud" or fallback == "bref_target_xy")
    prefix = "fallback_" if method == "first_hit_pointcloud" else ""
    options = []
    if method == "first_hit_pointcloud":
        reach = F.col("anchor_range")
        options.append(("first_hit_pointcloud", tuple(c + d * reach for c, d in zip(cam, fwd)), reach.isNotNull()))
    if marked:
        place = (F.col("target_x"), F.col("target_y"), F.col("ground_z"))
        options.append((f"{prefix}bref_target_xy", place, F.col("target_x").isNotNull() & F.col("target_y").isNotNull()))
    floor = C.ray_plane(cam, fwd, F.col("ground_z"))
    options.append((f"{prefix}ray_ground_intersection", floor, floor[2].isNotNull()))
    source, spot = F.lit("none"), [F.lit(None).cast("double")] * 3
    for name, place, known in reversed(options):
        source = F.when(known, name).otherwise(source)
        spot = [F.when(known, p).otherwise(s) for p, s in zip(place, spot)]
    out = rows.withColumn("anchor_source", source).withColumns({f"anchor_{n}": s for n, s in zip("xyz", spot)})
    if aim:
        line = unit(minus(vec("anchor_x", "anchor_y", "anchor_z"), cam))
        out = out.withColumns({f"fwd_{n}": F.coalesce(x, F.col(f"fwd_{n}")) for n, x in zip("xyz", line)})
    return out


def ground(points: DataFrame, share: float = 0.05) -> DataFrame:
    """One row: ground_z, the low percentile of all z."""
    found = ranks.percentiles(points, "z", [share]).get(None)
    return points.sparkSession.createDataFrame([(found[1][0] if found else None,)], "ground_z double")


def center(anchors: DataFrame) -> DataFrame:
    """The medians of the anchors, and the median distance of the cameras to them."""
    rows = shared.written(anchors.select(*[f"{of}_{c}" for of in ("anchor", "cam") for c in "xyz"]))
    middle = {k: at[0] for k, (_, at) in ranks.percentiles(ranks.long(rows, [f"anchor_{c}" for c in "xyz"]), "x", [0.5], "name").items()}
    at = [F.lit(middle.get(f"anchor_{c}")).cast("double") for c in "xyz"]
    gap = minus(vec("cam_x", "cam_y", "cam_z"), tuple(at))
    far = ranks.percentiles(rows.select(F.sqrt(dot(gap, gap)).alias("gap")), "gap", [0.5]).get(None)
    row = [middle.get(f"anchor_{c}") for c in "xyz"] + [far[1][0] if far else None]
    return rows.sparkSession.createDataFrame([tuple(row)], "center_x double, center_y double, center_z double, radius double")


def source_counts(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("anchor_source").agg(F.count("*").alias("n"))


def target_points(points: DataFrame, box: dict[str, tuple[float, float]], least: int = 20, circle: tuple[float, float, float] | None = None) -> DataFrame:
    """Points in ranges of coordinates and, with circle (x, y, radius), around a centre; an error
    if there are too few."""
    out = points
    if circle:
        x, y, r = circle
        out = out.where((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= r * r)
    for c, (lo, hi) in box.items():
        out = out.where(F.col(c).between(lo, hi))
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} target points")
    return out


def top_and_base(points: DataFrame) -> DataFrame:
    """Mean positions of the points at or above the 95th rank of z, and at or below the 5th.
    The two ranks' values come from ranks.py; nothing is sorted as a whole."""
    high, low = (lambda n: max(0, int(0.95 * n) - 1)), (lambda n: min(n - 1, max(0, int(0.05 * n))))
    n, at = ranks.order_statistics(points, "z", lambda n: [high(n), low(n)]).get(None, (0, {}))
    z_hi, z_lo = (F.lit(at.get(f(n))).cast("double") for f in (high, low))
    sides = {"top": F.col("z") >= z_hi, "base": F.col("z") <= z_lo}
    return points.agg(*[F.avg(F.when(cond, F.col(c))).alias(f"{side}_{c}") for side, cond in sides.items() for c in "xyz"])


def annotation_status(status, u_top, v_top, u_base, v_base):
    """none stays; else by which ends are marked; unknown words count as pending."""
    top, base = u_top.isNotNull() & v_top.isNotNull(), u_base.isNotNull() & v_base.isNotNull()
    return (
        F.when(F.lower(F.trim(status)) == "none", "none")
        .when(top & base, "full")
        .when(top, "top_only")
        .when(base, "base_only")
        .otherwise("pending")
    )
