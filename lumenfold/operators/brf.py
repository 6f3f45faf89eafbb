"""Directional observation tables: ids, quality levels, point and angle statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import point_quality, quality_level

#: The directional table's columns in their order.
PAPER_COLUMNS = (
    "observation_id", "point_id", "scene_id", "scene_code", "x", "y", "z", "normal_x", "normal_y", "normal_z", "u", "v", "range_m", "offaxis_deg",
    "border_dist_px", "view_zenith_deg", "view_azimuth_deg", "solar_zenith_deg", "solar_azimuth_deg", "relative_azimuth_deg", "local_view_angle_deg",
    "local_solar_incidence_deg", "is_backlit", "surface_view_cos", "surface_verticality", "normal_confidence", "local_empty_cone_deg", "blocker_count",
    "image_zbuffer_clear", "is_clear", "selection_method", "fusion_rank_within_point", "view_weight_raw", "brf_quality_level",
)
#: What some of them are called in views.
VIEW_NAMES = {"normal_x": "nx", "normal_y": "ny", "normal_z": "nz", "image_zbuffer_clear": "zbuffer_clear", "fusion_rank_within_point": "fusion_rank",
              "solar_azimuth_deg": "sun_azimuth_deg"}


def paper_columns(views: DataFrame, whole: bool = False) -> DataFrame:
    """The table's columns that views have, under its names or those of views, in order; with whole, an
    error if any is missing."""
    at = {c: c if c in views.columns else VIEW_NAMES.get(c, c) for c in PAPER_COLUMNS}
    lacking = [c for c, old in at.items() if old not in views.columns]
    if whole and lacking:
        raise ValueError(f"columns {lacking} are missing")
    return views.select(*[F.col(old).alias(c) for c, old in at.items() if c not in lacking])


def with_geometry(views: DataFrame, points: DataFrame) -> DataFrame:
    """views with the place and normal of their points."""
    have = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in points.columns]
    return views.drop(*have).join(points.select("point_id", *have), "point_id")


def with_spectrum(views: DataFrame, spectra: DataFrame, n_points: int | None = None) -> DataFrame:
    """views with their spectrum by observation_id; with n_points, views of other points than 0 to
    n_points - 1, or of none, take no part."""
    if n_points is not None:
        views = views.where(F.col("point_id").isNotNull() & F.col("point_id").between(0, n_points - 1))
    return views.join(spectra.select("observation_id", "spectrum"), "observation_id")


def with_quality(views: DataFrame) -> DataFrame:
    return views.withColumn("brf_quality_level", quality_level())


def level_counts(views: DataFrame) -> DataFrame:
    return views.groupBy("brf_quality_level").agg(F.count("*").alias("n"))


def point_summary(views: DataFrame, variables: list[str]) -> DataFrame:
    """One row for each point: counts by level, weights, angle extremes, variable statistics."""
    w = F.greatest("view_weight_raw", F.lit(0.0))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    level = F.col("brf_quality_level")
    aggs = [F.count("*").alias("n"), F.count_if("is_clear").alias("n_clear")]
    aggs += [F.count_if(level == x).alias(f"n_{x}") for x in ("high", "medium", "low")]
    aggs += [F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.max(w).alias("_wmax")]
    for name, column in (("view", "view_zenith_deg"), ("relaz", "relative_azimuth_deg"), ("incidence", "local_solar_incidence_deg")):
        aggs += [F.min(finite(column)).alias(f"{name}_min"), F.max(finite(column)).alias(f"{name}_max")]
    aggs.append(F.sum(finite("view_zenith_deg")).alias("_view"))
    for v in variables:
        x = finite(v)
        aggs += [F.avg(x).alias(f"{v}_mean"), F.avg(x * x).alias(f"_{v}_sq"), (F.max(x) - F.min(x)).alias(f"{v}_range")]
    out = views.groupBy("point_id").agg(*aggs)
    out = out.withColumns(
        {
            "primary_ratio": F.try_divide("_wmax", "_w"),
            "effective_views": F.try_divide(F.col("_w") * F.col("_w"), F.col("_w2")),
            "view_mean": F.col("_view") / F.col("n"),  # over all observations, finite or not
            **{f"{x}_range": F.col(f"{x}_max") - F.col(f"{x}_min") for x in ("view", "relaz", "incidence")},
            **{f"{v}_std": F.sqrt(F.greatest(F.col(f"_{v}_sq") - F.col(f"{v}_mean") * F.col(f"{v}_mean"), F.lit(0.0))) for v in variables},
        }
    )
    out = out.withColumn("point_quality", point_quality(F.col("n_clear"), F.col("view_range"), F.col("primary_ratio")))
    return out.drop("_w", "_w2", "_wmax", "_view", *[f"_{v}_sq" for v in variables])


def angular_bins(views: DataFrame, angles: dict[str, float], variables: list[str], width: float = 5.0) -> DataFrame:
    """n, mean, std, sem and ci95 of each variable in bins of each angle (name: greatest), with
    the empty bins; angles below 0 or above the greatest fall out."""
    long = views.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("angle"), F.col(a).alias("at"), F.lit(m).alias("most")) for a, m in angles.items()])).alias("a"),
        F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables]).alias("v"),
    ).select("a.*", F.explode("v").alias("v")).select("angle", "at", "most", "v.variable", "v.x")
    good = long.where(F.col("at").between(0.0, F.col("most")) & F.col("x").isNotNull() & ~F.isnan("x"))
    bins = F.floor(F.least("at", F.col("most") - 1e-9) / width).cast("int")
    stats = good.groupBy("angle", "variable", bins.alias("bin")).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    frame = views.sparkSession.createDataFrame(
        [(a, v, i) for a, m in angles.items() for v in variables for i in range(math.ceil(m / width))], "angle string, variable string, bin int"
    )
    out = frame.join(stats, ["angle", "variable", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    known = F.col("n") > 0
    return out.select(
        "angle",
        "variable",
        "bin",
        (F.col("bin") * width).alias("bin_left"),
        ((F.col("bin") + 1) * width).alias("bin_right"),
        "n",
        F.when(known, mean).alias("mean"),
        F.when(known, std).alias("std"),
        F.when(known, std / F.sqrt("n")).alias("sem"),
        F.when(known, 1.96 * std / F.sqrt("n")).alias("ci95"),
    )
