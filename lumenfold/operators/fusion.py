"""Weighted fusion of a point's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spectral
from ..functions.scoring import base_weight

DEFAULTS = {
    "view_weight_raw": 1.0, "visibility_score": 0.0, "range_m": 0.0, "offaxis_deg": 0.0, "border_dist_px": 0.0, "view_zenith_deg": 0.0,
    "surface_view_cos": 1.0, "surface_verticality": 0.0, "normal_confidence": 0.0, "local_empty_cone_deg": 180.0, "blocker_count": 0, "is_clear": True,
}
AVERAGED = ("range_m", "offaxis_deg", "border_dist_px", "local_empty_cone_deg", "view_zenith_deg", "surface_view_cos", "surface_verticality")


def weighted(views: DataFrame, mode: str = "surface_adaptive", **settings) -> DataFrame:
    """Adds w, a weight that sums to one for each point; views without a finite score or a
    positive finite weight go.  The window and the later groupBy share one exchange."""
    lacking = {c: F.lit(v) for c, v in DEFAULTS.items() if c not in views.columns}
    per_point = Window.partitionBy("point_id")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    out = views.withColumns(lacking).where(finite("visibility_score")).withColumn("best", F.max("visibility_score").over(per_point))
    out = out.withColumn("base", base_weight(mode, F.col("best"), **settings)).where(finite("base") & (F.col("base") > 0))
    return out.withColumn("w", F.col("base") / F.sum("base").over(per_point)).where("w > 0").drop("best", "base")


#: What is kept of a point's primary view, the one with the greatest weight.
PRIMARY = ("range_m", "offaxis_deg", "border_dist_px", "local_empty_cone_deg", "view_zenith_deg", "surface_view_cos")


def fused(views: DataFrame, bands: list[str], numbers: dict[int, str] | None = None) -> DataFrame:
    """One row for each point of weighted() views: bands and metrics, entropy, and its primary view's scene, weight,
    share of the weights and own metrics.  numbers (number: column) with bands 81 and 128: also their NDVI."""
    total = F.sum("w")
    primary = F.max_by(F.struct("scene_code", "w", *PRIMARY), F.struct("w", -F.col("scene_code")))
    out = views.groupBy("point_id").agg(
        F.count("*").alias("views"),
        total.alias("weight_sum"),
        (F.sum(F.col("w") * F.col("is_clear").cast("double")) / total).alias("clear_ratio"),
        *[(F.sum(F.col("w") * F.col(b)) / total).alias(b) for b in bands],
        *[(F.sum(F.col("w") * F.col(c)) / total).alias(f"mean_{c}") for c in AVERAGED],
        (-F.sum(F.col("w") * F.ln(F.greatest("w", F.lit(1e-12))))).alias("entropy"),
        primary.alias("primary"),
    )
    own = {"primary_scene": F.col("primary.scene_code"), "primary_weight": F.col("primary.w"), "primary_ratio": F.col("primary.w") / F.col("weight_sum")}
    out = out.withColumns({"effective_views": F.exp("entropy"), **own, **{f"primary_{c}": F.col(f"primary.{c}") for c in PRIMARY}}).drop("primary")
    if numbers and {81, 128} <= set(numbers):
        out = out.withColumn("ndvi_81_128", spectral.ndvi(F.col(numbers[81]), F.col(numbers[128])))
    return out


def scene_summary(views: DataFrame, outside) -> DataFrame:
    """Per scene of weighted() views; outside: a condition for views off the centre window."""
    return views.groupBy("scene_code").agg(
        F.count("*").alias("views"), F.count_distinct("point_id").alias("points"), F.sum("w").alias("weight_sum"), F.count_if(outside).alias("outside")
    )
