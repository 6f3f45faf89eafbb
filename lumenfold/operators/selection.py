"""Depth buffers, view ranking, keep rules and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles


def depth_clear(views: DataFrame, radius: int = 2, tolerance: float = 0.8) -> DataFrame:
    """views(scene_code, u, v, range_m) with near_m and zbuffer_clear: no view in the (2 radius + 1)^2 pixels
    around is nearer by more than the tolerance.  Views are reduced to pixels, and tiles of pixels to the least around each."""
    pixel = views.withColumns({"iu": F.rint("u").cast("long"), "iv": F.rint("v").cast("long")})
    near = tiles.nearest_around(pixel.groupBy("scene_code", "iu", "iv").agg(F.min("range_m").alias("near_m")), radius)
    return pixel.join(near, ["scene_code", "iu", "iv"]).withColumn("zbuffer_clear", F.col("range_m") <= F.col("near_m") + tolerance).drop("iu", "iv")


def with_depth(views: DataFrame) -> DataFrame:
    """Views hidden in the depth buffer get one more blocker and front, and no open cone."""
    hidden = ~F.col("zbuffer_clear")
    return views.withColumns(
        {
            "blocker_count": F.col("blocker_count") + hidden.cast("int"),
            "front_count": F.col("front_count") + hidden.cast("int"),
            "local_empty_cone_deg": F.when(hidden, F.least("local_empty_cone_deg", F.lit(0.0))).otherwise(F.col("local_empty_cone_deg")),
        }
    )


def ranked(views: DataFrame, tie: str = "scene_code", within: tuple[str, ...] = ()) -> DataFrame:
    """fusion_rank of each point's views by eight criteria, then `tie`.  `within` names columns that all rows of a point share: dealt by
    these, they need no exchange."""
    order = [
        -F.col("visibility_score"), -F.col("view_weight_raw"), -F.col("surface_view_cos"),
        -(F.col("view_zenith_deg") * F.col("surface_verticality")), -F.col("local_empty_cone_deg"),
        F.col("offaxis_deg"), -F.col("border_dist_px"), F.col("range_m"), F.col(tie),
    ]
    return views.withColumn("fusion_rank", F.row_number().over(Window.partitionBy(*within, "point_id").orderBy(*order)))


def kept(views: DataFrame, max_visible=49, max_fallback=49, penalty=0.05, fallback=True, keep_unclear=True, within: tuple[str, ...] = ()) -> DataFrame:
    """Of ranked views: a point with a clear view keeps its first max_visible (unclear ones stay
    in the table only with keep_unclear); one without keeps max_fallback at a lower weight.  `within` as in ranked()."""
    point = Window.partitionBy(*within, "point_id")
    any_clear = F.max("is_clear").over(point)
    out = views.withColumn("any_clear", any_clear)
    if not keep_unclear:
        out = out.where(F.col("is_clear") | ~F.col("any_clear"))
        out = out.withColumn("fusion_rank", F.row_number().over(point.orderBy("fusion_rank")))
    chosen = F.when(F.col("any_clear"), F.col("fusion_rank") <= max_visible).otherwise(F.lit(fallback) & (F.col("fusion_rank") <= max_fallback))
    method = F.when(F.col("is_clear"), "clear_keep").when(F.col("any_clear"), "unclear_keep").otherwise("fallback_keep")
    out = out.where(chosen).withColumn("selection_method", method)
    weight = F.when(F.col("selection_method") == "fallback_keep", F.col("view_weight_raw") * penalty).otherwise(F.col("view_weight_raw"))
    return out.withColumn("view_weight_raw", weight).withColumn("keep_for_fusion", F.col("is_clear") | ~F.col("any_clear")).drop("any_clear")


MEANS = (
    "range_m", "offaxis_deg", "border_dist_px", "view_zenith_deg", "surface_view_cos", "surface_verticality",
    "normal_confidence", "visibility_score", "view_weight_raw", "local_empty_cone_deg", "blocker_count",
)


def scene_summary(views: DataFrame) -> DataFrame:
    """Counts and means of the views kept for fusion, for each scene."""
    return (
        views.where("keep_for_fusion")
        .groupBy("scene_code")
        .agg(
            F.count("*").alias("views"),
            F.count_distinct("point_id").alias("points"),
            F.count_if("is_clear").alias("clear"),
            *[F.avg(c).alias(f"mean_{c}") for c in MEANS],
        )
    )
