"""Candidate views: points against scenes, scored, the best K for each point.

A point meets the scenes that can see into its cell (sight.py).  The score needs no sun, so the sun's
angles are computed for the best views alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import scoring as S
from ..functions.vectors import clip01, vec
from . import sight
from .sizes import small


def projected(points: DataFrame, scenes: DataFrame, max_range: float = 300.0, **image) -> DataFrame:
    """points(point_id, x, y, z, ...) and scenes(scene_code, cam_x.., r11..r33, ...): pairs that
    are in the image and within range, with u, v, range_m, offaxis_deg, border_px."""
    return in_view(sight.pairs(points, scenes, max_range, **image), max_range, **image)


def in_view(pairs: DataFrame, max_range: float = 300.0, **image) -> DataFrame:
    """Of pairs of points and scenes those in the image and within range, with their place in it."""
    return imaged(pairs, **image).where(F.col("inside") & (F.col("range_m") <= max_range)).drop("inside")


def imaged(pairs: DataFrame, **image) -> DataFrame:
    """All pairs of points and scenes, with u, v, range_m, offaxis_deg, border_px and inside."""
    rows = tuple(vec(*[f"r{i}{j}" for j in (1, 2, 3)]) for i in (1, 2, 3))
    return pairs.withColumns(C.project(vec("x", "y", "z"), vec("cam_x", "cam_y", "cam_z"), rows, **image))


def scored(pairs: DataFrame, window: dict[str, int], policy: str = "prefer") -> DataFrame:
    """Adds the view's geometry and coarse_score; policy 'strict' keeps the centre window only."""
    out = pairs.withColumn("center_distance", C.window_distance(F.col("u"), F.col("v"), window))
    if policy == "strict":
        out = out.where("center_distance >= 0")
    out = C.with_view_geometry(out, vec("x", "y", "z"), vec("nx", "ny", "nz"), vec("cam_x", "cam_y", "cam_z"))
    out = out.withColumns({f"_{c}": clip01(F.col(c)) for c in ("surface_verticality", "normal_confidence")})
    score = S.coarse(
        F.col("center_distance"), F.col("offaxis_deg"), F.col("range_m"), F.col("surface_view_cos"),
        F.col("view_zenith_deg"), F.col("_surface_verticality"), F.col("_normal_confidence"),
    )
    out = out.withColumn("coarse_score", score).withColumn("border_dist_px", F.greatest("center_distance", F.lit(0.0)))
    return out.drop("_surface_verticality", "_normal_confidence")


def sunlit(views: DataFrame, suns: DataFrame) -> DataFrame:
    """Scored views with suns(scene_code, sun_x .., sun_azimuth_deg, ...) and their local angles; nulls where the sun is unknown."""
    return lit(views.join(small(suns), "scene_code", "left"))


def lit(views: DataFrame) -> DataFrame:
    """Scored views that have their scene's sun, with the local angles."""
    return views.withColumns(C.solar_local(vec("nx", "ny", "nz"), vec("sun_x", "sun_y", "sun_z"), F.col("sun_azimuth_deg"), F.col("view_azimuth_deg")))


def best(candidates: DataFrame, k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """The k best views of each point, slot 0 first; scores compare as 4-byte floats, ties go to
    the lower scene_code.  `within` names columns that all rows of a point share: dealt by these, they need no exchange."""
    score = F.col("coarse_score").cast("float")
    nth = F.row_number().over(Window.partitionBy(*within, "point_id").orderBy(score.desc(), "scene_code"))
    # a bound on the number itself lets tasks drop views beyond it before the exchange
    return candidates.withColumn("slot", nth).where(F.col("slot") <= k).withColumn("slot", F.col("slot") - 1)


def listed(views: DataFrame, *columns: str) -> DataFrame:
    """One row for each point of sight.met(), with its place, and these columns of its views as a list of structs."""
    place = [F.first(c).alias(c) for c in "xyz"]
    return views.groupBy(*sight.CELL, "point_id").agg(*place, F.collect_list(F.struct(*columns)).alias("views")).drop(*sight.CELL)


def counters(pairs: DataFrame, kept: DataFrame, window: dict[str, int], policy: str = "prefer") -> DataFrame:
    """Per scene: pairs inside, in the centre window, eligible, and finally kept."""
    central = C.in_window(F.col("u"), F.col("v"), window)
    n = pairs.groupBy("scene_code").agg(F.count("*").alias("inside"), F.count_if(central).alias("in_window"))
    n = n.withColumn("eligible", F.col("in_window" if policy == "strict" else "inside"))
    k = kept.groupBy("scene_code").agg(F.count("*").alias("kept"))
    return n.join(k, "scene_code", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))


def detected(kept: DataFrame, evaluated: int) -> DataFrame:
    """point_id of the points with a view among the first `evaluated` slots."""
    return kept.where(F.col("slot") < evaluated).select("point_id").distinct()
