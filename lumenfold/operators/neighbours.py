"""Bounded neighbours by grid cells, occlusion along view directions, PCA normals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import angle_of_cos, unit, vec
from ..sources import shared
from . import tiles
from .sizes import tasks


#: Pairs of points in adjacent cells that a task compares, about.
TASK_PAIRS = 1_000_000
_CELL = ["cx", "cy", "cz"]


def _met(points: DataFrame, radius: float, closed: bool, with_self: bool, others: DataFrame | None) -> tuple[DataFrame, int]:
    """pairs() with the cell of the point, and the number of tasks; all pairs of a row of points are made in one task."""
    others = points if others is None else others
    cell = lambda c: F.floor(F.col(c) / radius)
    # cells as full as their neighbours would make 27 times the square of their points; by their bytes all would go to a few tasks
    full = others.groupBy(*[cell(c).alias(f"c{c}") for c in "xyz"]).agg(F.count("*").cast("double").alias("n"))
    work = full.agg(F.sum(F.col("n") * F.col("n") * 27.0)).first()[0]
    n = tasks(points.sparkSession, work, TASK_PAIRS)
    right = others.select(F.col("point_id").alias("other_id"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[cell(c).alias(f"b{c}") for c in "xyz"])
    for c in "xyz":
        right = right.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"b{c}") + d for d in (-1, 0, 1)])))
    left = points.select("point_id", "x", "y", "z", *[cell(c).alias(f"c{c}") for c in "xyz"])
    met = left.repartition(n, *_CELL).join(right.drop("bx", "by", "bz").repartition(n, *_CELL), _CELL).select(
        *_CELL, "point_id", "other_id", *[(F.col(f"o{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"]
    )
    met = met.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    near = F.col("d2") <= radius * radius if closed else F.col("d2") < radius * radius
    return met.where(near if with_self else near & (F.col("point_id") != F.col("other_id"))), n


def pairs(points: DataFrame, radius: float, closed: bool = False, with_self: bool = False, others: DataFrame | None = None) -> DataFrame:
    """(point_id, other_id, dx, dy, dz, d2) within the radius, of points and others (the points
    themselves, if none): an equi-join of cells of that size, others in their 27 surrounding cells."""
    return _met(points, radius, closed, with_self, others)[0].drop(*_CELL)


def nearest(points: DataFrame, radius: float, k: int, closed: bool = False, with_self: bool = False, others: DataFrame | None = None) -> DataFrame:
    """The k nearest of those pairs for each point, ties to the lower id, with nth from 1."""
    met, n = _met(points, radius, closed, with_self, others)
    ranked = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("d2", "other_id"))).where(F.col("nth") <= k)
    # first where the pairs are made, without an exchange: of each point at most k travel; rows with the same id are one point
    return ranked(ranked(met, *_CELL, "point_id").drop(*_CELL, "nth").repartition(n, "point_id"), "point_id")


def occlusion(views: DataFrame, points: DataFrame, radius=1.2, most=256, clearance=0.08, min_along=0.08, min_neighbours=2, min_cone=4.0) -> DataFrame:
    """views(point_id, scene_code, dir_x, dir_y, dir_z) of points(point_id, x, y, z): blocker_count, front_count,
    local_empty_cone_deg, tube_clear and cone_clear of each, by the `most` nearest points within the radius.
    Fewer neighbours than min_neighbours: clear, 180 degrees."""
    return judged(tiles.blockers(views, points, radius, most, clearance, min_along), min_neighbours, min_cone)


def judged(met: DataFrame, min_neighbours=2, min_cone=4.0) -> DataFrame:
    """met with occlusion()'s columns in place of the n, blockers, fronts and c that tiles.blockers() counts."""
    enough = F.col("n") >= min_neighbours
    found = {
        "blocker_count": F.when(enough, F.col("blockers")).otherwise(F.lit(0)),
        "front_count": F.when(enough, F.col("fronts")).otherwise(F.lit(0)),
        "local_empty_cone_deg": F.when(enough & F.col("c").isNotNull(), angle_of_cos(F.col("c"))).otherwise(F.lit(180.0)),
    }
    out = met.withColumns(found).drop("n", "blockers", "fronts", "c")
    narrow = (F.lit(min_cone) > 0) & (F.col("front_count") > 0) & (F.col("local_empty_cone_deg") < min_cone)
    return out.withColumn("tube_clear", F.col("blocker_count") == 0).withColumn("cone_clear", ~narrow)


def k_nearest(points: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest of all points for each point, itself included, ties to the lower id; all
    points where there are fewer.  What has k neighbours within `radius` is done after one join;
    the others ask again within twice the radius, and so on up to the points' extent."""
    asked = points.select("point_id", "x", "y", "z")
    box = asked.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    wanted, far = min(k, box["n"]), float(np.sqrt(sum((box[c] or 0.0) ** 2 for c in "xyz")))
    out = None
    while True:
        near = nearest(asked, radius, wanted, True, True, others=points)
        near = shared.written(near.withColumn("met", F.count("*").over(Window.partitionBy("point_id"))))
        done = near.where(F.col("met") == wanted).drop("met")
        out = done if out is None else out.union(done)
        left = near.where((F.col("met") < wanted) & (F.col("point_id") == F.col("other_id"))).select("point_id")
        if radius > far or left.isEmpty():
            return out
        asked = asked.join(left, "point_id", "left_semi")
        radius *= 2


def prepared_normals(points: DataFrame, k: int = 48, radius: float = 1.2, valid_share: float = 0.95) -> DataFrame:
    """point_id, nx, ny, nz, confidence and source: the points' own normals where they have columns
    nx, ny, nz and this share of them is finite and not zero (confidence 1 for those, 0 for the
    others), else PCA normals of the k nearest points."""
    if {"nx", "ny", "nz"} <= set(points.columns):
        length = F.sqrt(sum((F.col(c).cast("double") * F.col(c) for c in ("nx", "ny", "nz")), F.lit(0.0)))
        sound = F.coalesce((length > 1e-12) & (length < float("inf")) & ~F.isnan(length), F.lit(False))
        own = points.withColumn("_sound", sound)
        share = own.agg(F.count_if("_sound").alias("good"), F.count("*").alias("n")).first()
        if share.good >= max(1, int(valid_share * share.n)):
            n = unit(vec("nx", "ny", "nz"), (0.0, 0.0, 0.0))
            named = [F.when(F.col("_sound"), x).otherwise(F.lit(0.0)).alias(c) for c, x in zip(("nx", "ny", "nz"), n)]
            return own.select("point_id", *named, F.col("_sound").cast("double").alias("confidence"), F.lit("ply").alias("source"))
    found = normals(moments(k_nearest(points, max(4, k), radius)))
    return found.select("point_id", "nx", "ny", "nz", "confidence", F.lit("pca").alias("source"))


def moments(near: DataFrame) -> DataFrame:
    """Sample covariances of each point's neighbourhood (itself included in `near`)."""
    pairs_ = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return near.groupBy("point_id").agg(
        F.count("*").alias("n"), *[F.covar_samp(f"d{a}", f"d{b}").alias(f"c{a}{b}") for a, b in pairs_]
    )


def normals(covariances: DataFrame) -> DataFrame:
    """nx, ny, nz (up-facing), verticality and confidence from moments(); an eigenproblem of
    three rows, solved for whole Arrow batches.  A point whose neighbours are all at one place has
    confidence 0; one alone has no covariance and counts the same."""

    def solve(batches):
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for i, x in enumerate("xyz"):
                for j, y in enumerate("xyz"):
                    m[:, i, j] = b["c" + "".join(sorted((x, y)))].fillna(0.0)
            w, v = np.linalg.eigh(m) if len(b) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            n = v[:, :, 0]
            n = n * np.where(n[:, 2:3] < 0, -1.0, 1.0)
            w = np.maximum(w, 0.0)
            total = w.sum(axis=1)
            sure = np.where(total > 1e-12, 1 - w[:, 0] / np.maximum(total, 1e-300), 0.0)
            yield pd.DataFrame(
                {"point_id": b["point_id"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "verticality": 1 - np.abs(n[:, 2]), "confidence": np.clip(sure, 0, 1)}
            )

    return covariances.mapInPandas(solve, "point_id long, nx double, ny double, nz double, verticality double, confidence double")
