"""The fusion as a stream, in update mode on views as they come.

With raw weights it is a sum of (w x, w) for each point.  In the modes whose weights depend on a point's
best score, a point's state holds the best score so far and its sums relative to it; a better score
rescales the sums, so any order of batches ends in the batch's result.  (Batches bound a score's distance
to the best one at 60 temperatures; here the bound holds within a batch of views, a difference of 1e-26.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import scoring


def running(views: DataFrame, bands: list[str]) -> DataFrame:
    """point_id, views, weight_sum and weighted means over all views so far."""
    good = views.where("view_weight_raw > 0 and not isnan(view_weight_raw)")
    w = F.col("view_weight_raw")
    total = F.sum(w)
    return good.groupBy("point_id").agg(F.count("*").alias("views"), total.alias("weight_sum"), *[(F.sum(w * F.col(b)) / total).alias(b) for b in bands])


def running_best(views: DataFrame, bands: list[str], mode: str = "softmax", temperature: float = 30.0) -> DataFrame:
    """point_id, views, entropy and weighted means of the bands over all views so far, in the modes softmax, hybrid and
    surface_adaptive, by a state for each point: the best score, the number of views, and the sums of w, w ln w and w x."""
    scale = scoring.ADAPTIVE["temperature"] if mode == "surface_adaptive" else temperature
    # with a view's own score as the best, what is left of its weight is the part that depends on the view alone
    own = scoring.base_weight(mode, F.col("visibility_score"), temperature)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = views.where(finite(F.col("visibility_score"))).select("point_id", "visibility_score", own.alias("own"), *bands)
    rows = rows.where(finite(F.col("own")) & (F.col("own") > 0))
    state_schema = "best double, views long, w double, w_ln_w double, " + ", ".join(f"s{i} double" for i in range(len(bands)))
    result = "point_id long, views long, entropy double, " + ", ".join(f"`{b}` double" for b in bands)

    def update(key, pieces, state):
        best, n, w, wl, *sums = state.get if state.exists else (-np.inf, 0, 0.0, 0.0, *[0.0] * len(bands))
        for b in pieces:
            score = b["visibility_score"].to_numpy()
            top = max(best, float(score.max()))
            shrink = np.exp((best - top) / scale) if n else 0.0
            # w ln w of rescaled weights, from the old sums
            wl, w, sums = shrink * (wl + (np.log(shrink) * w if shrink > 0 else 0.0)), shrink * w, [shrink * s for s in sums]
            more = np.exp(np.clip((score - top) / scale, -60.0, 60.0)) * b["own"].to_numpy()
            best, n, w, wl = top, n + len(b), w + float(more.sum()), wl + float((more * np.log(more)).sum())
            sums = [s + float((more * b[c].to_numpy()).sum()) for s, c in zip(sums, bands)]
        state.update((best, n, w, wl, *sums))
        yield pd.DataFrame([(key[0], n, np.log(w) - wl / w, *[s / w for s in sums])], columns=["point_id", "views", "entropy", *bands])

    return rows.groupBy("point_id").applyInPandasWithState(update, result, state_schema, "update", GroupStateTimeout.NoTimeout)


def start(views: DataFrame, bands: list[str], write, checkpoint: str, mode: str = "raw"):
    """Runs the stream; write(DataFrame, batch id) gets the points that changed."""
    made = running(views, bands) if mode == "raw" else running_best(views, bands, mode)
    return made.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
