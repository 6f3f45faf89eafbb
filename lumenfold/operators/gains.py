"""Scene gains from overlaps, their stability, and fusion weighted by quality.

The two-way fit keeps its rows where they are: dealt once by ranges of points, in the order of band and point,
and kept on the executors' disks.  What doesn't change is summed once, so a step passes once through the rows: it joins the
scene effects, sums by point and by scene, and only the sums by scene are shuffled.  As neighbouring points see the
same scenes, a task sums few of them, and the sums grow with the scenes, not with scenes times tasks.  Effects are a table,
written in each step; the driver gets three numbers for each band, the center and the ends of the changes.  Effects of bands that
fit together under EFFECTS rows are broadcast, so bands are fitted in groups of that size; a band with more scenes joins by a shuffle.
Percentiles are those of ranks.py.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .sizes import small, tasks
from ..functions import spectral
from ..sources import shared

#: Effects (band, scene, two numbers) up to which they are broadcast.
EFFECTS = 1_000_000
#: Rows that a task of the fit passes through in a step.
TASK_ROWS = 1_000_000


def _by_point(x) -> Column:
    """The sum of x over all rows of the row's band and point."""
    return F.sum(x).over(Window.partitionBy("band", "point_id"))


def unpivoted(views: DataFrame, bands: list[str], keep: list[str]) -> DataFrame:
    """keep, band (number from 1) and value."""
    return views.select(*keep, F.posexplode(F.array(*[F.col(b).cast("double") for b in bands])).alias("band", "value")).withColumn("band", F.col("band") + 1)


def fit_rows(long: DataFrame, low=1e-6, high=2.0, trim=(0.01, 0.99), min_views=2, min_rows=10_000) -> DataFrame:
    """Rows (band, point_id, scene_code, y, w) fit for estimation, of bands that have min_rows of them before
    and after the trimming."""
    inside = long.where((F.col("value") > low) & (F.col("value") < high))
    n = lambda *by: F.count("*").over(Window.partitionBy(*by))
    rows = inside.withColumn("views", n("point_id", "band")).where(F.col("views") >= min_views)
    rows = rows.withColumn("y", F.ln(F.greatest("value", F.lit(low)))).select("band", "point_id", "scene_code", "y", "w")
    rows = shared.written(rows)
    found = ranks.percentiles(rows, "y", list(trim), "band")
    limits = [(int(band), *at) for band, (n, at) in found.items() if n >= min_rows]
    limits = long.sparkSession.createDataFrame(limits, "band int, lo double, hi double")  # a row for each band
    trimmed = rows.join(F.broadcast(limits), "band").where(F.col("y").between(F.col("lo"), F.col("hi")))
    enough = trimmed.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select("band")
    w = F.when((F.col("w") > 0) & (F.col("w") < float("inf")) & ~F.isnan("w"), F.col("w")).otherwise(F.lit(1.0)).alias("w")
    return trimmed.join(small(enough), "band", "left_semi").select("band", "point_id", "scene_code", "y", w)


def dealt(rows: DataFrame, scenes: DataFrame, n: int) -> DataFrame:
    """rows as (band, point_id, at, w, share, rest), kept on executors' disks: at is the number of band and scene in scenes(band,
    scene_code, at), share the part of w in its point's sum, rest y less its point's mean.  Dealt by ranges of points, as
    neighbours see the same scenes, so a task holds few of them."""
    have = rows.join(small(scenes.select("band", "scene_code", "at"), EFFECTS), ["band", "scene_code"])
    ranged = have.select("band", "point_id", "at", "y", "w").repartitionByRange(n, "point_id").sortWithinPartitions("band", "point_id")
    weight = _by_point("w")
    rest = F.col("y") - _by_point(F.col("y") * F.col("w")) / weight
    return ranged.select("band", "point_id", "at", "w", (F.col("w") / weight).alias("share"), rest.alias("rest")).persist(StorageLevel.DISK_ONLY)


def iterate(rows: DataFrame, effects: DataFrame) -> DataFrame:
    """at and `met`, the weighted sum of what the effects(at, effect) take from the scene's points.  The fit without effects plus met over
    the scene's weight is the scene's raw effect in the next step."""
    point = _by_point(F.col("share") * F.col("effect"))
    return rows.join(effects, "at").withColumn("point", point).groupBy("at").agg(F.sum(F.col("w") * F.col("point")).alias("met"))


def _groups(sizes: dict[int, int]) -> list[list[int]]:
    """Bands dealt to groups of up to EFFECTS scenes together, one band at least."""
    out, held = [], 0
    for band, n in sorted(sizes.items()):
        if not out or held + n > EFFECTS:
            out.append([])
            held = 0
        out[-1].append(band)
        held += n
    return out


def fitted(rows: DataFrame, iterations: int = 20, tolerance: float = 1e-5, min_scene_rows: int = 1000, gain=(0.5, 2.0)) -> DataFrame:
    """band, scene_code, gain.  Each band stops once its effects move by no more than the tolerance.  Bands with fewer
    than two valid scenes gain 1."""
    spark = rows.sparkSession
    rows = shared.written(rows)
    counts = rows.groupBy("band", "scene_code").agg(F.count("*").alias("n")).where("band is not null and scene_code is not null")
    counts = shared.written(counts.withColumn("at", F.monotonically_increasing_id()))  # written once, so a scene keeps its number
    valid = F.col("n") >= min_scene_rows
    found = counts.groupBy("band").agg(F.count_if(valid), F.count("*"), F.sum("n")).collect()  # numbers for each band
    enough = [band for band, n, _, _ in found if n >= 2]
    sizes = {band: n for band, _, n, _ in found}
    edges = dealt(rows, counts, tasks(spark, sum(n for *_, n in found), TASK_ROWS))
    first = edges.groupBy("at").agg((F.sum(F.col("w") * F.col("rest")) / F.sum("w")).alias("base"), F.sum("w").alias("weight"))
    start = counts.withColumn("valid", valid & F.col("band").isin(enough)).drop("n").withColumn("effect", F.lit(0.0))
    scenes = shared.written(start.join(first, "at").withColumn("raw", F.col("base")))
    done = None
    for active in _groups(sizes) if iterations > 0 else ():
        after = scenes.where(F.col("band").isin(active))
        for step in range(iterations):
            if step:
                effects = state.select("at", "effect")
                effects = F.broadcast(effects) if sum(sizes[b] for b in active) <= EFFECTS else effects
                sums = iterate(edges.where(F.col("band").isin(active)), effects)
                after = shared.written(state.join(sums, "at").withColumn("raw", F.col("base") + F.col("met") / F.col("weight")).drop("met"))
            went = F.col("raw") - F.col("effect")
            numbers = after.where("valid").groupBy("band").agg(F.try_divide(F.sum(F.col("raw") * F.col("weight")), F.sum("weight")), F.max(went), F.min(went)).collect()
            centers = {b: (0.0, 0.0) for b in active} | {b: (c or 0.0, max(most - (c or 0.0), (c or 0.0) - least)) for b, c, most, least in numbers}
            center = spark.createDataFrame([(b, c) for b, (c, _) in centers.items()], "band int, center double")
            state = after.join(F.broadcast(center), "band").withColumn("effect", F.when(F.col("valid"), F.col("raw") - F.col("center")).otherwise(F.lit(0.0))).drop("raw", "center")
            still = [b for b in active if centers[b][1] > tolerance and step < iterations - 1]
            if len(still) < len(active):
                ended = state.where(~F.col("band").isin(still))
                done = ended if done is None else done.union(ended)
            active, state = still, state.where(F.col("band").isin(still))
            if not active:
                break
    edges.unpersist()
    out = start if done is None else done
    g = F.when(F.col("valid"), F.exp(-F.col("effect"))).otherwise(F.lit(1.0))
    return out.select("band", "scene_code", F.greatest(F.least(g, F.lit(gain[1])), F.lit(gain[0])).alias("gain"))


def applied(long: DataFrame, gains: DataFrame) -> DataFrame:
    """value times its scene's gain; a scene without one keeps its values."""
    out = long.join(small(gains.select("band", "scene_code", "gain"), EFFECTS), ["band", "scene_code"], "left")
    return out.withColumn("value", F.col("value") * F.coalesce("gain", F.lit(1.0))).drop("gain")


def corrected(views: DataFrame, gains: DataFrame, bands: dict[str, int], wavelengths: list[float] | None = None, numbers: dict[str, int] | None = None) -> DataFrame:
    """views(scene_code, a column for each band) times their scene's gains; bands: column: the band of the gains.

    With numbers (column: number in the image, for all bands) that have the four index bands, these are computed anew
    from the corrected reflectances: green, red, red edge and two of near infrared are the bands nearest to their
    wavelengths within 3 nm, else the usual ones.  A scene without gains keeps its values; one row a scene is joined.
    """
    per = gains.groupBy("scene_code").agg(F.map_from_entries(F.collect_list(F.struct("band", "gain"))).alias("_gains"))
    out = views.join(small(per), "scene_code", "left")
    out = out.withColumns({c: F.col(c) * F.coalesce(F.col("_gains")[F.lit(b)], F.lit(1.0)) for c, b in bands.items()}).drop("_gains")
    at = {n: c for c, n in (numbers or {}).items()}
    if not set(spectral.INDEX_BANDS) <= set(at):
        return out
    nm = wavelengths or []
    source = {k: at.get(spectral.nearest_band(nm, target, usual)) for k, (target, usual) in spectral.INDEX_SOURCES.items()}
    lacking = [k for k, c in source.items() if c is None]
    if lacking:
        raise ValueError(f"no band for {lacking}")
    made = spectral.indices(*[F.col(source[k]) for k in spectral.INDEX_SOURCES])
    return out.withColumns({at[n]: made[name.lower()] for n, name in spectral.INDEX_BANDS.items()})


def stability(gains: DataFrame, scale: float = 0.5, least: float = 0.35, boundary_penalty: float = 0.5) -> DataFrame:
    """scene_code, stability: falls with the mean and spread of log gains and with clipped gains."""
    good = gains.where(F.col("gain") > 1e-12)
    edges = good.agg(F.min("gain").alias("lo"), F.max("gain").alias("hi"))
    g = good.crossJoin(F.broadcast(edges)).withColumn("l", F.ln("gain"))
    at_edge = (F.col("gain") <= F.col("lo") + 1e-9) | (F.col("gain") >= F.col("hi") - 1e-9)
    s = g.groupBy("scene_code").agg(
        F.avg(F.abs("l")).alias("m"), F.coalesce(F.stddev_samp("l"), F.lit(0.0)).alias("s"), F.avg(at_edge.cast("double")).alias("e")
    )
    raw = F.exp(-(F.col("m") + F.col("s")) / scale) * (1.0 - boundary_penalty * F.col("e"))
    return s.select("scene_code", F.least(F.greatest(raw, F.lit(least)), F.lit(1.0)).alias("stability"))


def usable(views: DataFrame, levels=("high", "medium"), offaxis=35.0, border=30.0, cone=8.0, cosine=0.35) -> DataFrame:
    return views.where(
        F.col("point_id").isNotNull() & F.col("is_clear") & F.col("brf_quality_level").isin(*levels) & (F.col("offaxis_deg") <= offaxis)
        & (F.col("border_dist_px") >= border) & (F.col("local_empty_cone_deg") >= cone) & (F.col("surface_view_cos") >= cosine)
    )


def view_weights(views: DataFrame, scene_weights: DataFrame | None = None, high=1.0, medium=0.7, low=0.25) -> DataFrame:
    """Adds w: level times raw weight times stability, over its median."""
    level = F.col("brf_quality_level")
    w = F.when(level == "high", high).when(level == "medium", medium).otherwise(low)
    w = w * F.when(F.col("view_weight_raw") > 0, F.col("view_weight_raw")).otherwise(F.lit(1.0))
    if scene_weights is not None:
        views = views.join(small(scene_weights), "scene_code", "left")
        w = w * F.coalesce("stability", F.lit(1.0))
    out = views.withColumn("w", F.when(w > 1e-12, w).otherwise(F.lit(1.0)))
    out = shared.written(out)
    middle = ranks.percentiles(out, "w", [0.5]).get(None, (0, [1.0]))[1][0]
    return out.withColumn("w", F.col("w") / middle) if middle > 1e-12 else out


def clipped(views: DataFrame, bands: dict[str, int], low=0.005, high=0.98, margin=0.0) -> DataFrame:
    """Bands (column: number) bounded by their global percentiles; reflectances at least 0,
    index bands in [-1, 1] (the ratio band has no bounds)."""
    out = views = shared.written(views)
    found = ranks.percentiles(ranks.long(views, list(bands)), "x", [low, high], "name")
    for b, number in bands.items():
        lo, hi = found[b][1] if b in found else (0.0, 0.0)
        span = max(hi - lo, 1e-12) * margin
        x = F.least(F.greatest(F.col(b), F.lit(lo - span)), F.lit(hi + span))
        if number <= 164:
            x = F.greatest(x, F.lit(0.0))
        elif number != 166:
            x = F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
        out = out.withColumn(b, F.when(F.col(b).isNotNull() & ~F.isnan(b), x).otherwise(F.col(b)))
    return out.select(*views.columns)


def fused(views: DataFrame, bands: list[str]) -> DataFrame:
    """point_id, weight_sum and the bands' weighted means over their known values."""
    known = lambda b: F.col(b).isNotNull() & ~F.isnan(b)
    mean = lambda b: F.try_divide(F.sum(F.when(known(b), F.col("w") * F.col(b))), F.sum(F.when(known(b), F.col("w")))).alias(b)
    return views.groupBy("point_id").agg(F.sum("w").alias("weight_sum"), *[mean(b) for b in bands])


def with_fallback(best: DataFrame, fallback: DataFrame, bands: list[str]) -> DataFrame:
    """A point without a value in any band takes the whole row of the fallback."""
    other = fallback.select("point_id", *[F.col(b).alias(f"_{b}") for b in bands])
    out = fallback.select("point_id").join(best.select("point_id", *bands), "point_id", "left").join(other, "point_id")
    whole = F.lit(True)
    for b in bands:
        whole = whole & F.col(b).isNotNull() & ~F.isnan(b)
    whole = F.coalesce(whole, F.lit(False))
    return out.select("point_id", *[F.when(whole, F.col(b)).otherwise(F.col(f"_{b}")).alias(b) for b in bands], (~whole).alias("from_fallback"))


def rmse_columns(table: DataFrame, targets: list[tuple[str, str]], prefix: str) -> DataFrame:
    """Pixel errors of (du, dv) pairs: each one's length, and their greatest and mean over known ones."""
    names = [f"{prefix}_error_{i}" for i in range(1, len(targets) + 1)]
    out = table.withColumns({n: F.hypot(u, v) for n, (u, v) in zip(names, targets)})
    known = F.array_compact(F.array(*names))
    return out.withColumn(f"{prefix}_max", F.array_max(known)).withColumn(
        f"{prefix}_mean", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    )
