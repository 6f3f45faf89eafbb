"""Kernels over tiles: blockers along view directions, and depth buffers.

Both problems look a small way around each place: 1.2 m around a point, two pixels around a pixel.
Space (or an image) is cut in tiles; what lies within that reach of a tile comes along as its
halo, so a tile is worked through on its own in arrays, and nothing is exploded to neighbours or to
pairs.  Rows shuffled are those of the tables plus the halos.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import small, tasks

#: Centres (points with views) of a tile that one group takes at most; a fuller tile is dealt to several groups.
CENTRES = 20_000
#: Pairs of points, and of points and views, that are held at a time.
PAIRS = 1 << 20
#: Points whose tiles a task works through, about: by their bytes all would go to a few tasks.
TASK_POINTS = 4_000
#: Views of a tile of an image that one group takes at most; a fuller tile is dealt to several groups.
VIEWS = 200_000
#: Views that a task tests against the depth buffer, about.
TASK_VIEWS = 200_000

_OCCLUDED = "point_id long, met array<struct<scene_code: long, n: long, blockers: long, fronts: long, c: double>>"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class _Cells:
    """Points in the order of their cells, as wide as the radius."""

    def __init__(self, xyz: np.ndarray, radius: float):
        self.low = np.floor(xyz.min(axis=0) / radius).astype(np.int64) - 1
        self.size = np.floor(xyz.max(axis=0) / radius).astype(np.int64) - self.low + 2
        self.radius = radius
        key = self.key(np.floor(xyz / radius).astype(np.int64))
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def key(self, cell: np.ndarray) -> np.ndarray:
        at = cell - self.low
        return (at[:, 0] * self.size[1] + at[:, 1]) * self.size[2] + at[:, 2]

    def around(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, sizes), each n x 9: rows of three cells side by side around each place, as ranges of the order."""
        cell = np.floor(xyz / self.radius).astype(np.int64)
        starts, sizes = np.empty((len(xyz), 9), np.int64), np.empty((len(xyz), 9), np.int64)
        for k, (a, b) in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            key = self.key(cell + np.array([a, b, -1]))
            starts[:, k] = np.searchsorted(self.keys, key, "left")
            sizes[:, k] = np.searchsorted(self.keys, key + 2, "right") - starts[:, k]
        return starts, sizes


def _occluded(ids, xyz, centre_ids, centre_xyz, first, scenes, directions, radius, most, clearance, min_along):
    """Arrays of n, blockers, fronts and c, one for each view; the views of centre i are first[i] to first[i + 1]."""
    views = len(scenes)
    n, blockers, fronts = np.zeros(views, np.int64), np.zeros(views, np.int64), np.zeros(views, np.int64)
    best = np.full(views, np.nan)
    if not len(xyz) or not len(centre_xyz):
        return n, blockers, fronts, best
    cells = _Cells(np.concatenate([xyz, centre_xyz]), radius)
    inside = cells.order < len(xyz)  # centres took part for the extent alone
    cells.order, cells.keys = cells.order[inside], cells.keys[inside]
    starts, sizes = cells.around(centre_xyz)
    work = sizes.sum(axis=1)
    ends = np.cumsum(work)
    at = 0
    while at < len(centre_xyz):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        who = np.repeat(np.arange(at, to), work[at:to])
        other = cells.order[_ranges(starts[at:to].ravel(), sizes[at:to].ravel())]
        d = xyz[other] - centre_xyz[who]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        near = (d2 < radius * radius) & (ids[other] != centre_ids[who])
        who, other, d, d2 = who[near], other[near], d[near], d2[near]
        met = np.bincount(who - at, minlength=to - at)
        if met.max(initial=0) > most:  # the nearest ones, ties to the lower id
            order = np.lexsort((ids[other], d2, who))
            place = np.arange(len(order)) - np.repeat(np.cumsum(met) - met, met)
            order = order[place < most]
            who, d, d2 = who[order], d[order], d2[order]
            met = np.minimum(met, most)
        begin = np.cumsum(met) - met
        # each view meets its centre's neighbours
        own = np.repeat(np.arange(at, to), np.diff(first[at : to + 1]))
        pairs = met[own - at]
        v = first[at]
        while v < first[to]:
            upto = v + max(1, int(np.searchsorted(np.cumsum(pairs[v - first[at] :]), PAIRS, "right")))
            upto = min(upto, first[to])
            some = pairs[v - first[at] : upto - first[at]]
            n[v:upto] = some
            full = np.flatnonzero(some)
            if len(full):
                rows = _ranges(begin[own[v - first[at] : upto - first[at]] - at][full], some[full])
                view = np.repeat(np.arange(v, upto)[full], some[full])
                t = d[rows, 0] * directions[view, 0] + d[rows, 1] * directions[view, 1] + d[rows, 2] * directions[view, 2]
                front = (t > max(1e-9, min_along)) & (d2[rows] > 0)
                blocks = front & (np.maximum(d2[rows] - t * t, 0.0) <= clearance * clearance)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.where(front, t / np.sqrt(d2[rows]), -np.inf)
                cut = np.cumsum(some[full]) - some[full]
                blockers[v:upto][full] = np.add.reduceat(blocks.astype(np.int64), cut)
                fronts[v:upto][full] = np.add.reduceat(front.astype(np.int64), cut)
                top = np.maximum.reduceat(cosine, cut)
                best[v:upto][full] = np.where(np.isfinite(top), top, np.nan)
            v = upto
        at = to
    return n, blockers, fronts, best


def blockers(views: DataFrame, points: DataFrame, radius: float = 1.2, most: int = 256, clearance: float = 0.08, min_along: float = 0.08, side: float = 5.0) -> DataFrame:
    """views(point_id, scene_code, dir_x, dir_y, dir_z) of points(point_id, x, y, z): for each view n, the point's neighbours
    (the `most` nearest of those nearer than the radius, ties to the lower id), fronts, those of them at least min_along
    ahead of it, blockers, those also within the clearance of the line of sight, and c, the greatest cosine to one in front.

    A point's views travel as one row (see listed_blockers).  Views of points without a place have no neighbours.
    """
    columns = [F.col("scene_code").cast("long").alias("scene_code"), *[F.col(f"dir_{c}").cast("double").alias(f"dir_{c}") for c in "xyz"]]
    per = views.groupBy("point_id").agg(F.collect_list(F.struct(*columns)).alias("views"))
    centres = per.join(_places(points), "point_id", "left")
    return listed_blockers(centres, points, radius, most, clearance, min_along, side).select("point_id", F.inline("met"))


def _whole(column) -> pa.Array:
    """A column's chunks as one array."""
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _places(points: DataFrame) -> DataFrame:
    return points.select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where("not isnan(x + y + z)")


def listed_blockers(centres: DataFrame, points: DataFrame, radius: float = 1.2, most: int = 256, clearance: float = 0.08, min_along: float = 0.08, side: float = 5.0) -> DataFrame:
    """blockers() of centres(point_id, x, y, z, views), where views lists structs of scene_code and dir_x .. dir_z: point_id and met, the list of what each view meets.

    A centre travels as one row to the tile (`side` radii wide) it lies in; points travel to the tiles they lie
    in and to those within the radius.  A tile with more than CENTRES points is dealt to several groups by a hash of the centres.
    """
    side = side * radius
    tile = lambda x: F.floor(x / side)
    place = _places(points)
    lists = ["scene_code", "dir_x", "dir_y", "dir_z"]
    centres = centres.select("point_id", "x", "y", "z", *[F.col(f"views.{c}").alias(c) for c in lists]).withColumns({f"t{c}": tile(F.col(c)) for c in "xyz"})
    sizes = place.groupBy(*[tile(F.col(c)).alias(f"t{c}") for c in "xyz"]).agg(F.count("*").alias("_n"))
    full = small(sizes.where(F.col("_n") > CENTRES).withColumn("_parts", F.ceil(F.col("_n") / CENTRES)).drop("_n"))  # few, but not by what Spark expects
    parts = F.coalesce("_parts", F.lit(1)).cast("int")
    keys = ["tx", "ty", "tz", "part"]
    centres = centres.join(full, ["tx", "ty", "tz"], "left").withColumn("part", F.pmod(F.xxhash64("point_id"), parts).cast("int"))
    spread = place
    for c in "xyz":
        spread = spread.withColumn(f"t{c}", F.explode(F.sequence(tile(F.col(c) - radius), tile(F.col(c) + radius))))
    spread = spread.join(full, ["tx", "ty", "tz"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    n = tasks(points.sparkSession, place.count(), TASK_POINTS)
    both = centres.select(*keys, "point_id", "x", "y", "z", *lists).unionByName(spread.select(*keys, "point_id", "x", "y", "z"), allowMissingColumns=True)

    def run(table):
        table = table.combine_chunks()
        centre = np.asarray(table.column("scene_code").is_valid())
        ids, xyz = table.column("point_id").to_numpy(), np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        held = [_whole(table.column(c).drop_null()) for c in lists]
        counts = np.asarray(held[0].value_lengths()).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        scenes, *along = (h.flatten().to_numpy(zero_copy_only=False) for h in held)
        others = ~centre
        found = _occluded(ids[others], xyz[others], ids[centre], xyz[centre], first, scenes, np.stack(along, axis=1), radius, most, clearance, min_along)
        views = [pa.array(scenes.astype(np.int64)), *map(pa.array, found[:3]), pa.array(found[3], from_pandas=True)]
        met = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(views, names=["scene_code", "n", "blockers", "fronts", "c"]))
        return pa.Table.from_arrays([pa.array(ids[centre]), met], names=["point_id", "met"])

    return both.repartition(n, *keys).groupBy(*keys).applyInArrow(run, _OCCLUDED)


def least_around(u: np.ndarray, v: np.ndarray, near: np.ndarray, radius: int) -> np.ndarray:
    """For each of the pixels (u, v), all different, the least value of the pixels up to radius away in both directions.  Two
    passes: along v each value reaches the places beside it, which keep the least; along u each pixel looks at the
    places beside it.  Work goes by the pixels that there are."""
    shifts = np.arange(-radius, radius + 1)
    width = int(v.max() - v.min()) + 4 * radius + 1
    key = (u - u.min()) * width + (v - v.min()) + 2 * radius
    spread = (key[:, None] + shifts).ravel()
    order = np.argsort(spread, kind="stable")
    spread = spread[order]
    first = np.flatnonzero(np.append(True, spread[1:] != spread[:-1]))
    places, least = spread[first], np.fmin.reduceat(np.repeat(near, len(shifts))[order], first)
    out = np.full(len(key), np.inf)
    for shift in shifts:
        wanted = key + shift * width
        at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
        out = np.fmin(out, np.where(places[at] == wanted, least[at], np.inf))
    return out


def nearest_around(pixels: DataFrame, radius: int = 2, side: int = 512) -> DataFrame:
    """pixels(scene_code, iu, iv, near_m), one row a pixel: the least near_m of the pixels up to radius away in both
    directions.  A pixel goes to its tile, and to the tiles that have it in their halo."""
    tile = lambda x: F.floor(x / side)
    spread = pixels
    for c in "uv":
        at = F.col(f"i{c}")
        spread = spread.withColumn(f"t{c}", F.explode(F.sequence(tile(at - radius), tile(at + radius))))

    def run(key, table):
        scene, *tiles = (k.as_py() for k in key)
        u, v, near = (table.column(c).to_numpy() for c in ("iu", "iv", "near_m"))
        least = least_around(u, v, near, radius)
        own = (u // side == tiles[0]) & (v // side == tiles[1])
        values = [pa.array(np.full(own.sum(), scene, np.int64)), *(pa.array(x[own]) for x in (u, v, least))]
        return pa.Table.from_arrays(values, names=["scene_code", "iu", "iv", "near_m"])

    kinds = "scene_code long, iu long, iv long, near_m double"
    typed = spread.select(*[F.col(c).cast(k).alias(c) for c, k in (f.split() for f in kinds.split(", "))], "tu", "tv")
    return typed.groupBy("scene_code", "tu", "tv").applyInArrow(run, kinds)


def hidden(views: DataFrame, radius: int = 2, tolerance: float = 0.8, side: int = 512) -> DataFrame:
    """(point_id, scene_code) of those of views(point_id, scene_code, u, v, range_m) that another hides: one in the pixels up to radius away in both
    directions is nearer by more than the tolerance.

    A view travels once, to the tile of its pixel (and to those that have it in their halo), and only hidden ones come out.  A group takes many tiles.
    Of a tile with more than VIEWS views several groups take a share each, with the least of each of its pixels.
    """
    tile = lambda x: F.floor(x / side)
    spread = views.select("point_id", F.col("scene_code").cast("long").alias("scene_code"), *[F.rint(c).cast("long").alias(f"i{c}") for c in "uv"], F.col("range_m").cast("double").alias("range_m"))
    for c in "uv":
        at = F.col(f"i{c}")
        spread = spread.withColumn(f"t{c}", F.explode(F.sequence(tile(at - radius), tile(at + radius))))
    keys = ["scene_code", "tu", "tv"]
    sizes = spread.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    rows = spread.withColumn("part", F.lit(0))
    if (most or 0) > VIEWS:
        full = small(sizes.where(F.col("_n") > VIEWS).select(*keys, F.ceil(F.col("_n") / VIEWS).cast("int").alias("_parts")))
        many = spread.join(full, keys)
        own = many.where((tile(F.col("iu")) == F.col("tu")) & (tile(F.col("iv")) == F.col("tv"))).withColumn("part", F.pmod(F.xxhash64("point_id"), "_parts").cast("int"))
        pixels = many.groupBy(*keys, "_parts", "iu", "iv").agg(F.min("range_m").alias("range_m")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        rows = spread.join(full, keys, "left_anti").withColumn("part", F.lit(0)).unionByName(own.drop("_parts")).unionByName(pixels.drop("_parts"), allowMissingColumns=True)
    n = tasks(views.sparkSession, total, TASK_VIEWS)

    def run(table):
        scene, tu, tv, part, iu, iv, range_m = (table.column(c).to_numpy() for c in ("scene_code", "tu", "tv", "part", "iu", "iv", "range_m"))
        order = np.lexsort((iv, iu, part, tv, tu, scene))
        scene, tu, tv, part, iu, iv, range_m = (x[order] for x in (scene, tu, tv, part, iu, iv, range_m))
        ids = table.column("point_id").take(pa.array(order))
        changes = lambda *columns: np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)])
        first = changes(scene, tu, tv, part)
        u, v = iu - tu * side, iv - tv * side
        starts = np.flatnonzero(first | changes(iu, iv))
        apart = u + np.cumsum(first) * (side + 6 * radius)  # tiles lie beside each other, out of reach
        least = least_around(apart[starts], v[starts], np.fmin.reduceat(range_m, starts), radius)
        near = np.repeat(least, np.diff(np.append(starts, len(u))))
        out = np.asarray(ids.is_valid()) & (u >= 0) & (u < side) & (v >= 0) & (v < side) & ~(range_m <= near + tolerance)
        return pa.Table.from_arrays([ids.filter(pa.array(out)), pa.array(scene[out])], names=["point_id", "scene_code"])

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys, "part"), F.lit(4 * n)))
    return dealt.repartition(n, "bucket").groupBy("bucket").applyInArrow(run, "point_id long, scene_code long")
