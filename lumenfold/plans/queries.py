"""Every registered query of the view engine with its SQL twin.

A query gives `keys` (names, with a type where the engines differ) and `values` (doubles,
rounded to six places on both sides, off the places where halves lie, so that the order of
sums doesn't matter).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import mapgrid, scoring, solar, spectral
from ..functions.vectors import unit, vec
from ..operators import anchors, brf, candidates, export, fusion, gains, neighbours, ordinals, scenes, selection, sight, tiles
from ..sources import shared
from . import sqltext as T
from .adapters import ctes, view

_DUCK = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    keys: tuple[str, ...]
    values: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = [F.col(k.split(":")[0]).cast(k.split(":")[1]) if ":" in k else F.col(k) for k in self.keys]
        names = [k.split(":")[0] for k in self.keys]
        return self.run(spark, sf_dir).select(
            *[k.alias(n) for k, n in zip(keys, names)], *[(F.rint((F.col(v).cast("double") + 1e-9) * 1e6) / 1e6 + 0.0).alias(v) for v in self.values]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        with_, _, body = self.sql.partition(";;")
        keys = [f"CAST({k.split(':')[0]} AS {_DUCK[k.split(':')[1]]}) AS {k.split(':')[0]}" if ":" in k else k for k in self.keys]
        values = [f"round(CAST({v} AS DOUBLE) + 1e-9, 6) + 0.0::DOUBLE AS {v}" for v in self.values]
        return f"WITH {with_}\nSELECT {', '.join([*keys, *values])} FROM ({body})"


QUERIES: dict[str, Query] = {}


def query(name: str, keys: str, values: str, sql: str | None):
    """Registers the decorated function; sql is 'ctes ;; body'."""

    def add(run):
        QUERIES[name] = Query(tuple(keys.split()), tuple(values.split()), run, sql)
        return run

    return add


# scenes


def _image_names(spark, d):
    s = view(spark, d, "scenes")
    name = F.concat(F.lit("/data/run 1/"), "scene_id", F.when(F.col("scene_code") % 3 == 0, "_REF.hdr").when(F.col("scene_code") % 3 == 1, "_ref.HDR").otherwise(".hdr"))
    label = F.concat(F.lit(" a/b/"), "scene_id", F.when(F.col("scene_code") % 2 == 0, "_PAN.TIF").otherwise("_pan.tiff"))
    return s.select("scene_code", name.alias("name"), label.alias("label"))


_NAMES = f"""{ctes("scenes")}, n AS (SELECT scene_code, scene_id, '/data/run 1/' || scene_id || CASE scene_code % 3 WHEN 0 THEN '_REF.hdr' WHEN 1 THEN '_ref.HDR' ELSE '.hdr' END AS name,
 ' a/b/' || scene_id || CASE scene_code % 2 WHEN 0 THEN '_PAN.TIF' ELSE '_pan.tiff' END AS label FROM scenes)"""


@query("q_scene_keys", "scene_code by_name by_label header suffix:long", "", f"""{_NAMES} ;;
SELECT scene_code, regexp_replace(regexp_replace(regexp_replace(name, '^.*[/\\\\]', ''), '\\.[^.]*$', ''), '_ref$', '', 'i') AS by_name,
 regexp_replace(regexp_replace(regexp_replace(trim(label), '^.*/', ''), '\\.tiff?$', '', 'i'), '_pan$', '', 'i') AS by_label,
 replace(replace(replace(lower(trim(name || ' (x)')), ' ', ''), '(', ''), ')', '') AS header,
 coalesce(TRY_CAST(nullif(regexp_extract(scene_id, '(\\d+)$', 1), '') AS BIGINT), 1000000000) AS suffix FROM n""")
def _(spark, d):
    s = _image_names(spark, d).join(view(spark, d, "scenes").select("scene_code", "scene_id"), "scene_code")
    return s.select(
        "scene_code", spectral.scene_key_from_name(F.col("name")).alias("by_name"), spectral.scene_key_from_label(F.col("label")).alias("by_label"),
        spectral.header_text(F.concat("name", F.lit(" (x)"))).alias("header"), spectral.numeric_suffix(F.col("scene_id")).alias("suffix"),
    )


@query("q_match_status", "scene_id match_status time_source", "view_zenith", f"""{ctes("scenes")},
brdf AS (SELECT scene_id, min(scene_code % 60) AS view_zenith, CASE WHEN scene_code % 4 = 0 THEN ' ' ELSE 'T' || scene_code END AS t1 FROM scenes WHERE scene_code % 3 <> 0 GROUP BY ALL),
bref AS (SELECT scene_id, 'U' || scene_code AS t2 FROM scenes WHERE scene_code % 5 <> 0) ;;
SELECT s.scene_id, CASE WHEN b.scene_id IS NOT NULL AND r.scene_id IS NOT NULL THEN 'matched_brdf_bref' WHEN b.scene_id IS NOT NULL THEN 'matched_brdf_only'
 WHEN r.scene_id IS NOT NULL THEN 'matched_bref_only' ELSE 'missing_both' END AS match_status,
 CASE WHEN nullif(trim(t1), '') IS NOT NULL THEN 'brdf' WHEN nullif(trim(t2), '') IS NOT NULL THEN 'bref' ELSE 'missing' END AS time_source, view_zenith
FROM scenes s LEFT JOIN brdf b USING (scene_id) LEFT JOIN bref r USING (scene_id)""")
def _(spark, d):
    s = view(spark, d, "scenes").select("scene_id", "scene_code")
    brdf = s.where("scene_code % 3 <> 0").select(
        "scene_id", (F.col("scene_code") % 60).alias("view_zenith"), F.when(F.col("scene_code") % 4 == 0, " ").otherwise(F.concat(F.lit("T"), "scene_code")).alias("t1")
    )
    brdf = scenes.first_rows(brdf.union(brdf), "scene_id", "view_zenith")
    bref = s.where("scene_code % 5 <> 0").select("scene_id", F.concat(F.lit("U"), "scene_code").alias("t2"))
    return scenes.matched(s, brdf, bref).withColumn("time_source", solar.acquisition(F.col("t1"), F.col("t2"), "brdf", "bref")[1])


@query("q_match_counts", "match_status n:long", "", f"""{ctes("scenes")} ;;
SELECT CASE WHEN scene_code % 3 <> 0 AND scene_code % 5 <> 0 THEN 'matched_brdf_bref' WHEN scene_code % 3 <> 0 THEN 'matched_brdf_only' WHEN scene_code % 5 <> 0 THEN 'matched_bref_only'
 ELSE 'missing_both' END AS match_status, count(*) AS n FROM scenes GROUP BY 1""")
def _(spark, d):
    s = view(spark, d, "scenes").select("scene_id", "scene_code")
    m = scenes.matched(s, s.where("scene_code % 3 <> 0").select("scene_id"), s.where("scene_code % 5 <> 0").select("scene_id"))
    return m.groupBy("match_status").agg(F.count("*").alias("n"))


def _solar(spark, d):
    s = view(spark, d, "scenes").join(view(spark, d, "times"), "scene_code")
    out = s.withColumns(solar.position(F.unix_micros(F.col("acquisition_time").cast("timestamp")), F.col("cam_lat"), F.col("cam_lon")))
    sun = solar.sun_vector(F.col("solar_zenith_deg"), F.col("solar_azimuth_deg"))
    known, low = solar.flags(F.col("solar_zenith_deg"), F.col("solar_azimuth_deg"), F.col("solar_elevation_deg"))
    return out.withColumns({**{f"sun_{c}": v for c, v in zip("xyz", sun)}, "valid": known, "low": low})


@query("q_solar_position", "scene_code valid low", "solar_zenith_deg solar_elevation_deg solar_azimuth_deg sun_x sun_y sun_z", f"""{ctes("scenes", "times")}, p AS ({T.solar(
    "(SELECT s.*, t.acquisition_time FROM scenes s JOIN times t USING (scene_code))", "scene_code", "epoch_us(acquisition_time)", "cam_lat", "cam_lon")}) ;;
SELECT scene_code, true AS valid, elev < 5 AS low, zen AS solar_zenith_deg, elev AS solar_elevation_deg, azi AS solar_azimuth_deg,
 sin(radians(zen)) * sin(radians(azi)) AS sun_x, sin(radians(zen)) * cos(radians(azi)) AS sun_y, cos(radians(zen)) AS sun_z FROM p""")
def _(spark, d):
    return _solar(spark, d)


@query("q_time_parse", "user_id:long zone_us:long utc_us:long", "julian", f"""{ctes("times")} ;;
SELECT scene_code AS user_id, epoch_us(t) - 28800000000 AS zone_us, epoch_us(t) AS utc_us, epoch_us(t) / 86400e6 + 2440587.5::DOUBLE AS julian
FROM (SELECT scene_code, date_trunc('second', acquisition_time) AS t FROM times)""")
def _(spark, d):
    t = view(spark, d, "times").withColumn("text", F.date_format(F.col("acquisition_time"), "yyyy-MM-dd HH:mm:ss"))
    zone, utc = solar.parsed_time(F.col("text"), "Asia/Shanghai"), solar.parsed_time(F.concat("text", F.lit("Z")), "Asia/Shanghai")
    out = t.select(F.col("scene_code").alias("user_id"), F.unix_micros(zone).alias("zone_us"), F.unix_micros(utc).alias("utc_us"))
    return out.withColumn("julian", solar.julian_day(F.col("utc_us")))


_REPORT = f"""{ctes("scenes", "times")}, r AS (SELECT s.scene_id, s.scene_code, concat_ws(';', CASE WHEN s.scene_code = 7 THEN 'blurred' END,
 CASE WHEN s.scene_code % 6 = 0 OR s.scene_code % 10 = 0 THEN 'missing_hdr_or_data' END, CASE WHEN s.scene_code % 4 = 0 THEN 'missing_brdf_pose' END,
 CASE WHEN t.scene_code IS NULL THEN 'missing_solar_geometry' END) AS reject_reason FROM scenes s LEFT JOIN times t ON s.scene_code = t.scene_code)"""


def _report(spark, d):
    s = view(spark, d, "scenes")
    t = view(spark, d, "times").select("scene_code", F.lit(True).alias("has_solar"))
    s = scenes.suffixed_join(s, t.withColumn("scene_id", F.lit("x")), "scene_code", "_pose")
    s = s.withColumns(
        {"has_hdr": F.col("scene_code") % 6 != 0, "has_data": F.col("scene_code") % 10 != 0, "has_brdf": F.col("scene_code") % 4 != 0, "has_solar": F.coalesce("has_solar", F.lit(False))}
    )
    first = s.where("scene_code = 7").select("scene_id").first()
    return s, scenes.quality_report(s, {first[0]: "blurred"} if first else {})


@query("q_scene_quality_report", "scene_id reject_reason final_use", "", f"{_REPORT} ;; SELECT scene_id, reject_reason, reject_reason = '' AS final_use FROM r")
def _(spark, d):
    return _report(spark, d)[1]


@query("q_scenes_used", "scene_id", "cam_x cam_y cam_z", f"{_REPORT} ;; SELECT scene_id, cam_x, cam_y, cam_z FROM scenes WHERE scene_id IN (SELECT scene_id FROM r WHERE reject_reason = '')")
def _(spark, d):
    s, r = _report(spark, d)
    return scenes.used(s, r)


# directions, frames, projection

_ANGLES = f"""{ctes("scenes")}, a AS (SELECT *, radians(CAST(scene_code * 37 % 360 AS DOUBLE)) AS az, pi() - radians(CAST(20 + scene_code % 40 AS DOUBLE)) AS ze FROM scenes),
o AS (SELECT *, sin(ze) * sin(az) AS ox, sin(ze) * cos(az) AS oy, cos(ze) AS oz FROM a)"""


def _directions(spark, d):
    s = view(spark, d, "scenes").withColumns({"az": (F.col("scene_code") * 37 % 360).cast("double"), "ze": (20 + F.col("scene_code") % 40).cast("double")})
    return s.withColumns(dict(zip(("ox", "oy", "oz"), C.observation_direction(F.col("az"), F.col("ze")))))


@query("q_obs_direction", "scene_code", "ox oy oz fx ex", f"{_ANGLES} ;; SELECT scene_code, ox, oy, oz, -ox AS fx, sin(pi() - ze) * cos(az) AS ex FROM o")
def _(spark, d):
    s = _directions(spark, d)
    east = C.observation_direction(F.col("az"), F.col("ze"), "east_ccw", "from_zenith")
    return s.withColumn("fx", C.forward(vec("ox", "oy", "oz"), True)[0]).withColumn("ex", east[0])


@query("q_camera_frame", "scene_code", "r11 r12 r13 r21 r22 r23 r31 r32 r33", f"""{_ANGLES}, h AS (SELECT *, sqrt(ox * ox + oy * oy) AS n FROM o),
f AS (SELECT *, oy / n AS ax, -ox / n AS ay, 0::DOUBLE AS az_, oy * 0 - oz * (-ox / n) AS bx, oz * (oy / n) - 0 AS by_, ox * (-ox / n) - oy * (oy / n) AS bz, radians(CAST(scene_code % 7 - 3 AS DOUBLE)) AS r FROM h) ;;
SELECT scene_code, ax * cos(r) + bx * sin(r) AS r11, ay * cos(r) + by_ * sin(r) AS r12, bz * sin(r) AS r13, bx * cos(r) - ax * sin(r) AS r21, by_ * cos(r) - ay * sin(r) AS r22, bz * cos(r) AS r23,
 ox AS r31, oy AS r32, oz AS r33 FROM f""")
def _(spark, d):
    s = _directions(spark, d)
    return C.with_frame(s, vec("ox", "oy", "oz"), (F.col("scene_code") % 7 - 3).cast("double"))


def _cams(spark, d):
    s = view(spark, d, "scenes")
    return C.with_frame(s, vec(F.col("site_x") + 5.0 - F.col("cam_x"), 4.0 - F.col("cam_y"), 2.5 - F.col("cam_z")))


def _points(spark, d):
    p = view(spark, d, "points")
    p = p.withColumns(dict(zip(("nx", "ny", "nz"), unit(vec("nx_raw", "ny_raw", "nz_raw"), (0.0, 0.0, 0.0)))))
    return p.withColumn("surface_verticality", 1.0 - F.abs("nz"))


WINDOW = C.center_window(1886, 1886, 1024, 1024)


def _pairs(spark, d):
    return candidates.projected(_points(spark, d), _cams(spark, d))


_PROJECTED = f"{ctes('points', 'scenes')}, {T.CAMS}, {T.PNTS}, {T.PROJ}"


@query("q_project_points", "point_id scene_code", "u v range_m offaxis_deg border_px", f"{_PROJECTED} ;; SELECT * FROM proj")
def _(spark, d):
    return _pairs(spark, d)


def _suns(spark, d):
    return _solar(spark, d).select("scene_code", "solar_zenith_deg", F.col("solar_azimuth_deg").alias("sun_azimuth_deg"), "sun_x", "sun_y", "sun_z")


def _views(spark, d):
    return candidates.scored(_pairs(spark, d), WINDOW)


def _best(spark, d):
    return candidates.best(_views(spark, d), 8)


@query("q_scene_counters", "scene_code inside:long in_window:long eligible:long kept:long", "", f"""{T.CANDIDATES} ;;
SELECT v.scene_code, count(*) AS inside, count_if(v.center_distance >= 0) AS in_window, count(*) AS eligible, count(k.slot) AS kept
FROM views v LEFT JOIN topk k ON k.point_id = v.point_id AND k.scene_code = v.scene_code GROUP BY v.scene_code""")
def _(spark, d):
    return candidates.counters(_pairs(spark, d), _best(spark, d), WINDOW)


@query("q_view_geometry", "point_id scene_code is_backlit", "view_zenith_deg view_azimuth_deg local_view_angle_deg surface_view_cos local_solar_incidence_deg relative_azimuth_deg coarse_score",
       f"{T.CANDIDATES} ;; SELECT * FROM views")
def _(spark, d):
    return candidates.sunlit(_views(spark, d), _suns(spark, d))


@query("q_topk_candidates", "point_id scene_code slot:int", "coarse_score u v border_dist_px", f"{T.CANDIDATES} ;; SELECT * FROM topk")
def _(spark, d):
    return _best(spark, d)


@query("q_strict_window", "scene_code n:long", "score", f"{T.CANDIDATES} ;; SELECT scene_code, count(*) AS n, avg(coarse_score) AS score FROM views WHERE center_distance >= 0 GROUP BY scene_code")
def _(spark, d):
    v = candidates.scored(_pairs(spark, d), WINDOW, "strict")
    return v.groupBy("scene_code").agg(F.count("*").alias("n"), F.avg("coarse_score").alias("score"))


@query("q_center_window_distance", "point_id scene_code inside", "distance", f"{ctes('observations')} ;; SELECT point_id, scene_code, d >= 0 AS inside, d AS distance FROM (SELECT *, {T.window_distance('u', 'v')} AS d FROM observations)")
def _(spark, d):
    o = view(spark, d, "observations")
    return o.select("point_id", "scene_code", C.in_window(F.col("u"), F.col("v"), WINDOW).alias("inside"), C.window_distance(F.col("u"), F.col("v"), WINDOW).alias("distance"))


@query("q_view_residual", "scene_code", "az_residual zen_residual plane_x plane_y radius azimuth zenith", f"""{ctes("scenes")}, r AS (SELECT *, site_x + 5 - cam_x AS dx, 4 - cam_y AS dy, 2.5::DOUBLE - cam_z AS dz FROM scenes),
s AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM r) ;;
SELECT scene_code, abs({T.pm(T.pm("degrees(atan2(dx, dy))") + " - scene_code * 37 % 360 + 180")} - 180) AS az_residual, abs(180 - {T.degacos("dz / n")} - (20 + scene_code % 40)) AS zen_residual,
 cam_x + (1.5::DOUBLE - cam_z) / dz * dx AS plane_x, cam_y + (1.5::DOUBLE - cam_z) / dz * dy AS plane_y, n AS radius, {T.pm("degrees(atan2(-dx, -dy))")} AS azimuth, {T.degacos("-dz / n")} AS zenith FROM s""")
def _(spark, d):
    s = view(spark, d, "scenes")
    cam, target = vec("cam_x", "cam_y", "cam_z"), vec(F.col("site_x") + 5.0, 4.0, 2.5)
    az, ze = C.view_residual(cam, target, (F.col("scene_code") * 37 % 360).cast("double"), (20 + F.col("scene_code") % 40).cast("double"))
    plane = C.ray_plane(cam, tuple(t - c for t, c in zip(target, cam)), F.lit(1.5))
    r, a, z = C.spherical(cam, target)
    return s.select("scene_code", az.alias("az_residual"), ze.alias("zen_residual"), plane[0].alias("plane_x"), plane[1].alias("plane_y"), r.alias("radius"), a.alias("azimuth"), z.alias("zenith"))


@query("q_image_plane", "scene_code corner:int", "x y z", f"""{ctes("scenes")}, {T.CAMS}, k AS (SELECT 20 * tan(radians(17.5::DOUBLE)) AS h) ;;
SELECT scene_code, corner, cam_x + 20 * r31 + h * (sx * r11 + sy * r21) AS x, cam_y + 20 * r32 + h * (sx * r12 + sy * r22) AS y, cam_z + 20 * r33 + h * (sx * r13 + sy * r23) AS z
FROM cams, k, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) t(corner, sx, sy)""")
def _(spark, d):
    s = _cams(spark, d)
    rows = tuple(vec(*[f"r{i}{j}" for j in (1, 2, 3)]) for i in (1, 2, 3))
    corners = C.image_plane(vec("cam_x", "cam_y", "cam_z"), rows, F.lit(20.0))
    made = F.array(*[F.struct(F.lit(i).alias("corner"), *[c.alias(n) for n, c in zip("xyz", p)]) for i, p in enumerate(corners)])
    return s.select("scene_code", F.explode(made).alias("c")).select("scene_code", "c.*")


# neighbourhoods and selection


@query("q_neighbours", "point_id n:long", "d2", f"{ctes('points')}, {T.NEAR} ;; SELECT point_id, count(*) AS n, sum(d2) AS d2 FROM pairs WHERE point_id <> other_id GROUP BY point_id")
def _(spark, d):
    return neighbours.pairs(view(spark, d, "points"), 1.2).groupBy("point_id").agg(F.count("*").alias("n"), F.sum("d2").alias("d2"))


@query("q_bounded_knn", "point_id other_id nth:int", "d2", f"{ctes('points')}, {T.NEAR} ;; SELECT point_id, other_id, nth, d2 FROM near WHERE nth <= 16")
def _(spark, d):
    return neighbours.nearest(view(spark, d, "points"), 1.2, 16)


_OCCLUDED = f"""{T.CANDIDATES}, {T.NEAR},
o0 AS (SELECT k.point_id, k.scene_code, n.d2, n.dx * dir_x + n.dy * dir_y + n.dz * dir_z AS t FROM topk k LEFT JOIN near n ON n.point_id = k.point_id),
o1 AS (SELECT *, coalesce(t > 0.08::DOUBLE AND d2 > 0, false) AS front FROM o0),
o2 AS (SELECT point_id, scene_code, count(d2) AS n, count_if(front AND greatest(d2 - t * t, 0) <= 0.08::DOUBLE * 0.08::DOUBLE) AS blockers, count_if(front) AS fronts, max(CASE WHEN front THEN t / sqrt(d2) END) AS c FROM o1 GROUP BY ALL),
occ AS (SELECT point_id, scene_code, CASE WHEN n >= 2 THEN blockers ELSE 0 END AS blocker_count, CASE WHEN n >= 2 THEN fronts ELSE 0 END AS front_count,
 CASE WHEN n >= 2 AND c IS NOT NULL THEN {T.degacos("c")} ELSE 180 END AS local_empty_cone_deg FROM o2)"""


_DIRECTIONS = ("point_id", "scene_code", "dir_x", "dir_y", "dir_z")


def _occlusion(spark, d, best):
    return neighbours.occlusion(best.select(*_DIRECTIONS), view(spark, d, "points"))


@query("q_occlusion", "point_id scene_code blocker_count:long front_count:long tube_clear cone_clear", "local_empty_cone_deg", f"""{_OCCLUDED} ;;
SELECT *, blocker_count = 0 AS tube_clear, NOT (front_count > 0 AND local_empty_cone_deg < 4) AS cone_clear FROM occ""")
def _(spark, d):
    return _occlusion(spark, d, _best(spark, d))


_DEPTH = """px AS (SELECT *, CAST(round_even(u, 0) AS BIGINT) AS iu, CAST(round_even(v, 0) AS BIGINT) AS iv FROM {source}),
zb AS (SELECT scene_code, iu, iv, min(range_m) AS r FROM px GROUP BY ALL),
zn AS (SELECT scene_code, iu + a AS iu, iv + b AS iv, min(r) AS near_m FROM zb, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) GROUP BY ALL),
depth AS (SELECT px.*, near_m, range_m <= near_m + 0.8::DOUBLE AS zbuffer_clear FROM px JOIN zn USING (scene_code, iu, iv))"""


@query("q_zbuffer_clear", "point_id scene_code zbuffer_clear", "near_m", f"{ctes('observations')}, {_DEPTH.format(source='observations')} ;; SELECT * FROM depth")
def _(spark, d):
    return selection.depth_clear(view(spark, d, "observations"))


@query("q_visible_views", "point_id scene_code is_clear reason blocker_count:long", "local_empty_cone_deg visibility_score view_weight_raw", f"""{_OCCLUDED}, {_DEPTH.format(source='topk')},
j AS (SELECT t.point_id, t.scene_code, t.coarse_score, t.offaxis_deg, t.range_m, t.border_dist_px, t.view_zenith_deg, t.surface_view_cos, t.surface_verticality, t.normal_confidence, zbuffer_clear,
 blocker_count = 0 AS tube, NOT (front_count > 0 AND local_empty_cone_deg < 4) AS cone, blocker_count + CASE WHEN zbuffer_clear THEN 0 ELSE 1 END AS blocker_count,
 CASE WHEN zbuffer_clear THEN local_empty_cone_deg ELSE least(local_empty_cone_deg, 0) END AS local_empty_cone_deg FROM depth t JOIN occ o ON o.point_id = t.point_id AND o.scene_code = t.scene_code),
c AS (SELECT *, tube AND cone AND zbuffer_clear AS is_clear FROM j) ;;
SELECT point_id, scene_code, is_clear, CASE WHEN is_clear THEN 'none' ELSE concat_ws('+', CASE WHEN NOT tube THEN 'tube_blocker' END, CASE WHEN NOT cone THEN 'narrow_empty_cone' END, CASE WHEN NOT zbuffer_clear THEN 'image_zbuffer' END) END AS reason,
 blocker_count, local_empty_cone_deg, {T.SELECTION_SCORE} AS visibility_score, {T.RAW_WEIGHT} AS view_weight_raw FROM c""")
def _(spark, d):
    points, seen, short = _shortlist(spark, d)
    return _judged(_reviewed(points, seen, short))


#: What the occlusion and the depth buffer read of a view.
_LISTED = ("scene_code", "dir_x", "dir_y", "dir_z", "u", "v", "range_m")


def _shortlist(spark, d):
    """The points, the scenes that can see into their cells, and the points with the list of their best views, written.  Ids of points are unique."""
    points = _points(spark, d)
    cams = _cams(spark, d).select("scene_code", "scene_id", "cam_x", "cam_y", "cam_z", *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)])
    seen = sight.seen_cells(points, cams.join(_suns(spark, d), "scene_code", "left"), 300.0)
    best = candidates.best(candidates.scored(candidates.in_view(sight.met(points, seen)), WINDOW), 8, sight.CELL)
    pixels = {c: F.rint(c) for c in "uv"}  # all that the depth buffer reads of them
    return points, seen, shared.written(candidates.listed(best.withColumns(pixels), *_LISTED))


def _reviewed(points, seen, short, *known):
    """The best views of each point with their geometry, sun, occlusion and depth, dealt by the points' cells; and what is `known` by point_id.

    A view's geometry takes some thirty numbers, all of which follow from its point and its scene.  So only lists of a point's views travel, with
    what the occlusion and the depth buffer read and find, and the geometry of the best views is made again where the lists meet the scenes once more.
    """
    hidden = tiles.hidden(short.select("point_id", F.inline("views"))).groupBy("point_id").agg(F.collect_set("scene_code").alias("hidden"))
    met = tiles.listed_blockers(short, points).withColumn("codes", F.col("met.scene_code"))
    found = points.join(met, "point_id").join(hidden, "point_id", "left")
    for table in known:
        found = found.join(table, "point_id")
    at = F.array_position("codes", F.col("scene_code"))
    views = sight.met(found, seen).where(at > 0).withColumn("found", F.element_at("met", at.cast("int")))
    views = views.withColumns({c: F.col(f"found.{c}") for c in ("n", "blockers", "fronts", "c")})
    views = views.withColumn("zbuffer_clear", ~F.coalesce(F.array_contains("hidden", F.col("scene_code")), F.lit(False)))
    views = candidates.scored(candidates.imaged(views.drop("codes", "met", "found", "hidden")), WINDOW)
    return neighbours.judged(candidates.lit(views))


def _judged(views):
    """What the selection finds of each view."""
    v = selection.with_depth(views)
    v = v.withColumn("is_clear", F.col("tube_clear") & F.col("cone_clear") & F.col("zbuffer_clear"))
    c = F.col
    score = scoring.selection(c("coarse_score"), c("local_empty_cone_deg"), c("blocker_count"), c("offaxis_deg"), c("range_m"), c("view_zenith_deg"), c("surface_view_cos"), c("surface_verticality"), c("normal_confidence"))
    raw = scoring.raw_weight(c("coarse_score"), c("local_empty_cone_deg"), c("blocker_count"), c("offaxis_deg"), c("range_m"), c("border_dist_px"), c("is_clear"), c("view_zenith_deg"), c("surface_view_cos"), c("surface_verticality"), c("normal_confidence"))
    reason = scoring.rejected_because(tube_blocker=~c("tube_clear"), narrow_empty_cone=~c("cone_clear"), image_zbuffer=~c("zbuffer_clear"))
    return v.withColumn("reason", reason).withColumn("visibility_score", score).withColumn("view_weight_raw", raw)


@query("q_selection_score", "point_id scene_code", "score weight", f"{ctes('observations')} ;; SELECT point_id, scene_code, {T.SELECTION_SCORE} AS score, {T.RAW_WEIGHT} AS weight FROM observations")
def _(spark, d):
    c = F.col
    score = scoring.selection(c("coarse_score"), c("local_empty_cone_deg"), c("blocker_count"), c("offaxis_deg"), c("range_m"), c("view_zenith_deg"), c("surface_view_cos"), c("surface_verticality"), c("normal_confidence"))
    raw = scoring.raw_weight(c("coarse_score"), c("local_empty_cone_deg"), c("blocker_count"), c("offaxis_deg"), c("range_m"), c("border_dist_px"), c("is_clear"), c("view_zenith_deg"), c("surface_view_cos"), c("surface_verticality"), c("normal_confidence"))
    return view(spark, d, "observations").select("point_id", "scene_code", score.alias("score"), raw.alias("weight"))


_RANKED = f"""{ctes('observations')}, rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY -visibility_score, -view_weight_raw, -surface_view_cos, -(view_zenith_deg * surface_verticality), -local_empty_cone_deg,
 offaxis_deg, -border_dist_px, range_m, scene_code) AS fusion_rank, bool_or(is_clear) OVER (PARTITION BY point_id) AS any_clear FROM observations)"""


@query("q_rank_views", "point_id scene_code fusion_rank:int", "", f"{_RANKED} ;; SELECT * FROM rk")
def _(spark, d):
    return selection.ranked(view(spark, d, "observations"))


@query("q_keep_or_fallback", "point_id scene_code method keep", "weight", f"""{_RANKED} ;;
SELECT point_id, scene_code, CASE WHEN is_clear THEN 'clear_keep' WHEN any_clear THEN 'unclear_keep' ELSE 'fallback_keep' END AS method, is_clear OR NOT any_clear AS keep,
 CASE WHEN any_clear THEN view_weight_raw ELSE view_weight_raw * 0.05::DOUBLE END AS weight FROM rk WHERE fusion_rank <= CASE WHEN any_clear THEN 12 ELSE 4 END""")
def _(spark, d):
    k = selection.kept(selection.ranked(view(spark, d, "observations").drop("selection_method", "keep_for_fusion")), 12, 4)
    return k.select("point_id", "scene_code", F.col("selection_method").alias("method"), F.col("keep_for_fusion").alias("keep"), F.col("view_weight_raw").alias("weight"))


@query("q_keep_clear_only", "point_id scene_code fusion_rank:int", "", f"""{_RANKED}, c AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY fusion_rank) AS r FROM rk WHERE is_clear OR NOT any_clear) ;;
SELECT point_id, scene_code, r AS fusion_rank FROM c WHERE r <= CASE WHEN any_clear THEN 6 ELSE 2 END""")
def _(spark, d):
    return selection.kept(selection.ranked(view(spark, d, "observations").drop("selection_method", "keep_for_fusion")), 6, 2, keep_unclear=False)


@query("q_selection_scene_summary", "scene_code views:long points:long clear:long", " ".join(f"mean_{m}" for m in selection.MEANS), f"""{ctes('observations')} ;;
SELECT scene_code, count(*) AS views, count(DISTINCT point_id) AS points, count_if(is_clear) AS clear, {', '.join(f'avg({m}) AS mean_{m}' for m in selection.MEANS)} FROM observations WHERE keep_for_fusion GROUP BY scene_code""")
def _(spark, d):
    return selection.scene_summary(view(spark, d, "observations"))


# fusion

_B = ("b1", "b2", "b3", "b4", "b5")


def _weighted(spark, d, mode):
    return fusion.weighted(view(spark, d, "spectra").where("keep_for_fusion"), mode)


def _fusion(mode):
    body = ", ".join(f"{T.mean(c)} AS {c}" for c in _B) + ", " + ", ".join(f"{T.mean(c)} AS mean_{c}" for c in fusion.AVERAGED)

    @query(f"q_fused_{mode}", "point_id views:long", " ".join(["clear_ratio", *_B, *[f"mean_{c}" for c in fusion.AVERAGED]]),
           f"{T.weighted(mode)} ;; SELECT point_id, count(*) AS views, {T.mean('CAST(is_clear AS DOUBLE)')} AS clear_ratio, {body} FROM wt GROUP BY point_id")
    def _(spark, d):
        return fusion.fused(_weighted(spark, d, mode), list(_B))


for _mode in scoring.MODES:
    _fusion(_mode)


@query("q_weight_entropy", "point_id", "entropy effective_views", f"""{T.weighted('surface_adaptive')}, e AS (SELECT point_id, -sum(w * ln(greatest(w, 1e-12))) AS entropy FROM wt GROUP BY point_id) ;;
SELECT point_id, entropy, exp(entropy) AS effective_views FROM e""")
def _(spark, d):
    return fusion.fused(_weighted(spark, d, "surface_adaptive"), list(_B))


@query("q_primary_view", "point_id primary_scene:long", "primary_weight", f"""{T.weighted('raw')}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY w DESC, scene_code) AS n FROM wt) ;;
SELECT point_id, scene_code AS primary_scene, w AS primary_weight FROM r WHERE n = 1""")
def _(spark, d):
    return fusion.fused(_weighted(spark, d, "raw"), list(_B))


@query("q_primary_metrics", "point_id", " ".join(["primary_ratio", "ndvi_81_128", *[f"primary_{c}" for c in fusion.PRIMARY]]), f"""{T.weighted('hybrid')}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY w DESC, scene_code) AS n, sum(w) OVER (PARTITION BY point_id) AS sw, {T.mean('b2').replace('sum(w * b2)', 'sum(w * b2) OVER (PARTITION BY point_id)').replace('/ sum(w)', '/ sum(w) OVER (PARTITION BY point_id)')} AS red,
 {T.mean('b5').replace('sum(w * b5)', 'sum(w * b5) OVER (PARTITION BY point_id)').replace('/ sum(w)', '/ sum(w) OVER (PARTITION BY point_id)')} AS nir FROM wt) ;;
SELECT point_id, w / sw AS primary_ratio, (nir - red) / (nir + red) AS ndvi_81_128, {', '.join(f'{c} AS primary_{c}' for c in fusion.PRIMARY)} FROM r WHERE n = 1""")
def _(spark, d):
    return fusion.fused(_weighted(spark, d, "hybrid"), list(_B), {81: "b2", 128: "b5"})


@query("q_scene_fusion_summary", "scene_code views:long points:long outside:long", "weight_sum", f"""{T.weighted('hybrid')} ;;
SELECT scene_code, count(*) AS views, count(DISTINCT point_id) AS points, count_if(NOT (u BETWEEN 431 AND 1454 AND v BETWEEN 431 AND 1454)) AS outside, sum(w) AS weight_sum FROM wt GROUP BY scene_code""")
def _(spark, d):
    return fusion.scene_summary(_weighted(spark, d, "hybrid"), ~C.in_window(F.col("u"), F.col("v"), WINDOW))


@query("q_product_quality_summary", "metric", "value", f"""{T.weighted('surface_adaptive')}, f AS (SELECT point_id, {T.mean('b2')} AS b2, {T.mean('range_m')} AS mean_range_m, -sum(w * ln(greatest(w, 1e-12))) AS entropy FROM wt GROUP BY point_id) ;;
SELECT 'points' AS metric, CAST(count(*) AS DOUBLE) AS value FROM f UNION ALL SELECT 'b2', avg(b2) FROM f UNION ALL SELECT 'mean_range_m', avg(mean_range_m) FROM f UNION ALL SELECT 'entropy', avg(entropy) FROM f""")
def _(spark, d):
    return export.quality_table(fusion.fused(_weighted(spark, d, "surface_adaptive"), list(_B)), ["b2", "mean_range_m", "entropy"])


@query("q_ndvi_81_128", "point_id", "ndvi", f"{T.weighted('surface_adaptive')}, f AS (SELECT point_id, {T.mean('b2')} AS r, {T.mean('b5')} AS n FROM wt GROUP BY point_id) ;; SELECT point_id, (n - r) / nullif(n + r, 0) AS ndvi FROM f")
def _(spark, d):
    f = fusion.fused(_weighted(spark, d, "surface_adaptive"), list(_B))
    return f.select("point_id", spectral.ndvi(F.col("b2"), F.col("b5")).alias("ndvi"))


# directional observations


@query("q_brf_observations", "observation_id:long point_id scene_code", "view_weight_raw", f"{_RANKED} ;; SELECT row_number() OVER (ORDER BY point_id, fusion_rank, scene_code) - 1 AS observation_id, point_id, scene_code, view_weight_raw FROM rk")
def _(spark, d):
    return brf.paper_columns(ordinals.numbered(selection.ranked(view(spark, d, "observations")), "point_id", "fusion_rank", "scene_code"))


_TABLE = f"""{_OCCLUDED}, {_DEPTH.format(source='topk')},
j AS (SELECT t.*, front_count, blocker_count = 0 AS tube, NOT (front_count > 0 AND o.local_empty_cone_deg < 4) AS cone, blocker_count + CASE WHEN zbuffer_clear THEN 0 ELSE 1 END AS blocker_count,
 CASE WHEN zbuffer_clear THEN o.local_empty_cone_deg ELSE least(o.local_empty_cone_deg, 0) END AS local_empty_cone_deg FROM depth t JOIN occ o ON o.point_id = t.point_id AND o.scene_code = t.scene_code),
c AS (SELECT *, tube AND cone AND zbuffer_clear AS is_clear FROM j), sc AS (SELECT *, {T.SELECTION_SCORE} AS visibility_score, {T.RAW_WEIGHT} AS view_weight_raw FROM c),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY -visibility_score, -view_weight_raw, -surface_view_cos, -(view_zenith_deg * surface_verticality), -local_empty_cone_deg, offaxis_deg, -border_dist_px, range_m, scene_code) AS fusion_rank,
 bool_or(is_clear) OVER (PARTITION BY point_id) AS any_clear FROM sc),
kp AS (SELECT * REPLACE (CASE WHEN any_clear THEN view_weight_raw ELSE view_weight_raw * 0.05::DOUBLE END AS view_weight_raw), CASE WHEN is_clear THEN 'clear_keep' WHEN any_clear THEN 'unclear_keep' ELSE 'fallback_keep' END AS selection_method FROM rk),
tb AS (SELECT *, {T.quality_level()} AS brf_quality_level, row_number() OVER (ORDER BY point_id, fusion_rank) - 1 AS observation_id FROM kp)"""


@query("q_brf_table", "observation_id:long point_id scene_id scene_code is_backlit blocker_count:long image_zbuffer_clear is_clear selection_method fusion_rank_within_point:int brf_quality_level",
       "x y z normal_x normal_y normal_z u v range_m offaxis_deg border_dist_px view_zenith_deg view_azimuth_deg solar_zenith_deg solar_azimuth_deg relative_azimuth_deg local_view_angle_deg local_solar_incidence_deg"
       " surface_view_cos surface_verticality normal_confidence local_empty_cone_deg view_weight_raw",
       f"{_TABLE} ;; SELECT *, nx AS normal_x, ny AS normal_y, nz AS normal_z, zbuffer_clear AS image_zbuffer_clear, fusion_rank AS fusion_rank_within_point FROM tb")
def _(spark, d):
    """The whole chain: candidates, occlusion, depth buffer, selection, ranks, quality; all 34 columns of the table."""
    points, seen, short = _shortlist(spark, d)
    starts = ordinals.starts(short.select("point_id", F.size("views").alias("n")), "point_id", "n")
    views = selection.ranked(_judged(_reviewed(points, seen, short, starts)), within=sight.CELL)
    # all of a point's eight views at most are kept, so its rows are as many as its list
    table = selection.kept(views, within=sight.CELL).withColumn("observation_id", F.col("start") + F.col("fusion_rank") - 1)
    return brf.paper_columns(brf.with_quality(table), whole=True)


@query("q_quality_levels", "point_id scene_code brf_quality_level", "", f"{ctes('observations')} ;; SELECT *, {T.quality_level()} AS brf_quality_level FROM observations")
def _(spark, d):
    return brf.with_quality(view(spark, d, "observations"))


@query("q_quality_summary", "brf_quality_level n:long", "", f"{ctes('observations')} ;; SELECT {T.quality_level()} AS brf_quality_level, count(*) AS n FROM observations GROUP BY 1")
def _(spark, d):
    return brf.level_counts(brf.with_quality(view(spark, d, "observations")))


_SUMMARY = f"""{ctes('spectra')}, q AS (SELECT *, {T.quality_level()} AS lv FROM spectra),
s AS (SELECT point_id, count(*) AS n, count_if(is_clear) AS n_clear, count_if(lv = 'high') AS n_high, count_if(lv = 'medium') AS n_medium, count_if(lv = 'low') AS n_low, max(view_weight_raw) / sum(view_weight_raw) AS primary_ratio,
 sum(view_weight_raw) * sum(view_weight_raw) / sum(view_weight_raw * view_weight_raw) AS effective_views, avg(view_zenith_deg) AS view_mean, max(view_zenith_deg) - min(view_zenith_deg) AS view_range,
 max(relative_azimuth_deg) - min(relative_azimuth_deg) AS relaz_range, max(local_solar_incidence_deg) - min(local_solar_incidence_deg) AS incidence_range, avg(b2) AS b2_mean,
 sqrt(greatest(avg(b2 * b2) - avg(b2) * avg(b2), 0)) AS b2_std, max(b2) - min(b2) AS b2_range FROM q GROUP BY point_id)"""


@query("q_point_brf_summary", "point_id n:long n_clear:long n_high:long n_medium:long n_low:long point_quality",
       "primary_ratio effective_views view_mean view_range relaz_range incidence_range b2_mean b2_std b2_range",
       f"{_SUMMARY} ;; SELECT *, CASE WHEN n_clear >= 5 AND view_range >= 20 AND primary_ratio <= 0.85 THEN 'high' WHEN n_clear >= 3 THEN 'medium' ELSE 'low' END AS point_quality FROM s")
def _(spark, d):
    return brf.point_summary(brf.with_quality(view(spark, d, "spectra")), ["b2"])


@query("q_angular_bins", "angle variable bin:int n:long", "bin_left bin_right mean std sem ci95", f"""{ctes('spectra')},
l AS (SELECT 'view_zenith_deg' AS angle, view_zenith_deg AS ang, 90 AS most, b2, b4 FROM spectra UNION ALL SELECT 'relative_azimuth_deg', relative_azimuth_deg, 180, b2, b4 FROM spectra),
v AS (SELECT angle, ang, most, 'b2' AS variable, b2 AS x FROM l UNION ALL SELECT angle, ang, most, 'b4', b4 FROM l),
g AS (SELECT angle, variable, CAST(floor(least(ang, most - 1e-9) / 5) AS INT) AS bin, count(*) AS n, avg(x) AS m, avg(x * x) AS q FROM v WHERE ang >= 0 AND ang <= most GROUP BY ALL),
k AS (SELECT 'view_zenith_deg' AS angle, unnest(range(18)) AS bin UNION ALL SELECT 'relative_azimuth_deg', unnest(range(36))), f AS (SELECT k.angle, x.variable, k.bin FROM k, (VALUES ('b2'), ('b4')) x(variable)) ;;
SELECT f.angle, f.variable, f.bin, coalesce(n, 0) AS n, f.bin * 5 AS bin_left, f.bin * 5 + 5 AS bin_right, m AS mean, sqrt(greatest(q - m * m, 0)) AS std, sqrt(greatest(q - m * m, 0)) / sqrt(n) AS sem, 1.96::DOUBLE * sqrt(greatest(q - m * m, 0)) / sqrt(n) AS ci95
FROM f LEFT JOIN g ON g.angle = f.angle AND g.variable = f.variable AND g.bin = f.bin""")
def _(spark, d):
    return brf.angular_bins(view(spark, d, "spectra"), {"view_zenith_deg": 90.0, "relative_azimuth_deg": 180.0}, ["b2", "b4"])


# bands


@query("q_band_unpivot", "vec_id band:int name", "value", "e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) ;; SELECT vec_id, i + 104 AS band, CASE i + 104 WHEN 165 THEN 'NDVI' WHEN 166 THEN 'RVI' WHEN 167 THEN 'MSAVI' WHEN 168 THEN 'NDWI' ELSE 'band_' || CAST(i + 104 AS VARCHAR) END AS name, CASE WHEN i + 104 IN (165, 167, 168) THEN CAST(x AS DOUBLE) - 1 ELSE CAST(x AS DOUBLE) END AS value FROM e")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    e = e.select("vec_id", (F.col("i") + 105).alias("band"), F.col("x").cast("double").alias("x"))
    return e.select("vec_id", "band", spectral.band_name(F.col("band")).alias("name"), spectral.corrected(F.col("x"), F.col("band")).alias("value"))


@query("q_band_metadata", "band:int name index_band nearest:int", "", "b AS (SELECT DISTINCT CAST(1 + vec_id % 168 AS INT) AS band FROM embeddings) ;; SELECT band, CASE band WHEN 165 THEN 'NDVI' WHEN 166 THEN 'RVI' WHEN 167 THEN 'MSAVI' WHEN 168 THEN 'NDWI' ELSE 'band_' || CAST(band AS VARCHAR) END AS name, band >= 165 AS index_band, CASE WHEN (400 + 3 * band) BETWEEN 667 AND 673 THEN 90 ELSE 0 END AS nearest FROM b")
def _(spark, d):
    b = spark.read.parquet(f"{d}/embeddings.parquet").select((1 + F.col("vec_id") % 168).cast("int").alias("band")).distinct()
    near = spectral.nearest_band([400.0 + 3 * i for i in range(1, 169)], 670.0, 81)
    return b.select("band", spectral.band_name(F.col("band")).alias("name"), (F.col("band") >= 165).alias("index_band"),
                    F.when(F.abs(400 + 3 * F.col("band") - 670) <= 3, near).otherwise(0).alias("nearest"))


@query("q_vegetation_indices", "point_id scene_code", "ndvi rvi msavi ndwi", f"""{ctes('spectra')} ;; SELECT point_id, scene_code, (b5 - b2) / (b5 + b2) AS ndvi, b4 / b3 AS rvi,
 (2 * b4 + 1 - sqrt(greatest((2 * b4 + 1) * (2 * b4 + 1) - 8 * (b4 - b3), 0))) / 2 AS msavi, (b1 - b5) / (b1 + b5) AS ndwi FROM spectra""")
def _(spark, d):
    return view(spark, d, "spectra").withColumns(spectral.indices(*[F.col(b) for b in _B]))


@query("q_rgb", "point_id scene_code b4_u8:int b2_u8:int b1_u8:int", "", f"""{ctes('spectra')}, q AS (SELECT {', '.join(f'quantile_cont({b}, 0.0005) AS {b}_lo, quantile_cont({b}, 0.9995) AS {b}_hi' for b in ('b4', 'b2', 'b1'))} FROM spectra) ;;
SELECT point_id, scene_code, {', '.join(f'round_even(least(greatest(({b} - {b}_lo) / ({b}_hi - {b}_lo), 0), 1) * 255, 0) AS {b}_u8' for b in ('b4', 'b2', 'b1'))} FROM spectra, q""")
def _(spark, d):
    return export.stretched(view(spark, d, "spectra"), ["b4", "b2", "b1"])


# gains and quality-weighted fusion

_FIT = f"""{ctes('spectra')}, q AS (SELECT *, {T.quality_level()} AS lv FROM spectra WHERE is_clear),
lg AS (SELECT point_id, scene_code, view_weight_raw AS w, 1 AS band, b2 AS x FROM q WHERE lv IN ('high', 'medium') UNION ALL SELECT point_id, scene_code, view_weight_raw, 2, b4 FROM q WHERE lv IN ('high', 'medium')),
f0 AS (SELECT *, ln(x) AS y, count(*) OVER (PARTITION BY band, point_id) AS k FROM lg WHERE x > 1e-6 AND x < 2),
lim AS (SELECT band, quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM f0 WHERE k >= 2 GROUP BY band HAVING count(*) >= 50),
fit AS (SELECT f0.* FROM f0 JOIN lim USING (band) WHERE k >= 2 AND y BETWEEN lo AND hi),
ok0 AS (SELECT band, scene_code, count(*) >= 3 AS v FROM fit GROUP BY ALL), ok AS (SELECT band, scene_code, v AND count_if(v) OVER (PARTITION BY band) >= 2 AS v FROM ok0),
e0 AS (SELECT band, scene_code, 0::DOUBLE AS e FROM ok)"""


def _step(i: int) -> str:
    return f"""p{i} AS (SELECT f.*, sum((y - e) * w) OVER (PARTITION BY f.band, point_id) / sum(w) OVER (PARTITION BY f.band, point_id) AS pe FROM fit f JOIN e{i - 1} USING (band, scene_code)),
s{i} AS (SELECT p.band, p.scene_code, any_value(v) AS v, sum((y - pe) * w) / sum(w) AS r, sum(w) AS sw FROM p{i} p JOIN ok USING (band, scene_code) GROUP BY p.band, p.scene_code),
e{i} AS (SELECT band, scene_code, CASE WHEN v THEN r - coalesce(sum(CASE WHEN v THEN r * sw END) OVER (PARTITION BY band) / nullif(sum(CASE WHEN v THEN sw END) OVER (PARTITION BY band), 0), 0) ELSE 0 END AS e FROM s{i})"""


def _gain_sql(n: int) -> str:
    return f"""{_FIT}, {', '.join(_step(i) for i in range(1, n + 1))}, gains AS (SELECT band, scene_code, least(greatest(CASE WHEN v THEN exp(-e) ELSE 1 END, 0.5::DOUBLE), 2) AS gain FROM e{n} JOIN ok USING (band, scene_code))"""


def _fit_rows(spark, d):
    o = brf.with_quality(view(spark, d, "spectra")).where(F.col("is_clear") & F.col("brf_quality_level").isin("high", "medium"))
    long = gains.unpivoted(o, ["b2", "b4"], ["point_id", "scene_code", F.col("view_weight_raw").alias("w")])
    return gains.fit_rows(long, min_rows=50)


def _gains(spark, d, n):
    return gains.fitted(_fit_rows(spark, d), iterations=n, tolerance=0.0 if n < 20 else 1e-5, min_scene_rows=3)


for _n in (1, 3):

    @query(f"q_scene_gain_iter{_n}", "band:int scene_code", "gain", f"{_gain_sql(_n)} ;; SELECT * FROM gains")
    def _(spark, d, n=_n):
        return _gains(spark, d, n)


def _until(i: int) -> str:
    """A step for the bands that moved by more than 1e-5 in the step before; the others stay."""
    still = f"(SELECT band FROM e{i - 1} GROUP BY band HAVING max(moved) > 1e-5)"
    return f"""p{i} AS MATERIALIZED (SELECT f.*, e, sum((y - e) * w) OVER (PARTITION BY f.band, point_id) / sum(w) OVER (PARTITION BY f.band, point_id) AS pe FROM fit f JOIN e{i - 1} USING (band, scene_code) WHERE f.band IN {still}),
s{i} AS MATERIALIZED (SELECT p.band, p.scene_code, any_value(v) AS v, any_value(e) AS old, sum((y - pe) * w) / sum(w) AS r, sum(w) AS sw FROM p{i} p JOIN ok USING (band, scene_code) GROUP BY p.band, p.scene_code),
n{i} AS MATERIALIZED (SELECT band, scene_code, old, CASE WHEN v THEN r - coalesce(sum(CASE WHEN v THEN r * sw END) OVER (PARTITION BY band) / nullif(sum(CASE WHEN v THEN sw END) OVER (PARTITION BY band), 0), 0) ELSE 0 END AS e FROM s{i}),
e{i} AS MATERIALIZED (SELECT band, scene_code, e, abs(e - old) AS moved FROM n{i} UNION ALL SELECT band, scene_code, e, 0 AS moved FROM e{i - 1} WHERE band NOT IN {still})"""


_CONVERGED = f"""{_FIT.replace('0::DOUBLE AS e FROM ok)', '0::DOUBLE AS e, 1::DOUBLE AS moved FROM ok)').replace('fit AS (', 'fit AS MATERIALIZED (')}, {', '.join(map(_until, range(1, 21)))},
gains AS (SELECT band, scene_code, least(greatest(CASE WHEN v THEN exp(-e) ELSE 1 END, 0.5::DOUBLE), 2) AS gain FROM e20 JOIN ok USING (band, scene_code))"""


@query("q_scene_gain_converged", "band:int scene_code", "gain", f"{_CONVERGED} ;; SELECT * FROM gains")
def _(spark, d):
    return _gains(spark, d, 20)


@query("q_apply_gain", "point_id scene_code band:int", "value", f"""{_gain_sql(1)}, a AS (SELECT point_id, scene_code, 1 AS band, b2 AS x FROM spectra UNION ALL SELECT point_id, scene_code, 2, b4 FROM spectra) ;;
SELECT a.point_id, a.scene_code, a.band, a.x * coalesce(g.gain, 1) AS value FROM a LEFT JOIN gains g ON g.band = a.band AND g.scene_code = a.scene_code""")
def _(spark, d):
    return gains.applied(gains.unpivoted(view(spark, d, "spectra"), ["b2", "b4"], ["point_id", "scene_code"]), _gains(spark, d, 1))


@query("q_gain_indices", "point_id scene_code", "b2 b4 ndvi rvi msavi ndwi", f"""{_gain_sql(1)}, wd AS (SELECT s.*, b2 * coalesce(g.gain, 1) AS c2, b4 * coalesce(h.gain, 1) AS c4 FROM spectra s LEFT JOIN gains g ON g.scene_code = s.scene_code AND g.band = 1 LEFT JOIN gains h ON h.scene_code = s.scene_code AND h.band = 2) ;;
SELECT point_id, scene_code, c2 AS b2, c4 AS b4, (b5 - c2) / (b5 + c2) AS ndvi, c4 / b3 AS rvi, (2 * c4 + 1 - sqrt(greatest((2 * c4 + 1) * (2 * c4 + 1) - 8 * (c4 - b3), 0))) / 2 AS msavi, (b1 - b5) / (b1 + b5) AS ndwi FROM wd""")
def _(spark, d):
    """Gains on two bands, and the index bands, stale until then, computed anew from what they gave."""
    stale = {n: F.lit(-9.0) for n in ("ndvi", "rvi", "msavi", "ndwi")}
    numbers = {"b1": 51, "b2": 81, "b3": 93, "b4": 114, "b5": 126, "ndvi": 165, "rvi": 166, "msavi": 167, "ndwi": 168}
    return gains.corrected(view(spark, d, "spectra").withColumns(stale), _gains(spark, d, 1), {"b2": 1, "b4": 2}, numbers=numbers)


_STABLE = f"""{_gain_sql(1)}, gx AS (SELECT min(gain) AS lo, max(gain) AS hi FROM gains),
st AS (SELECT scene_code, avg(abs(ln(gain))) + coalesce(stddev_samp(ln(gain)), 0) AS i, avg(CASE WHEN gain <= lo + 1e-9 OR gain >= hi - 1e-9 THEN 1.0 ELSE 0.0 END::DOUBLE) AS e FROM gains, gx GROUP BY scene_code),
stab AS (SELECT scene_code, least(greatest(exp(-i / 0.5::DOUBLE) * (1 - 0.5::DOUBLE * e), 0.35::DOUBLE), 1) AS stability FROM st)"""


@query("q_scene_stability_weight", "scene_code", "stability", f"{_STABLE} ;; SELECT * FROM stab")
def _(spark, d):
    return gains.stability(_gains(spark, d, 1))


_CLIPPED = f"""u AS (SELECT *, {T.quality_level()} AS lv FROM spectra), us AS (SELECT * FROM u WHERE is_clear AND lv IN ('high', 'medium') AND offaxis_deg <= 35 AND border_dist_px >= 30 AND local_empty_cone_deg >= 8 AND surface_view_cos >= 0.35),
qq AS (SELECT quantile_cont(b2, 0.005) AS l2, quantile_cont(b2, 0.98) AS h2, quantile_cont(b4, 0.005) AS l4, quantile_cont(b4, 0.98) AS h4 FROM us),
cl AS (SELECT us.* REPLACE (greatest(least(greatest(b2, l2), h2), 0) AS b2, greatest(least(greatest(b4, l4), h4), 0) AS b4) FROM us, qq)"""


@query("q_value_clip", "point_id scene_code", "b2 b4", f"{ctes('spectra')}, {_CLIPPED} ;; SELECT * FROM cl")
def _(spark, d):
    return gains.clipped(gains.usable(brf.with_quality(view(spark, d, "spectra"))), {"b2": 26, "b4": 51})


_OPTIMIZED = f"""{_STABLE}, {_CLIPPED}, ow0 AS (SELECT cl.*, CASE lv WHEN 'high' THEN 1.0 ELSE 0.7 END::DOUBLE * view_weight_raw * coalesce(stability, 1) AS w0 FROM cl LEFT JOIN stab USING (scene_code)),
ow AS (SELECT *, w0 / (SELECT quantile_cont(w0, 0.5) FROM ow0) AS w FROM ow0), opt AS (SELECT point_id, sum(w) AS weight_sum, {T.mean('b2')} AS b2, {T.mean('b4')} AS b4 FROM ow GROUP BY point_id)"""


def _optimized(spark, d):
    rows = gains.clipped(gains.usable(brf.with_quality(view(spark, d, "spectra"))), {"b2": 26, "b4": 51})
    return gains.fused(gains.view_weights(rows, gains.stability(_gains(spark, d, 1))), ["b2", "b4"])


@query("q_optimized_fusion", "point_id", "weight_sum b2 b4", f"{_OPTIMIZED} ;; SELECT * FROM opt")
def _(spark, d):
    return _optimized(spark, d)


@query("q_fallback_fill", "point_id from_fallback", "b2 b4", f"""{_OPTIMIZED}, fb AS (SELECT point_id, sum(view_weight_raw * b2) / sum(view_weight_raw) AS b2, sum(view_weight_raw * b4) / sum(view_weight_raw) AS b4 FROM spectra WHERE keep_for_fusion GROUP BY point_id) ;;
SELECT fb.point_id, opt.b2 IS NULL OR opt.b4 IS NULL AS from_fallback, coalesce(opt.b2, fb.b2) AS b2, coalesce(opt.b4, fb.b4) AS b4 FROM fb LEFT JOIN opt USING (point_id)""")
def _(spark, d):
    return gains.with_fallback(_optimized(spark, d), fusion.fused(_weighted(spark, d, "raw"), ["b2", "b4"]), ["b2", "b4"])


# grids, anchors, targets


@query("q_map_projection", "scene_code", "east_km north_km gap_km", f"{ctes('scenes')}, {T.tm('scenes', 'cam_lon', 'cam_lat', '114.0::DOUBLE', '500000.0::DOUBLE')} ;; SELECT scene_code, east / 1000 AS east_km, north / 1000 AS north_km, 0 AS gap_km FROM tm")
def _(spark, d):
    s = view(spark, d, "scenes")
    e, n = mapgrid.grid(F.col("cam_lon"), F.col("cam_lat"), *mapgrid.SYSTEMS[4547])
    w, m = mapgrid.adjusted(*mapgrid.grid(F.col("cam_lon"), F.col("cam_lat"), *mapgrid.SYSTEMS[4526]), x_zone=38)
    return s.select("scene_code", (e / 1000).alias("east_km"), (n / 1000).alias("north_km"), ((w - e) / 1000).alias("gap_km"))


_GRID = f"""{ctes('points', 'scenes')}, cc AS (SELECT 'plain' AS name, cam_x, cam_y, scene_code FROM scenes UNION ALL SELECT 'swapped', cam_y, cam_x, scene_code FROM scenes UNION ALL SELECT 'far', cam_x + 400, cam_y, scene_code FROM scenes),
bx AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM points)"""


@query("q_crs_score", "name hits:long", "distance az zen score", f"""{_GRID}, g AS (SELECT name, count_if(cam_x BETWEEN xl - greatest(30, (xh - xl) * 0.2::DOUBLE) AND xh + greatest(30, (xh - xl) * 0.2::DOUBLE) AND cam_y BETWEEN yl - greatest(30, (yh - yl) * 0.2::DOUBLE) AND yh + greatest(30, (yh - yl) * 0.2::DOUBLE)) AS hits,
 median(sqrt(power(cam_x - (xl + xh) * 0.5::DOUBLE, 2) + power(cam_y - (yl + yh) * 0.5::DOUBLE, 2))) AS distance, median(CAST(scene_code % 9 AS DOUBLE)) AS az FROM cc, bx GROUP BY name) ;;
SELECT name, hits, distance, az, 999 AS zen, hits * 1000 - distance - 2 * az - 2 * 999 AS score FROM g""")
def _(spark, d):
    s = view(spark, d, "scenes")
    residual = [(F.col("scene_code") % 9).cast("double").alias("az_residual"), F.lit(None).cast("double").alias("zen_residual")]
    shapes = {"plain": ("cam_x", "cam_y", 0.0), "swapped": ("cam_y", "cam_x", 0.0), "far": ("cam_x", "cam_y", 400.0)}
    cams = None
    for name, (x, y, by) in shapes.items():
        part = s.select(F.lit(name).alias("name"), (F.col(x) + by).alias("cam_x"), F.col(y).alias("cam_y"), *residual)
        cams = part if cams is None else cams.union(part)
    return anchors.grid_scores(cams, anchors.bounds(view(spark, d, "points")))


_HITS = f"""{ctes('points', 'scenes')}, {T.CAMS}, h0 AS (SELECT scene_code, (x - cam_x) * r31 + (y - cam_y) * r32 + (z - cam_z) * r33 AS along, power(x - cam_x, 2) + power(y - cam_y, 2) + power(z - cam_z, 2) AS d2 FROM points, cams),
h1 AS (SELECT * FROM h0 WHERE along BETWEEN 1 AND 300 AND greatest(d2 - along * along, 0) <= 1), h2 AS (SELECT scene_code, count(*) AS hit_count, quantile_cont(along, 0.05) + 1 AS lim FROM h1 GROUP BY scene_code),
h3 AS (SELECT h1.*, lim, row_number() OVER (PARTITION BY scene_code ORDER BY along) AS nth, count_if(along <= lim) OVER (PARTITION BY scene_code) AS close FROM h1 JOIN h2 USING (scene_code)),
h4 AS (SELECT scene_code, median(along) AS anchor_range FROM h3 WHERE CASE WHEN close >= 8 THEN along <= lim ELSE nth <= 8 END GROUP BY scene_code),
hits AS (SELECT c.*, coalesce(hit_count, 0) AS hit_count, CASE WHEN hit_count >= 8 THEN anchor_range END AS anchor_range FROM cams c LEFT JOIN h2 USING (scene_code) LEFT JOIN h4 USING (scene_code)),
gz AS (SELECT quantile_cont(z, 0.05) AS gz FROM points),
anc AS (SELECT scene_code, cam_x, cam_y, cam_z, hit_count, CASE WHEN anchor_range IS NOT NULL THEN 'first_hit_pointcloud' ELSE 'fallback_ray_ground_intersection' END AS anchor_source, coalesce(anchor_range, (gz - cam_z) / r33) AS t, r31, r32, r33 FROM hits, gz),
anchors AS (SELECT *, cam_x + t * r31 AS anchor_x, cam_y + t * r32 AS anchor_y, cam_z + t * r33 AS anchor_z FROM anc)"""


def _anchors(spark, d):
    p = view(spark, d, "points")
    hits = anchors.first_hits(_cams(spark, d).withColumnsRenamed({"r31": "fwd_x", "r32": "fwd_y", "r33": "fwd_z"}), p)
    return anchors.resolved(hits, anchors.ground(p))


@query("q_first_hit_anchor", "scene_code anchor_source hit_count:long", "anchor_x anchor_y anchor_z", f"{_HITS} ;; SELECT * FROM anchors")
def _(spark, d):
    return _anchors(spark, d)


@query("q_anchor_sources", "anchor_source n:long", "", f"{_HITS} ;; SELECT anchor_source, count(*) AS n FROM anchors GROUP BY 1")
def _(spark, d):
    return anchors.source_counts(_anchors(spark, d))


@query("q_hemisphere_center", "", "center_x center_y center_z radius", f"""{_HITS}, m AS (SELECT median(anchor_x) AS center_x, median(anchor_y) AS center_y, median(anchor_z) AS center_z FROM anchors) ;;
SELECT center_x, center_y, center_z, (SELECT median(sqrt(power(cam_x - m.center_x, 2) + power(cam_y - m.center_y, 2) + power(cam_z - m.center_z, 2))) FROM anchors, m) AS radius FROM m""")
def _(spark, d):
    return anchors.center(_anchors(spark, d))


@query("q_point_covariance", "point_id n:long", "cxx cxy cxz cyy cyz czz", f"""{ctes('points')}, {T.NEAR}, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, other_id) AS k FROM pairs) WHERE k <= 48) ;;
SELECT point_id, count(*) AS n, covar_samp(dx, dx) AS cxx, covar_samp(dx, dy) AS cxy, covar_samp(dx, dz) AS cxz, covar_samp(dy, dy) AS cyy, covar_samp(dy, dz) AS cyz, covar_samp(dz, dz) AS czz FROM nn GROUP BY point_id""")
def _(spark, d):
    return neighbours.moments(neighbours.nearest(view(spark, d, "points"), 1.2, 48, with_self=True))


_NORMALS = f"""{ctes('points')}, kn AS (SELECT a.point_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, row_number() OVER (PARTITION BY a.point_id ORDER BY power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2), b.point_id) AS nth
 FROM points a JOIN points b ON abs(a.x - b.x) < 900),
cv AS (SELECT point_id, covar_samp(dx, dx) AS a, covar_samp(dy, dy) AS b, covar_samp(dz, dz) AS c, covar_samp(dx, dy) AS d, covar_samp(dy, dz) AS e, covar_samp(dx, dz) AS f FROM kn WHERE nth <= 48 GROUP BY point_id),
e1 AS (SELECT *, (a + b + c) / 3 AS q FROM cv), e2 AS (SELECT *, sqrt((power(a - q, 2) + power(b - q, 2) + power(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM e1),
e3 AS (SELECT *, ((a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p * p * p) AS r FROM e2),
e4 AS (SELECT *, q + 2 * p * cos(acos(least(greatest(r, -1), 1)) / 3 + 2 * pi() / 3) AS w FROM e3),
e5 AS (SELECT *, (b - w) * (c - w) - e * e AS xx, (a - w) * (c - w) - f * f AS yy, (a - w) * (b - w) - d * d AS zz FROM e4)"""


@query("q_normals", "point_id source", "verticality confidence", f"{_NORMALS} ;; SELECT point_id, 'pca' AS source, 1 - sqrt(greatest(zz / (xx + yy + zz), 0)) AS verticality, 1 - greatest(w, 0) / (3 * q) AS confidence FROM e5")
def _(spark, d):
    found = neighbours.prepared_normals(view(spark, d, "points"), 48, 1.2)
    return found.withColumn("verticality", 1.0 - F.abs("nz"))


@query("q_given_normals", "point_id source", "nx ny nz confidence", f"{ctes('points')}, {T.PNTS} ;; SELECT point_id, 'ply' AS source, nx, ny, nz, 1 AS confidence FROM pnts")
def _(spark, d):
    return neighbours.prepared_normals(view(spark, d, "points").withColumnsRenamed({f"n{c}_raw": f"n{c}" for c in "xyz"}))


@query("q_target_anchors", "", "top_x top_y top_z base_x base_y base_z", f"""{ctes('points')}, n AS (SELECT count(*) AS n FROM points), o AS (SELECT *, row_number() OVER (ORDER BY z) - 1 AS i FROM points),
c AS (SELECT (SELECT z FROM o, n WHERE i = greatest(0, CAST(floor(0.95::DOUBLE * n) AS BIGINT) - 1)) AS hi, (SELECT z FROM o, n WHERE i = least(n - 1, CAST(floor(0.05::DOUBLE * n) AS BIGINT))) AS lo) ;;
SELECT avg(CASE WHEN z >= hi THEN x END) AS top_x, avg(CASE WHEN z >= hi THEN y END) AS top_y, avg(CASE WHEN z >= hi THEN z END) AS top_z, avg(CASE WHEN z <= lo THEN x END) AS base_x, avg(CASE WHEN z <= lo THEN y END) AS base_y, avg(CASE WHEN z <= lo THEN z END) AS base_z FROM points, c""")
def _(spark, d):
    return anchors.top_and_base(view(spark, d, "points"))


_MARKS = f"""{ctes('scenes')}, mk AS (SELECT scene_code, CASE scene_code % 5 WHEN 0 THEN ' None ' WHEN 1 THEN 'odd' ELSE 'pending' END AS status, CASE WHEN scene_code % 2 = 0 THEN CAST(scene_code AS DOUBLE) END AS ut,
 CASE WHEN scene_code % 3 = 0 THEN CAST(scene_code AS DOUBLE) END AS ub FROM scenes)"""


@query("q_annotation_status", "scene_code status", "", f"{_MARKS} ;; SELECT scene_code, CASE WHEN lower(trim(status)) = 'none' THEN 'none' WHEN ut IS NOT NULL AND ub IS NOT NULL THEN 'full' WHEN ut IS NOT NULL THEN 'top_only' WHEN ub IS NOT NULL THEN 'base_only' ELSE 'pending' END AS status FROM mk")
def _(spark, d):
    k = F.col("scene_code")
    status = F.when(k % 5 == 0, " None ").when(k % 5 == 1, "odd").otherwise("pending")
    ut, ub = F.when(k % 2 == 0, k.cast("double")), F.when(k % 3 == 0, k.cast("double"))
    return view(spark, d, "scenes").select("scene_code", anchors.annotation_status(status, ut, ut, ub, ub).alias("status"))


_ERRORS = f"""{ctes('scenes')}, er AS (SELECT scene_code, scene_id, sqrt(power(scene_code % 7, 2) + power(scene_code % 5, 2)) AS e1, CASE WHEN scene_code % 4 <> 0 THEN sqrt(power(scene_code % 11, 2) + power(scene_code % 3, 2)) END AS e2 FROM scenes),
rr AS (SELECT *, greatest(e1, e2) AS pre_max, CASE WHEN e2 IS NULL THEN e1 ELSE (e1 + e2) / 2 END AS pre_mean FROM er)"""


def _errors(spark, d):
    k = F.col("scene_code")
    second = lambda m: F.when(k % 4 != 0, (k % m).cast("double"))
    s = view(spark, d, "scenes").select("scene_code", "scene_id", (k % 7).cast("double").alias("du1"), (k % 5).cast("double").alias("dv1"), second(11).alias("du2"), second(3).alias("dv2"))
    return gains.rmse_columns(s, [("du1", "dv1"), ("du2", "dv2")], "pre")


@query("q_registration_report", "scene_code", "pre_max pre_mean", f"{_ERRORS} ;; SELECT * FROM rr")
def _(spark, d):
    return _errors(spark, d)


@query("q_top_error_scenes", "scene_id", "pre_max", f"{_ERRORS} ;; SELECT scene_id, pre_max FROM rr ORDER BY pre_max DESC, scene_id LIMIT 5")
def _(spark, d):
    from ..operators import calibration

    return calibration.worst(_errors(spark, d), "pre_max", 5)


@query("q_error_statistics", "name", "mean median max", f"""{_ERRORS}, u AS (SELECT 'pre_error_1' AS name, e1 AS x FROM rr UNION ALL SELECT 'pre_error_2', e2 FROM rr) ;; SELECT name, avg(x) AS mean, median(x) AS median, max(x) AS max FROM u WHERE x IS NOT NULL GROUP BY name""")
def _(spark, d):
    from ..operators import calibration

    return calibration.error_statistics(_errors(spark, d), ["pre_error_1", "pre_error_2"])


@query("q_quality_gate", "solved:long failed:long clipped:long reasons passed", "min_angle median_angle mean_angle", f"""{ctes('scenes')}, s AS (SELECT scene_code % 13 + 0.5::DOUBLE AS a, scene_code % 17 = 3 AS f FROM scenes WHERE scene_code % 6 <> 0),
g AS (SELECT count(*) AS solved, count_if(f) AS failed, 0 AS clipped, min(a) AS min_angle, median(a) AS median_angle, avg(a) AS mean_angle FROM s),
w AS (SELECT *, concat_ws(';', CASE WHEN solved = 0 THEN 'nothing_solved' END, CASE WHEN failed > 0 THEN 'failed_scenes' END, CASE WHEN min_angle > 5 THEN 'min_angle' END, CASE WHEN median_angle > 5 THEN 'median_angle' END, CASE WHEN mean_angle > 10 THEN 'mean_angle' END) AS reasons FROM g) ;;
SELECT *, reasons = '' AS passed FROM w""")
def _(spark, d):
    from ..operators import calibration

    k = F.col("scene_code")
    s = view(spark, d, "scenes").select(
        F.when(k % 6 == 0, "none").otherwise("full").alias("status"), (k % 17 != 3).alias("success"), F.lit(False).alias("clipped"), (k % 13 + 0.5).alias("angle_deg")
    )
    return calibration.quality_gate(s)


@query("q_rotation_solve", "scene_id status success", "angle_deg post_error", f"""{ctes('scenes')}, s AS (SELECT scene_id, scene_code, CASE WHEN scene_code % 4 = 0 THEN 'top_only' WHEN scene_code % 4 = 1 THEN 'base_only' WHEN scene_code % 7 = 6 THEN 'none' ELSE 'full' END AS status FROM scenes) ;;
SELECT scene_id, status, true AS success, CASE status WHEN 'full' THEN 2 + scene_code % 3 WHEN 'none' THEN 0 END AS angle_deg, CASE WHEN status <> 'none' THEN 0.0 END AS post_error FROM s""")
def _(spark, d):
    """Whole marks give back the planted angle; with one end marked the turn about it is open, so
    its angle isn't shown; in all cases the marks are met again."""
    from ..operators import calibration

    marks = calibration_marks(spark, d)
    out = calibration.corrections(marks, C.intrinsics(1886, 1886, 35.0, 35.0))
    known = F.col("status").isin("full", "none")
    return out.withColumns({"angle_deg": F.when(known, F.col("angle_deg")), "post_error": F.nanvl("post_error", F.lit(None))})


def calibration_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks that a rotation by a known angle (2 degrees and more, about a camera's own axis) makes."""
    from ..functions.vectors import matrix_times, minus, product, rotation

    s = _cams(spark, d)
    rows = tuple(vec(*[f"r{i}{j}" for j in (1, 2, 3)]) for i in (1, 2, 3))
    turn = rotation(vec(1.0, 0.5, 0.2), (2 + F.col("scene_code") % 3).cast("double"))
    turned = product(turn, rows)
    ends = {"top": vec(F.col("site_x") + 5.0, 4.0, 4.0), "base": vec(F.col("site_x") + 5.5, 4.2, 0.5)}
    cam = vec("cam_x", "cam_y", "cam_z")
    cols = {}
    fx, fy, cx, cy = C.intrinsics(1886, 1886, 35.0, 35.0)
    for name, p in ends.items():
        x, y, z = matrix_times(turned, minus(p, cam))
        cols[f"u_{name}"], cols[f"v_{name}"] = fx * x / z + cx, fy * y / z + cy
        cols[name] = F.array(*p)
    status = F.when(F.col("scene_code") % 4 == 0, "top_only").when(F.col("scene_code") % 4 == 1, "base_only").when(F.col("scene_code") % 7 == 6, "none").otherwise("full")
    return s.select("scene_id", status.alias("status"), F.array(*[c for row in rows for c in row]).alias("r"), F.array(*cam).alias("cam"), *[v.alias(k) for k, v in cols.items()])


@query("q_bilinear_sample", "point_id scene_code", "value", f"""{ctes('observations')}, m AS (SELECT count(*) - 1 AS y_last FROM embeddings), p AS (SELECT *, u * 63 / 1885 AS a, v * y_last / 1885 AS b FROM observations, m), g AS (SELECT *, floor(a) AS x0, floor(b) AS y0, least(floor(a) + 1, 63) AS x1, least(floor(b) + 1, y_last) AS y1 FROM p),
e AS (SELECT vec_id, embedding FROM embeddings),
j AS (SELECT g.*, CAST(e0.embedding[CAST(x0 AS INT) + 1] AS DOUBLE) AS t0, CAST(e0.embedding[CAST(x1 AS INT) + 1] AS DOUBLE) AS t1, CAST(e1.embedding[CAST(x0 AS INT) + 1] AS DOUBLE) AS l0, CAST(e1.embedding[CAST(x1 AS INT) + 1] AS DOUBLE) AS l1
 FROM g JOIN e e0 ON e0.vec_id = y0 JOIN e e1 ON e1.vec_id = y1) ;;
SELECT point_id, scene_code, (t0 * (1 - (a - x0)) + t1 * (a - x0)) * (1 - (b - y0)) + (l0 * (1 - (a - x0)) + l1 * (a - x0)) * (b - y0) AS value FROM j""")
def _(spark, d):
    # the image: a line of 64 samples for each vector
    image = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    last = image.agg((F.count("*") - 1).alias("y_last"))
    o = view(spark, d, "observations").crossJoin(F.broadcast(last)).select("point_id", "scene_code", (F.col("u") * 63 / 1885).alias("a"), (F.col("v") * F.col("y_last") / 1885).alias("b"), "y_last")
    o = o.withColumns({"x0": F.floor("a").cast("int"), "y0": F.floor("b")})
    o = o.withColumns({"x1": F.least(F.col("x0") + 1, F.lit(63)), "y1": F.least(F.col("y0") + 1, "y_last")})
    o = o.join(image.select(F.col("vec_id").alias("y0"), F.col("e").alias("e0")), "y0").join(image.select(F.col("vec_id").alias("y1"), F.col("e").alias("e1")), "y1")
    fx, fy = F.col("a") - F.col("x0"), F.col("b") - F.col("y0")
    across = lambda e: F.element_at(e, F.col("x0") + 1) * (1.0 - fx) + F.element_at(e, F.col("x1") + 1) * fx
    return o.select("point_id", "scene_code", (across("e0") * (1.0 - fy) + across("e1") * fy).alias("value"))
