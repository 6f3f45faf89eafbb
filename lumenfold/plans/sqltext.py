"""Pieces of the oracle's SQL that several queries use."""

from __future__ import annotations

from . import adapters


def pm(x: str, m: str = "360") -> str:
    return f"((({x}) % {m}) + {m}) % {m}"


def clip(x: str, low="-1.0", high="1.0") -> str:
    return f"least(greatest({x}, {low}), {high})"


def c01(x: str) -> str:
    return clip(x, "0.0", "1.0")


def degacos(x: str) -> str:
    return f"degrees(acos({clip(x)}))"


def solar(source: str, keep: str, micros: str, lat: str, lon: str) -> str:
    """A SELECT of keep, zen, elev, azi."""
    return f"""SELECT {keep}, zen, 90 - zen AS elev, {pm("degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(decl) * cos(phi))) + 180")} AS azi FROM (
 SELECT *, {degacos("sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha)")} AS zen FROM (
 SELECT *, radians({pm("mins + eqt + 4 * lon_", "1440")} / 4 - 180) AS ha FROM (
 SELECT *, 4 * degrees(y * sin(2 * l0) - 2 * ecc * sin(an) + 4 * ecc * y * sin(an) * cos(2 * l0) - 0.5::DOUBLE * y * y * sin(4 * l0) - 1.25::DOUBLE * ecc * ecc * sin(2 * an)) AS eqt FROM (
 SELECT *, asin(sin(tilt) * sin(app)) AS decl, power(tan(tilt / 2), 2) AS y, radians(ml) AS l0 FROM (
 SELECT *, radians(ml + eqc - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(node)) AS app, radians(23 + (26 + (21.448::DOUBLE - t * (46.815::DOUBLE + t * (0.00059::DOUBLE - t * 0.001813::DOUBLE))) / 60) / 60 + 0.00256::DOUBLE * cos(node)) AS tilt FROM (
 SELECT *, sin(an) * (1.914602::DOUBLE - t * (0.004817::DOUBLE + 0.000014::DOUBLE * t)) + sin(2 * an) * (0.019993::DOUBLE - 0.000101::DOUBLE * t) + sin(3 * an) * 0.000289::DOUBLE AS eqc FROM (
 SELECT *, {pm("280.46646::DOUBLE + t * (36000.76983::DOUBLE + 0.0003032::DOUBLE * t)")} AS ml, radians(357.52911::DOUBLE + t * (35999.05029::DOUBLE - 0.0001537::DOUBLE * t)) AS an,
  0.016708634::DOUBLE - t * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * t) AS ecc, radians(125.04::DOUBLE - 1934.136::DOUBLE * t) AS node FROM (
 SELECT *, {micros} AS us, (({micros}) / 86400e6 + 2440587.5::DOUBLE - 2451545) / 36525 AS t, radians({lat}) AS phi, {lon} AS lon_, (({micros}) % 86400000000) / 60e6 AS mins FROM {source}
 ))))))))"""


def tm(source: str, lon: str, lat: str, central: str, false_easting: str) -> str:
    """CTEs that end in tm: source with east and north, by Krueger's series on the CGCS2000 ellipsoid."""
    n, e = "(1 / (2 * 298.257222101::DOUBLE - 1))", "sqrt((2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE)"
    terms = (f"{n} / 2 - 2 * {n} * {n} / 3 + 5 * {n} * {n} * {n} / 16", f"13 * {n} * {n} / 48 - 3 * {n} * {n} * {n} / 5", f"61 * {n} * {n} * {n} / 240")
    radius = f"6378137.0::DOUBLE / (1 + {n}) * (1 + {n} * {n} / 4 + power({n}, 4) / 64)"
    east = " + ".join(f"({a}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(terms, 1))
    north = " + ".join(f"({a}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(terms, 1))
    return f"""tm0 AS (SELECT *, radians({lon} - {central}) AS lam, sin(radians({lat})) AS sp FROM {source}),
tm1 AS (SELECT *, sinh(atanh(sp) - {e} * atanh({e} * sp)) AS ct FROM tm0), tm2 AS (SELECT *, atan2(ct, cos(lam)) AS xi, asinh(sin(lam) / sqrt(ct * ct + cos(lam) * cos(lam))) AS eta FROM tm1),
tm AS (SELECT *, {false_easting} + {radius} * (eta + {east}) AS east, {radius} * (xi + {north}) AS north FROM tm2)"""


CAMS = """cam0 AS (SELECT *, site_x + 5 - cam_x AS dx, 4 - cam_y AS dy, 2.5::DOUBLE - cam_z AS dz FROM scenes),
cam1 AS (SELECT *, dx / sqrt(dx * dx + dy * dy + dz * dz) AS r31, dy / sqrt(dx * dx + dy * dy + dz * dz) AS r32, dz / sqrt(dx * dx + dy * dy + dz * dz) AS r33 FROM cam0),
cam2 AS (SELECT *, r32 / sqrt(r31 * r31 + r32 * r32) AS r11, -r31 / sqrt(r31 * r31 + r32 * r32) AS r12, 0::DOUBLE AS r13 FROM cam1),
cams AS (SELECT *, r32 * r13 - r33 * r12 AS r21, r33 * r11 - r31 * r13 AS r22, r31 * r12 - r32 * r11 AS r23 FROM cam2)"""

PNTS = """pnts AS (SELECT *, nx_raw / sqrt(nx_raw * nx_raw + ny_raw * ny_raw + nz_raw * nz_raw) AS nx, ny_raw / sqrt(nx_raw * nx_raw + ny_raw * ny_raw + nz_raw * nz_raw) AS ny,
 nz_raw / sqrt(nx_raw * nx_raw + ny_raw * ny_raw + nz_raw * nz_raw) AS nz, 1 - abs(nz_raw / sqrt(nx_raw * nx_raw + ny_raw * ny_raw + nz_raw * nz_raw)) AS surface_verticality FROM points)"""

SUNS = "suns AS (SELECT scene_code, zen, azi, sin(radians(zen)) * sin(radians(azi)) AS sun_x, sin(radians(zen)) * cos(radians(azi)) AS sun_y, cos(radians(zen)) AS sun_z FROM (" + solar(
    "(SELECT s.*, t.acquisition_time FROM scenes s JOIN times t USING (scene_code))", "scene_code", "epoch_us(acquisition_time)", "cam_lat", "cam_lon"
) + "))"

_F = "(1885.0::DOUBLE / 2 / tan(radians(35) / 2))"

PROJ = f"""proj0 AS (SELECT p.*, c.*, p.x - cam_x AS ex, p.y - cam_y AS ey, p.z - cam_z AS ez FROM pnts p, cams c),
proj1 AS (SELECT *, r11 * ex + r12 * ey + r13 * ez AS px, r21 * ex + r22 * ey + r23 * ez AS py, r31 * ex + r32 * ey + r33 * ez AS pz FROM proj0),
proj2 AS (SELECT *, {_F} * (px / pz) + 942.5::DOUBLE AS u, {_F} * (py / pz) + 942.5::DOUBLE AS v, sqrt(ex * ex + ey * ey + ez * ez) AS range_m,
 degrees(atan2(sqrt(px * px + py * py), greatest(pz, 1e-12))) AS offaxis_deg FROM proj1 WHERE pz > 1e-8),
proj AS (SELECT *, least(u, v, 1885 - u, 1885 - v) AS border_px FROM proj2 WHERE least(u, v, 1885 - u, 1885 - v) >= 0 AND range_m <= 300)"""

#: The centre window of 1024 pixels in 1886.
WINDOW = (431.0, 1454.0)


def window_distance(u: str, v: str) -> str:
    a, b = WINDOW
    return f"""CASE WHEN {u} BETWEEN {a} AND {b} AND {v} BETWEEN {a} AND {b} THEN least({u} - {a}::DOUBLE, {b}::DOUBLE - {u}, {v} - {a}::DOUBLE, {b}::DOUBLE - {v})
 ELSE -sqrt(power(greatest({a}::DOUBLE - {u}, {u} - {b}::DOUBLE, 0), 2) + power(greatest({a}::DOUBLE - {v}, {v} - {b}::DOUBLE, 0), 2)) END"""


VIEWS = f"""view0 AS (SELECT proj.*, {window_distance("u", "v")} AS center_distance, -ex / greatest(range_m, 1e-12) AS dir_x, -ey / greatest(range_m, 1e-12) AS dir_y, -ez / greatest(range_m, 1e-12) AS dir_z FROM proj),
view1 AS (SELECT *, {degacos("dir_z")} AS view_zenith_deg, {pm("degrees(atan2(dir_x, dir_y)) + 360")} AS view_azimuth_deg, nx * dir_x + ny * dir_y + nz * dir_z AS facing FROM view0),
view2 AS (SELECT v.*, {clip("abs(facing)", "0.0", "1.0")} AS surface_view_cos, {degacos("facing")} AS local_view_angle_deg, zen AS solar_zenith_deg, azi AS solar_azimuth_deg,
 nx * sun_x + ny * sun_y + nz * sun_z AS local_solar_cos FROM view1 v LEFT JOIN suns USING (scene_code)),
views AS (SELECT *, greatest(center_distance, 0) AS border_dist_px, {degacos("local_solar_cos")} AS local_solar_incidence_deg, coalesce(local_solar_cos <= 0, false) AS is_backlit,
 {pm("solar_azimuth_deg - view_azimuth_deg + 180")} - 180 AS relative_azimuth_deg,
 0.01::DOUBLE * center_distance - 0.4::DOUBLE * offaxis_deg - 0.005::DOUBLE * range_m + 4 * surface_view_cos * (0.25::DOUBLE + 0.75::DOUBLE * normal_confidence)
 + 0.12::DOUBLE * view_zenith_deg * {c01("surface_verticality")} * (0.25::DOUBLE + 0.75::DOUBLE * normal_confidence) AS coarse_score FROM view2)"""

TOPK = """topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY CAST(coarse_score AS FLOAT) DESC, scene_code) - 1 AS slot FROM views) WHERE slot < 8)"""

CANDIDATES = ",\n".join([adapters.ctes("points", "scenes", "times"), CAMS, PNTS, SUNS, PROJ, VIEWS, TOPK])

NEAR = """cells AS (SELECT point_id, x, y, z, CAST(floor(x / 1.2::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 1.2::DOUBLE) AS BIGINT) AS cy, CAST(floor(z / 1.2::DOUBLE) AS BIGINT) AS cz FROM points),
spread AS (SELECT point_id, x, y, z, cx + a AS cx, cy + b AS cy, cz + c AS cz FROM cells, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c)),
met AS (SELECT a.point_id, b.point_id AS other_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM spread a JOIN cells b USING (cx, cy, cz)),
pairs AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM met WHERE dx * dx + dy * dy + dz * dz < 1.2::DOUBLE * 1.2::DOUBLE),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, other_id) AS nth FROM pairs WHERE point_id <> other_id) WHERE nth <= 256)"""


def quality_level() -> str:
    sound = "is_clear AND NOT contains(lower(selection_method), 'fallback') AND blocker_count <= 0"
    level = lambda o, c, b, z: f"{sound} AND offaxis_deg <= {o} AND local_empty_cone_deg >= {c} AND border_dist_px >= {b} AND view_zenith_deg <= {z}"
    return f"CASE WHEN {level(20, 15, 80, 60)} THEN 'high' WHEN {level(35, 8, 30, 70)} THEN 'medium' ELSE 'low' END"


def reliability(c: str) -> str:
    return f"(0.25::DOUBLE + 0.75::DOUBLE * {c01(c)})"


SELECTION_SCORE = f"""0.2::DOUBLE * coarse_score + 0.7::DOUBLE * local_empty_cone_deg - 0.45::DOUBLE * blocker_count - 0.2::DOUBLE * offaxis_deg - 0.006::DOUBLE * range_m
 + {c01("surface_view_cos")} * {reliability("normal_confidence")} + 0.3::DOUBLE * greatest(view_zenith_deg, 0) * {c01("surface_verticality")} * {reliability("normal_confidence")}"""

RAW_WEIGHT = f"""greatest(1 / (1 + exp(-{clip("coarse_score / 6", "-60", "60")})) * exp(-greatest(offaxis_deg, 0) / 28) * exp(-greatest(range_m, 0) / 80)
 * greatest(1 - exp(-greatest(border_dist_px, 0) / 120), 1e-6) * greatest(1 - exp(-greatest(local_empty_cone_deg, 0) / 25), 1e-6) * exp(-0.5::DOUBLE * greatest(blocker_count, 0))
 * CASE WHEN is_clear THEN 1.0 ELSE 0.25 END::DOUBLE * (0.05::DOUBLE + 0.95::DOUBLE * {c01("surface_view_cos")} * {reliability("normal_confidence")})
 * (1 + 2.5::DOUBLE * {c01("surface_verticality")} * {c01("view_zenith_deg / 90")} * {reliability("normal_confidence")}), 1e-6)"""


def base_weight(mode: str) -> str:
    soft = lambda t: f"exp({clip(f'(visibility_score - best) / {t}', '-60', '60')})"
    return {
        "raw": "view_weight_raw",
        "hybrid": f"{soft(30)} * greatest(view_weight_raw, 1e-18)",
        "softmax": soft(30),
        "surface_adaptive": f"""{soft(45)} * exp(-greatest(range_m, 0) / 240) * exp(-greatest(offaxis_deg, 0) / 120)
 * (0.75::DOUBLE + 0.25::DOUBLE * (1 - exp(-greatest(local_empty_cone_deg, 0) / 30))) * exp(-0.35::DOUBLE * greatest(blocker_count, 0)) * CASE WHEN is_clear THEN 1.0 ELSE 0.2 END::DOUBLE
 * (0.05::DOUBLE + 0.95::DOUBLE * {c01("surface_view_cos")}) * exp(4 * {c01("surface_verticality")} * {c01("view_zenith_deg / 60")} * {reliability("normal_confidence")})""",
    }[mode]


def weighted(mode: str) -> str:
    return f"""{adapters.ctes("spectra")},
w0 AS (SELECT *, max(visibility_score) OVER (PARTITION BY point_id) AS best FROM spectra WHERE keep_for_fusion),
w1 AS (SELECT *, {base_weight(mode)} AS base FROM w0),
wt AS (SELECT *, base / sum(base) OVER (PARTITION BY point_id) AS w FROM w1 WHERE base > 0)"""


def mean(c: str) -> str:
    return f"sum(w * {c}) / sum(w)"
