"""Viewing directions, camera frames, pinhole projection and centre windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Vec, angle_of_cos, clip, cross, dot, length, matrix_times, minus, mod360, scaled, unit, vec, wrapped


def observation_direction(azimuth: Column, zenith: Column, azimuth_reference="north_cw", zenith_reference="from_nadir") -> Vec:
    up = {"from_up": 0, "from_zenith": 0, "from_down": 1, "from_nadir": 1}
    if zenith_reference not in up or azimuth_reference not in ("north_cw", "east_ccw"):
        raise ValueError(f"unknown angle reference: {azimuth_reference}, {zenith_reference}")
    az, ze = F.radians(azimuth), F.radians(zenith)
    if up[zenith_reference]:
        ze = math.pi - ze
    across = (F.sin(az), F.cos(az)) if azimuth_reference == "north_cw" else (F.cos(az), F.sin(az))
    return unit((F.sin(ze) * across[0], F.sin(ze) * across[1], F.cos(ze)), (0.0, 0.0, -1.0))


def forward(direction: Vec, opposite: bool = False) -> Vec:
    return tuple(-x for x in direction) if opposite else direction


def with_frame(df: DataFrame, ahead: Vec, roll: Column | None = None) -> DataFrame:
    """df with r11..r33, the rows right, down and ahead of a camera under a vertical world axis.
    Each step is a column of its own: expressions that repeat each other would grow without end."""

    def step(d: DataFrame, name: str, v: Vec) -> DataFrame:
        return d.withColumns({f"_{name}{i}": x for i, x in enumerate(v)})

    def made(name: str) -> Vec:
        return vec(*[f"_{name}{i}" for i in range(3)])

    def normal(d: DataFrame, name: str, v: Vec, otherwise) -> DataFrame:
        return step(step(d, f"{name}raw", v), name, unit(made(f"{name}raw"), otherwise))

    d = normal(df, "f", ahead, (0.0, 0.0, -1.0))
    f = made("f")
    level, by_x, by_y = (cross(f, vec(*axis)) for axis in ((0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)))
    flat = F.sqrt(f[0] * f[0] + f[1] * f[1]) <= 1e-12
    picked = tuple(F.when(~flat, a).when(F.abs(f[0]) > 0.95, c).otherwise(b) for a, b, c in zip(level, by_x, by_y))
    d = normal(d, "r", picked, (0.0, 0.0, 0.0))
    d = normal(d, "d", cross(f, made("r")), (0.0, 0.0, 0.0))
    right, down = made("r"), made("d")
    if roll is not None:
        # a turn about an axis that both are normal to
        a = F.radians(F.when(F.abs(roll) > 1e-9, roll).otherwise(F.lit(0.0)))
        c, s = F.cos(a), F.sin(a)
        right, down = (tuple(x * c + y * s for x, y in zip(p, q)) for p, q in ((right, down), (down, tuple(-x for x in right))))
    rows = {f"r{i}{j}": x for i, row in enumerate((right, down, f), 1) for j, x in enumerate(row, 1)}
    return d.withColumns(rows).select(*df.columns, *rows)


def intrinsics(width: int, height: int, fov_h: float, fov_v: float) -> tuple[float, float, float, float]:
    """(fx, fy, cx, cy) in pixels."""
    cx, cy = (width - 1) / 2, (height - 1) / 2
    return cx / math.tan(math.radians(fov_h) / 2), cy / math.tan(math.radians(fov_v) / 2), cx, cy


def project(point: Vec, camera: Vec, rows, width=1886, height=1886, fov_h=35.0, fov_v=35.0, flip_u=False, flip_v=False) -> dict[str, Column]:
    """u, v (null behind the camera), range_m, offaxis_deg, border_px, inside."""
    rel = minus(point, camera)
    x, y, z = matrix_times(rows, rel)
    fx, fy, cx, cy = intrinsics(width, height, fov_h, fov_v)
    ahead = z > 1e-8
    safe = F.when(ahead, z)
    u, v = fx * (x / safe) + cx, fy * (y / safe) + cy
    if flip_u:
        u = (width - 1.0) - u
    if flip_v:
        v = (height - 1.0) - v
    border = F.least(u, v, (width - 1.0) - u, (height - 1.0) - v)
    return {
        "u": u,
        "v": v,
        "range_m": length(rel),
        "offaxis_deg": F.degrees(F.atan2(F.sqrt(x * x + y * y), F.greatest(z, F.lit(1e-12)))),
        "border_px": F.when(ahead, border),
        "inside": F.coalesce(ahead & (border >= 0.0), F.lit(False)),
    }


def project_corrected(point: Vec, camera: Vec, rows, width=1886, height=1886, fov_h=35.0, fov_v=35.0) -> tuple[Column, Column]:
    """u, v without a visibility test; a vanishing depth counts as 1e-8."""
    x, y, z = matrix_times(rows, minus(point, camera))
    fx, fy, cx, cy = intrinsics(width, height, fov_h, fov_v)
    z = F.when(F.abs(z) <= 1e-8, F.lit(1e-8)).otherwise(z)
    return fx * (x / z) + cx, fy * (y / z) + cy


def center_window(width: int, height: int, window_width: int | None, window_height: int | None) -> dict[str, int]:
    w = width if not window_width else max(1, min(width, int(window_width)))
    h = height if not window_height else max(1, min(height, int(window_height)))
    x, y = (width - w) // 2, (height - h) // 2
    return {"x_min": x, "x_max": x + w - 1, "y_min": y, "y_max": y + h - 1}


def in_window(u: Column, v: Column, w: dict[str, int]) -> Column:
    return u.between(w["x_min"], w["x_max"]) & v.between(w["y_min"], w["y_max"])


def window_distance(u: Column, v: Column, w: dict[str, int]) -> Column:
    """Distance to the nearest edge inside, minus the distance to the window outside."""
    left, right = u - float(w["x_min"]), float(w["x_max"]) - u
    top, bottom = v - float(w["y_min"]), float(w["y_max"]) - v
    dx, dy = F.greatest(-left, -right, F.lit(0.0)), F.greatest(-top, -bottom, F.lit(0.0))
    return F.when(in_window(u, v, w), F.least(left, top, right, bottom)).otherwise(-F.sqrt(dx * dx + dy * dy))


def with_view_geometry(df: DataFrame, point: Vec, normal: Vec, camera: Vec) -> DataFrame:
    """df with the direction to the camera and its angles.  Each step is a column of its own: in one expression
    they would repeat each other, in methods too long for the JVM to compile."""
    d = df.withColumns({f"_rel_{c}": x for c, x in zip("xyz", minus(camera, point))})
    d = d.withColumn("_far", 1.0 / F.greatest(length(vec("_rel_x", "_rel_y", "_rel_z")), F.lit(1e-12)))
    d = d.withColumns({f"dir_{c}": F.col(f"_rel_{c}") * F.col("_far") for c in "xyz"})
    to = vec("dir_x", "dir_y", "dir_z")
    d = d.withColumns({"view_zenith_deg": angle_of_cos(to[2]), "view_azimuth_deg": mod360(F.degrees(F.atan2(to[0], to[1])) + 360.0), "local_view_cos_signed": dot(normal, to)})
    facing = F.col("local_view_cos_signed")
    d = d.withColumns({"surface_view_cos": clip(F.abs(facing), 0.0, 1.0), "local_view_angle_deg": angle_of_cos(facing)})
    return d.drop("_rel_x", "_rel_y", "_rel_z", "_far")


def solar_local(normal: Vec, sun: Vec, sun_azimuth: Column, view_azimuth: Column) -> dict[str, Column]:
    """Null angles and no backlight where the sun is unknown."""
    c = dot(normal, sun)
    return {
        "local_solar_cos": c,
        "local_solar_incidence_deg": angle_of_cos(c),
        "is_backlit": F.coalesce(c <= 0.0, F.lit(False)),
        "relative_azimuth_deg": wrapped(sun_azimuth - view_azimuth),
    }


def view_residual(camera: Vec, target: Vec, azimuth: Column, zenith: Column, target_to_sensor=False, azimuth_reference="north_cw", zenith_reference="from_nadir"):
    """Absolute differences of a camera's angles from those of the line to its target."""
    d = minus(camera, target) if target_to_sensor else minus(target, camera)
    az = F.degrees(F.atan2(d[0], d[1]) if azimuth_reference == "north_cw" else F.atan2(d[1], d[0]))
    ze = angle_of_cos(d[2] / F.greatest(length(d), F.lit(1e-12)))
    if zenith_reference in ("from_down", "from_nadir"):
        ze = 180.0 - ze
    return F.abs(wrapped(mod360(az) - azimuth)), F.abs(ze - zenith)


def ray_plane(origin: Vec, direction: Vec, plane_z: Column) -> Vec:
    """Where a ray meets a horizontal plane ahead of it; null if it doesn't."""
    steep = F.abs(direction[2]) > 1e-12
    t = (plane_z - origin[2]) / F.when(steep, direction[2])
    t = F.when(t > 0.0, t)
    return tuple(o + t * d for o, d in zip(origin, direction))


def spherical(point: Vec, center: Vec) -> tuple[Column, Column, Column]:
    """(radius, azimuth from north, zenith angle) about a centre."""
    rel = minus(point, center)
    r = length(rel)
    return r, mod360(F.degrees(F.atan2(rel[0], rel[1]))), angle_of_cos(rel[2] / F.greatest(r, F.lit(1e-12)))


def image_plane(camera: Vec, rows, depth: Column, fov_h=35.0, fov_v=35.0) -> list[Vec]:
    """The four corners of the image at a depth: left-top, right-top, right-bottom, left-bottom."""
    right, down, ahead = rows
    half_w, half_h = depth * math.tan(math.radians(fov_h) / 2), depth * math.tan(math.radians(fov_v) / 2)
    return [
        tuple(c + a * depth + r * half_w * sx + d * half_h * sy for c, a, r, d in zip(camera, ahead, right, down))
        for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))
    ]


def near_image(u: Column, v: Column, margin: float = 100.0, width: int = 1886, height: int = 1886) -> Column:
    """Whether a projected place lies in the image or within the margin around it."""
    return F.coalesce(u.between(-margin, width - 1 + margin) & v.between(-margin, height - 1 + margin), F.lit(False))
