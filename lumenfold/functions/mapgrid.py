"""Transverse Mercator by Krueger's series, and operations on its result."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CGCS2000 ellipsoid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101


def system(code: int) -> tuple[float, float]:
    """(central meridian, false easting) of the CGCS2000 Gauss-Krueger systems by EPSG code: strips of
    six and three degrees, each once with the strip's number before the easting and once without."""
    for first, last, width, meridian, zone in ((4491, 4501, 6, 75, 13), (4502, 4512, 6, 75, None), (4513, 4533, 3, 75, 25), (4534, 4554, 3, 75, None)):
        if first <= code <= last:
            n = code - first
            return meridian + width * n, 500_000.0 + (0.0 if zone is None else (zone + n) * 1e6)
    raise ValueError(f"no grid for EPSG:{code}")


SYSTEMS = {code: system(code) for code in (4547, 4526)}

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def grid(lon: Column, lat: Column, central: float, false_easting: float, scale: float = 1.0) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    phi, lam = F.radians(lat), F.radians(lon - central)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return false_easting + scale * _RADIUS * east, scale * _RADIUS * north


def candidate(lon: Column, lat: Column, entry: dict) -> tuple[Column, Column]:
    """(x, y) of one entry of a catalogue: {name, src_crs, dst_crs, post_ops}."""
    if entry["src_crs"].upper() != "EPSG:4326":
        raise ValueError(f"{entry['name']} does not start at EPSG:4326")
    ops = entry.get("post_ops") or {}
    x, y = grid(lon, lat, *system(int(entry["dst_crs"].split(":")[1])))
    return adjusted(
        x, y, ops.get("swap_xy", False), ops.get("subtract_x_zone_prefix_million"), ops.get("subtract_y_zone_prefix_million"),
        ops.get("x_offset_m", 0.0), ops.get("y_offset_m", 0.0),
    )


def adjusted(x: Column, y: Column, swap_xy=False, x_zone=None, y_zone=None, x_offset=0.0, y_offset=0.0) -> tuple[Column, Column]:
    """Swap, then zone prefixes of millions off, then offsets, in this order."""
    if swap_xy:
        x, y = y, x
    if x_zone is not None:
        x = x - x_zone * 1e6
    if y_zone is not None:
        y = y - y_zone * 1e6
    return x + (x_offset or 0.0), y + (y_offset or 0.0)
