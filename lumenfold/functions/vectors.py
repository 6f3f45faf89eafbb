"""Column expressions on 3-vectors, given as tuples of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
TINY = 1e-12


def vec(*names) -> Vec:
    return tuple(F.col(n) if isinstance(n, str) else F.lit(n) if not isinstance(n, Column) else n for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vec, by: Column) -> Vec:
    return tuple(x * by for x in a)


def unit(a: Vec, otherwise: tuple[float, float, float] | None = None) -> Vec:
    """a over its length; `otherwise` (or a null vector) where the length vanishes or isn't finite."""
    n = length(a)
    good = (n > TINY) & (n < float("inf"))
    spare = otherwise or (None, None, None)
    return tuple(F.when(good, x / F.greatest(n, F.lit(TINY))).otherwise(F.lit(s).cast("double")) for x, s in zip(a, spare))


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds that let NaN through (least() alone would turn it into the bound)."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clip01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def mod360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def wrapped(x: Column) -> Column:
    """An angle in degrees brought into [-180, 180)."""
    return mod360(x + 180.0) - 180.0


def angle_of_cos(c: Column) -> Column:
    return F.degrees(F.acos(clip(c, -1.0, 1.0)))


def matrix_times(rows: tuple[Vec, Vec, Vec], v: Vec) -> Vec:
    return tuple(dot(r, v) for r in rows)


def product(a: tuple[Vec, Vec, Vec], b: tuple[Vec, Vec, Vec]) -> tuple[Vec, Vec, Vec]:
    """a @ b of 3 x 3 matrices given by rows."""
    columns = tuple(zip(*b))
    return tuple(tuple(dot(row, column) for column in columns) for row in a)


def rotation(axis: Vec, degrees: Column) -> tuple[Vec, Vec, Vec]:
    """Rodrigues' rotation about an axis; the identity where the axis vanishes."""
    x, y, z = unit(axis, (0.0, 0.0, 0.0))
    a = F.radians(degrees)
    c = F.when(length(axis) > TINY, F.cos(a)).otherwise(F.lit(1.0))
    s, k = F.sin(a), 1.0 - c
    return (
        (c + x * x * k, x * y * k - z * s, x * z * k + y * s),
        (y * x * k + z * s, c + y * y * k, y * z * k - x * s),
        (z * x * k - y * s, z * y * k + x * s, c + z * z * k),
    )
