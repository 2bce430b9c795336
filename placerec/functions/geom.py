"""Geometry as Column expressions; everything stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU, PI, EARTH = 2 * math.pi, math.pi, 6378137.0


def finite(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def range_xy(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def bearing(x: Column, y: Column) -> Column:
    """atan2 in [0, 2 pi).

    Beside the y axis, an edge of sectors, it is worked out as the axis' own angle less x / y: the JVM's atan2 may be a last place off there.
    """
    up = F.signum(y)
    beside = (F.abs(x) <= 1e-9 * F.abs(y)) & (y != 0)
    # pi / 2 as two numbers
    a = F.when(beside, up * (TAU / 4) - (x / y - up * 6.123233995736766e-17)).otherwise(F.atan2(y, x))
    return F.when(a < 0, a + TAU).otherwise(a)


def polar_bin(value: Column, span: float, n: int) -> Column:
    """ceil binning of (0, span] in n bins from 0."""
    return clamp(F.ceil(value / span * n) - 1, 0, n - 1).cast("int")


def floor_bin(value: Column, width: float, n: int) -> Column:
    return clamp(F.floor(value / width), 0, n - 1).cast("int")


def wrap(a: Column) -> Column:
    """An angle in (-pi, pi]; non-finite counts as 0."""
    r = a - TAU * F.rint(a / TAU)
    r = F.when(r <= -PI, r + TAU).when(r > PI, r - TAU).otherwise(r)
    return F.when(F.isnan(a) | (F.abs(a) == float("inf")), F.lit(0.0)).otherwise(r)


def level_rotation(ux: Column, uy: Column, uz: Column) -> list[list[Column]]:
    """The least rotation that turns a unit up vector to +z; half a turn about x for the opposite."""
    k = F.lit(1.0) / (F.lit(1.0) + uz)
    rows = [[1 - ux * ux * k, -ux * uy * k, -ux], [-ux * uy * k, 1 - uy * uy * k, -uy], [ux, uy, uz]]
    flip = [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]]
    down = uz < -1 + 1e-12
    return [[F.when(down, F.lit(flip[i][j])).otherwise(rows[i][j]) for j in range(3)] for i in range(3)]


def rotate(m: list[list[Column]], x: Column, y: Column, z: Column) -> list[Column]:
    return [r[0] * x + r[1] * y + r[2] * z for r in m]


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rpy(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    return F.atan2(m[2][1], m[2][2]), F.asin(clamp(-m[2][0], -1.0, 1.0)), F.atan2(m[1][0], m[0][0])


def seed_yaw(base_yaw: Column, yaw_shift: Column) -> Column:
    return wrap(base_yaw - yaw_shift)


def se2(x: Column, y: Column, yaw: float, tx: float, ty: float) -> tuple[Column, Column]:
    c, s = math.cos(yaw), math.sin(yaw)
    return x * c - y * s + tx, x * s + y * c + ty


def se2_inverse(x: Column, y: Column, yaw: float, tx: float, ty: float) -> tuple[Column, Column]:
    c, s = math.cos(yaw), math.sin(yaw)
    return (x - tx) * c + (y - ty) * s, -(x - tx) * s + (y - ty) * c


def geodetic_enu(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular east and north of an origin, degrees in, metres out."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH, F.radians(lat - lat0) * EARTH


def slerp_yaw(a: Column, b: Column, t: Column) -> Column:
    return wrap(a + wrap(b - a) * t)


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Between two unit quaternions (x, y, z, w) along the shorter arc; nearly equal ones are mixed linearly."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign, c = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0)), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(c)
    close = c > 1 - 1e-12
    wa = F.when(close, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle)))
    wb = F.when(close, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle)))
    q = [wa * p + sign * wb * r for p, r in zip(a, b, strict=True)]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [x / n for x in q]


def transpose(m: list[list[Column]]) -> list[list[Column]]:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def up_in_body(x: Column, y: Column, z: Column, w: Column) -> tuple[Column, Column, Column]:
    """The world's +z seen from a body of this orientation; null for a quaternion without length."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    q = [F.when(n >= 1e-12, c / n) for c in (x, y, z, w)]
    return tuple(quaternion_matrix(*q)[2])


def canonical_yaw(rotation: list[list[Column]], level: list[list[Column]]) -> Column:
    """The heading of a pose once its descriptor frame has been levelled."""
    m = product(rotation, transpose(level))
    return F.atan2(m[1][0], m[0][0])
