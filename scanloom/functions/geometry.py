"""Scalar geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands of height bins of 5 cm as bitmaps. Their bounds come from truncated divisions in double
#: precision (0.30 / 0.05 is a little under 6), so they are stated, not computed.
WALL_MASK = 0xFFFFFFFFE0
OCCUPIED_MASK = 0xFFFFFFFFFF
HEADER_MASK = 0x7F0000000000
SILL_MASK = 0xFFE0
Z90 = 1.6449


def valid_depth(depth: Column, confidence: Column, low: float, high: float, least: int) -> Column:
    return (confidence >= least) & depth.between(low, high)


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column, flip: bool = False) -> tuple[Column, Column, Column]:
    """A pixel to camera coordinates: x right, y down, z forward; ``flip`` for cameras with y up and z backward."""
    x, y, z = (u - cx) * depth / fx, (v - cy) * depth / fy, depth
    return (x, -y, -z) if flip else (x, y, z)


def rescaled(f: Column, c: Column, was: float, now: float) -> tuple[Column, Column]:
    """Focal length and principal point at another resolution; pixel centres are at halves."""
    s = now / was
    return f * F.lit(s), (c + F.lit(0.5)) * F.lit(s) - F.lit(0.5)


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Row-major 3 x 3 of the normalised quaternion; null for the zero quaternion."""
    n = F.nullif(F.sqrt(x * x + y * y + z * z + w * w), F.lit(0.0))
    x, y, z, w = x / n, y / n, z / n, w / n
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def matrix_quaternion(r: list[Column]) -> list[Column]:
    """Row-major 3 x 3 to (x, y, z, w), through the largest of the four components."""
    t = r[0] + r[4] + r[8]
    s0, s1, s2, s3 = (F.sqrt(F.greatest(e, F.lit(0.0))) * 2 for e in (t + 1, 1 + r[0] - r[4] - r[8], 1 + r[4] - r[0] - r[8], 1 + r[8] - r[0] - r[4]))
    by_w, by_x, by_y = t > 0, (r[0] > r[4]) & (r[0] > r[8]), r[4] > r[8]
    choose = lambda a, b, c, d: F.when(by_w, a).when(by_x, b).when(by_y, c).otherwise(d)
    return [
        choose((r[7] - r[5]) / s0, s1 / 4, (r[1] + r[3]) / s2, (r[2] + r[6]) / s3),
        choose((r[2] - r[6]) / s0, (r[1] + r[3]) / s1, s2 / 4, (r[5] + r[7]) / s3),
        choose((r[3] - r[1]) / s0, (r[2] + r[6]) / s1, (r[5] + r[7]) / s2, s3 / 4),
        choose(s0 / 4, (r[7] - r[5]) / s1, (r[2] - r[6]) / s2, (r[3] - r[1]) / s3),
    ]


def apply_pose(r: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def yaw_matrix(angle: Column) -> list[Column]:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [F.cos(angle), zero, F.sin(angle), zero, one, zero, -F.sin(angle), zero, F.cos(angle)]


def to_plan(x: Column, z: Column, theta: float) -> tuple[Column, Column]:
    """World to plan: (x, -z) turned back by the angle of the walls."""
    c, s = F.lit(math.cos(theta)), F.lit(math.sin(theta))
    return c * x - s * z, -s * x - c * z


def to_world(px: Column, py: Column, theta: float) -> tuple[Column, Column]:
    c, s = F.lit(math.cos(theta)), F.lit(math.sin(theta))
    return c * px - s * py, -(s * px + c * py)


def floor_height(x: Column, y: Column, z: Column, a: float, b: float, c: float) -> Column:
    return y - (F.lit(a) * x + F.lit(b) * z + F.lit(c))


def line_intersection(a: Column, b: Column, e: Column, c: Column, d: Column, f: Column, parallel: float = 1e-9) -> tuple[Column, Column]:
    """Of a x + b y = e and c x + d y = f; null if they are parallel."""
    det = a * d - b * c
    safe = F.when(F.abs(det) >= parallel, det)
    return (e * d - b * f) / safe, (a * f - e * c) / safe


def snapped_angle(angle: Column, degrees: float) -> Column:
    """The nearest axis direction if it's within so many degrees, else the angle itself."""
    axis = F.rint(angle / F.lit(math.pi / 2)) * F.lit(math.pi / 2)
    return F.when(F.abs(angle - axis) > F.lit(degrees * math.pi / 180), angle).otherwise(axis)


def remainder(x: Column, y: float) -> Column:
    """IEEE remainder: the rest towards the nearest multiple, half to even."""
    return x - F.lit(y) * F.rint(x / F.lit(y))


def interval(v: Column, sigma: Column) -> tuple[Column, Column]:
    return v - F.lit(Z90) * sigma, v + F.lit(Z90) * sigma


def face_sigma(spread: Column, n: Column, systematic: float = 0.005, inferred: float = 0.10) -> Column:
    return F.when(n > 0, F.sqrt(spread * spread / n + F.lit(systematic * systematic))).otherwise(F.lit(inferred))


def measurement(v: Column, sigma: Column, scale: float = 0.0, power: int = 1, source: str = "measured") -> Column:
    """Value and 90 % interval to three places, widened by the relative error of the scale."""
    wide = F.hypot(sigma, F.lit(power * scale) * v)
    low, high = interval(v, wide)
    return F.struct(F.round(v, 3).alias("value"), F.array(F.round(low, 3), F.round(high, 3)).alias("ci90"), F.lit(source).alias("source"))


def lopsided(v: Column, high: float, low: float = 0.8) -> Column:
    return F.array(F.round(v * low, 3), F.round(v * high, 3))


def weighted_rms(d: Column, w: Column) -> Column:
    """Zero where there is no weight."""
    return F.coalesce(F.sqrt(F.sum(w * d * d) / F.nullif(F.sum(w).cast("double"), F.lit(0.0))), F.lit(0.0))


def positive_or(text: Column, fallback: Column) -> Column:
    """A positive number from text, else the fallback."""
    number = F.expr("1").cast("double") * text.try_cast("double")
    return F.coalesce(F.when(number > 0, number), fallback)


def unrotated_box(box: Column, turns: Column, w: Column, h: Column) -> Column:
    """A box (x0, y0, x1, y1) of an image that was turned clockwise by quarter turns, in the image before."""
    x0, y0, x1, y1 = (box[i] for i in range(4))
    return (
        F.when(turns % 4 == 1, F.array(y0, h - x1, y1, h - x0))
        .when(turns % 4 == 2, F.array(w - x1, h - y1, w - x0, h - y0))
        .when(turns % 4 == 3, F.array(w - y1, x0, w - y0, x1))
        .otherwise(box)
    )
