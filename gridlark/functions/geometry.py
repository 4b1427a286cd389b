"""Column expressions of the spatial operators: everything here stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def d(x) -> Column:
    """A double literal, or the column cast to double."""
    return F.lit(float(x)) if isinstance(x, int | float) else (F.col(x) if isinstance(x, str) else x).cast("double")


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite. Spark orders NaN above all numbers, so it needs a test of its own."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def voxel(x: Column, size: float) -> Column:
    return F.floor(d(x) / F.lit(float(size)))


def grid_index(v: Column, first: Column, step: Column, n: Column | int) -> Column:
    """World to cell, rounding half to even, clamped to the grid."""
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    return F.least(F.greatest(F.rint((v - first) / step), F.lit(0.0)), last.cast("double")).cast("int")


def at_step(low: Column, high: Column, i: Column, n: Column | int) -> Column:
    """The i-th of n evenly spaced values from low to high."""
    return low + (high - low) * i / (n - 1)


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def inside(box: Sequence[float], x="x", y="y", z="z") -> Column:
    """Axis-aligned crop, inclusive at both ends: xmin, xmax, ymin, ymax, zmin, zmax."""
    if len(box) != 6 or any(box[i] >= box[i + 1] for i in (0, 2, 4)):
        raise ValueError("a crop has six numbers, each minimum below its maximum")
    c = [d(x), d(y), d(z)]
    return c[0].between(box[0], box[1]) & c[1].between(box[2], box[3]) & c[2].between(box[4], box[5])


def octile(dx: Column, dy: Column) -> Column:
    """Cost of the shortest 8-connected walk over free cells."""
    a, b = F.abs(dx), F.abs(dy)
    return a + b + (F.lit(math.sqrt(2)) - 2) * F.least(a, b)


def occupancy(density: Column, reference, lam: float, power: float) -> Column:
    """1 - exp(-lam * (density / reference) ** power); lam and power have no defaults, as uses differ."""
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    return 1 - F.exp(-F.lit(float(lam)) * F.pow(F.greatest(density / (ref + F.lit(1e-12)), F.lit(0.0)), F.lit(float(power))))


def turn(ax: Column, ay: Column, bx: Column, by: Column, na: Column, nb: Column) -> Column:
    return F.acos(clip((ax * bx + ay * by) / (na * nb), -1.0, 1.0))


# Quaternions are (w, x, y, z) as four columns; matrices are nine columns, row by row.


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def matrix_to_quaternion(m: Sequence[Column]) -> list[Column]:
    """By the largest of trace and diagonal, so that no branch divides by a small number."""
    a, b, c, e, f, g, h, i, j = m
    trace = a + f + j
    s0, s1, s2, s3 = (2 * F.sqrt(F.greatest(v, F.lit(0.0))) for v in (trace + 1, 1 + a - f - j, 1 + f - a - j, 1 + j - a - f))
    first, second, third = trace > 0, (a > f) & (a > j), f > j
    pick = lambda p, q, r, s: F.when(first, p).when(second, q).when(third, r).otherwise(s)
    return [
        pick(s0 / 4, (i - g) / s1, (c - h) / s2, (e - b) / s3),
        pick((i - g) / s0, s1 / 4, (b + e) / s2, (c + h) / s3),
        pick((c - h) / s0, (b + e) / s1, s2 / 4, (g + i) / s3),
        pick((e - b) / s0, (c + h) / s1, (g + i) / s2, s3 / 4),
    ]


#: Above this dot product rotations are so near that linear interpolation is exact enough and a sine too small to divide by.
NEAR = 0.9995


def slerp(p: Sequence[Column], q: Sequence[Column], t: Column) -> list[Column]:
    """Spherical interpolation along the shorter arc; normalized linear interpolation for near rotations."""
    raw = sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    sign = F.when(raw < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    dot = F.least(F.abs(raw), F.lit(1.0))
    angle = F.acos(dot)
    near = dot > NEAR
    wp = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wq = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    mix = [wp * a + wq * b for a, b in zip(p, q, strict=True)]
    size = norm(*mix)
    return [m / size for m in mix]


def sequence_name(name: Column) -> Column:
    """A drive number as the full sequence name; full names pass."""
    full = name.startswith("2013_05_28_drive_") & name.endswith("_sync")
    return F.when(full, name).otherwise(F.concat(F.lit("2013_05_28_drive_"), F.lpad(name.cast("int").cast("string"), 4, "0"), F.lit("_sync")))


def human_size(n: Column) -> Column:
    """Bytes as text with one decimal in the largest unit that leaves at least one."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.lit(None).cast("string")
    for k in reversed(range(len(units))):
        fits = n < F.lit(1024.0 ** (k + 1)) if k < len(units) - 1 else F.lit(True)
        out = F.when(fits, F.concat(F.format_string("%.1f", n / F.lit(1024.0**k)), F.lit(units[k]))).otherwise(out)
    return out
