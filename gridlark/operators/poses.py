"""Poses as a time series: two-sided as-of join with interpolation, and transforms of scans into the world."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import NEAR, matrix_to_quaternion, norm, quaternion_to_matrix

QUATERNION, SHIFT = ("qw", "qx", "qy", "qz"), ("tx", "ty", "tz")


def bracket(frames: DataFrame, poses: DataFrame, key: str = "seq", time: str = "frame") -> DataFrame:
    """Each (key, time) of `frames` with the pose at or before it (struct a) and the one at or after it (struct b).

    Two sorts by key and time over the union of both; no range join. The look ahead is a look back in descending
    order: a frame that reaches to the end of its partition would be evaluated anew for each row. Distinct times are
    matched, not points: join the result back by (key, time)."""
    fields = [c for c in poses.columns if c not in (key,)]
    p = poses.select(key, F.col(time), F.struct(*fields).alias("pose"))
    u = p.unionByName(frames.select(key, time).distinct().withColumn("pose", F.lit(None).cast(p.schema["pose"].dataType)))
    back = lambda order: F.last("pose", ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = back(F.asc(time)), back(F.desc(time))
    return u.withColumns({"a": before, "b": after}).filter("pose IS NULL").drop("pose")


def interpolated(frames: DataFrame, poses: DataFrame, key: str = "seq", time: str = "frame") -> DataFrame:
    """key, time, quaternion and shift: the pose itself at its time, the first or last one outside, and between two
    neighbours the shift linearly and the rotation along the shorter arc."""
    j = bracket(frames, poses, key, time)
    first, last = F.coalesce("a", "b"), F.coalesce("b", "a")
    j = j.withColumns({"a": first, "b": last}).filter("a IS NOT NULL")
    span = F.col(f"b.{time}") - F.col(f"a.{time}")
    t = F.when(span > 0, (F.col(time) - F.col(f"a.{time}")) / span).otherwise(F.lit(0.0))
    j = j.withColumn("t", t)
    # In steps, each a projection that later ones use by name: written as one expression it would repeat itself.
    j = slerp_weights(j, [F.col(f"a.{c}") for c in QUATERNION], [F.col(f"b.{c}") for c in QUATERNION])
    j = j.withColumns({f"_{c}": F.col("_wa") * F.col(f"a.{c}") + F.col("_wb") * F.col(f"b.{c}") for c in QUATERNION})
    j = j.withColumn("_n", norm(*[F.col(f"_{c}") for c in QUATERNION]))
    mixed = [F.when(F.col("t") == 0, F.col(f"a.{c}")).otherwise(F.col(f"_{c}") / F.col("_n")).alias(c) for c in QUATERNION]
    shift = [((1 - F.col("t")) * F.col(f"a.{c}") + F.col("t") * F.col(f"b.{c}")).alias(c) for c in SHIFT]
    return j.select(key, time, *mixed, *shift)


def slerp_weights(df: DataFrame, a: list[Column], b: list[Column]) -> DataFrame:
    """Adds the weights _wa and _wb of the two rotations at `t`, along the shorter arc; near ones are mixed linearly."""
    raw = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    d = df.withColumn("_raw", raw).withColumn("_angle", F.acos(F.least(F.abs("_raw"), F.lit(1.0))))
    near, t, angle = F.abs("_raw") > NEAR, F.col("t"), F.col("_angle")
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * F.when(F.col("_raw") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return d.withColumns({"_wa": wa, "_wb": wb})


def rotation(df: DataFrame, prefix: str = "r") -> DataFrame:
    """Adds the rotation matrix of (qw, qx, qy, qz) as prefix00 .. prefix22."""
    m = quaternion_to_matrix(*[F.col(c) for c in QUATERNION])
    return df.withColumns({f"{prefix}{i // 3}{i % 3}": m[i] for i in range(9)})


def quaternion(df: DataFrame, prefix: str = "r") -> DataFrame:
    """Adds (qw, qx, qy, qz) of the matrix prefix00 .. prefix22."""
    q = matrix_to_quaternion([F.col(f"{prefix}{i // 3}{i % 3}") for i in range(9)])
    return df.withColumns(dict(zip(QUATERNION, q, strict=True)))


def to_world(points: DataFrame, placed: DataFrame, key: str = "seq", time: str = "frame", calibration: np.ndarray | None = None) -> DataFrame:
    """Sensor points in the world: pose of the frame, after the fixed transform from the sensor (4 by 4, inverted once
    on the driver if given as world-to-sensor). Frames carry one row each, so they are joined by key and time."""
    # A crop of the result is a condition on the joined rows. Left to itself the optimizer would infer from it that each
    # coefficient is not null and push that, written out in full, below the interpolation; a struct keeps it one column.
    m = rotation(placed)
    names = [*(f"r{i}{k}" for i in range(3) for k in range(3)), *SHIFT]
    m = m.groupBy(key, time).agg(F.first(F.struct(*names)).alias("_m"))
    j = points.join(m, [key, time]).select(*points.columns, *[F.col(f"_m.{c}") for c in names])
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    if calibration is not None:
        c = np.linalg.inv(calibration)
        x, y, z = (float(c[i, 0]) * x + float(c[i, 1]) * y + float(c[i, 2]) * z + float(c[i, 3]) for i in range(3))
    out = [F.col(f"r{i}0") * x + F.col(f"r{i}1") * y + F.col(f"r{i}2") * z + F.col(SHIFT[i]) for i in range(3)]
    return j.withColumns({"wx": out[0], "wy": out[1], "wz": out[2]}).drop(*names)


def matrix_poses(poses: DataFrame) -> DataFrame:
    """Poses given as 16 numbers (column m, row by row) with quaternion and shift columns instead."""
    m = poses.select("*", *[F.col("m")[4 * i + j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.col("m")[4 * i + 3].alias(c) for i, c in enumerate(SHIFT)])
    return quaternion(m).drop("m", *[f"r{i}{j}" for i in range(3) for j in range(3)])
