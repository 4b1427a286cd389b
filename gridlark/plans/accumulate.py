"""Raw scans accumulated into one world cloud."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.points import crop, every_nth, first_per_voxel, frames, in_range
from ..operators.poses import interpolated, to_world


def accumulate(
    scans: DataFrame,
    poses: DataFrame,
    first: int | None = None,
    last: int | None = None,
    stride: int = 1,
    min_range: float = 0.0,
    max_range: float = float("inf"),
    every: int = 1,
    box: Sequence[float] | None = None,
    voxel_size: float | None = None,
    calibration: np.ndarray | None = None,
    frame_field: bool = False,
) -> DataFrame:
    """Scans (seq, frame, pid, x, y, z, ...) in the world: frame range and stride, thinning, range in the sensor's own
    frame, transform in doubles, crop in the world, floats, and then one point a voxel over all frames, the first by
    frame and pid. The order matters; the only shuffle of points is that of the voxels (poses are joined by frame)."""
    p = every_nth(frames(scans, first, last, stride), every, F.col("pid"))
    p = in_range(p, min_range, max_range)
    w = to_world(p, interpolated(p.select("seq", "frame"), poses), calibration=calibration)
    w = w.withColumns({c: F.col(f"w{c}") for c in "xyz"}).drop("wx", "wy", "wz")
    w = crop(w, box)
    w = w.withColumns({c: F.col(c).cast("float") for c in "xyz"})
    w = first_per_voxel(w, voxel_size, ("frame", "pid"))
    return w.withColumn("frame", F.col("frame").cast("int")) if frame_field else w
