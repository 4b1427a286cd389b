"""Paths: samples of edges, lengths, turns, stations by arc length, and what a map says along them.

A path is rows of (path_id, seq, x, y). Windows run within a path; everything else is joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import at_step, norm, turn


def edge_samples(edges: DataFrame, step: float, key: str = "edge_id") -> DataFrame:
    """key, i, x, y along each edge (x0, y0, x1, y1): max(2, ceil(length / step)) points with both ends, so that the
    spacing is length / (n - 1), wider than `step`."""
    n = F.greatest(F.lit(2), F.ceil(norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.lit(float(step))).cast("int"))
    e = edges.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    return e.select(key, "i", at_step(F.col("x0"), F.col("x1"), F.col("i"), F.col("_n")).alias("x"), at_step(F.col("y0"), F.col("y1"), F.col("i"), F.col("_n")).alias("y"))


def all_free(samples: DataFrame, threshold: float, key: str = "edge_id") -> DataFrame:
    """An edge is free if every sample's p is below the threshold."""
    return samples.groupBy(key).agg(F.bool_and(F.col("p") < threshold).alias("is_free"))


def edges_of(paths: DataFrame) -> DataFrame:
    """edge_id (path_id:seq), path_id, seq, x0, y0, x1, y1 of consecutive waypoints."""
    w = Window.partitionBy("path_id").orderBy("seq")
    e = paths.select("path_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).filter("x1 IS NOT NULL")
    return e.withColumn("edge_id", F.concat_ws(":", "path_id", "seq"))


def lengths(paths: DataFrame) -> DataFrame:
    """path_id, length: the sum of the segments; 0 for less than two points."""
    w = Window.partitionBy("path_id").orderBy("seq")
    s = paths.withColumn("_s", norm(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")))
    return s.groupBy("path_id").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length"))


def smoothness(paths: DataFrame, zero: str) -> DataFrame:
    """path_id, smoothness: the sum of turning angles.

    zero="floor": segment lengths are at least 1e-8, so a repeated point adds right angles; paths under three points
    have 0. zero="skip": pairs with a segment under 1e-9 are left out; paths under three points have null."""
    if zero not in ("floor", "skip"):
        raise ValueError("zero is floor or skip")
    w = Window.partitionBy("path_id").orderBy("seq")
    s = paths.select("path_id", "seq", (F.lead("x").over(w) - F.col("x")).alias("ax"), (F.lead("y").over(w) - F.col("y")).alias("ay"))
    s = s.select("*", F.lead("ax").over(w).alias("bx"), F.lead("ay").over(w).alias("by"))
    na, nb = norm(F.col("ax"), F.col("ay")), norm(F.col("bx"), F.col("by"))
    if zero == "floor":
        angle = turn(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.greatest(na, F.lit(1e-8)), F.greatest(nb, F.lit(1e-8)))
        return s.groupBy("path_id").agg(F.coalesce(F.sum(F.when(F.col("bx").isNotNull(), angle)), F.lit(0.0)).alias("smoothness"))
    angle = F.when((na >= 1e-9) & (nb >= 1e-9), turn(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), na, nb))
    return s.groupBy("path_id").agg(F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.sum(angle), F.lit(0.0))).alias("smoothness"))


def stations(paths: DataFrame, n: int) -> DataFrame:
    """path_id, station, x, y: n positions evenly spaced by arc length.

    Each segment makes the stations that fall on it, so waypoints and stations never meet in a join. A path of no
    length (under 1e-6) has none."""
    w = Window.partitionBy("path_id").orderBy("seq")
    s = paths.select("path_id", "seq", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    s = s.withColumn("seg", norm(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")))
    s = s.withColumn("at", F.coalesce(F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("total", F.sum("seg").over(Window.partitionBy("path_id"))).filter((F.col("seg") > 0) & (F.col("total") >= 1e-6))
    last = F.lead("at").over(w).isNull()
    step = F.col("total") / (n - 1)
    low = F.ceil(F.col("at") / step).cast("int")
    high = F.when(last, F.lit(n - 1)).otherwise(F.ceil((F.col("at") + F.col("seg")) / step).cast("int") - 1)
    s = s.withColumns({"_low": F.greatest(low, F.lit(0)), "_high": F.least(high, F.lit(n - 1)), "_step": step}).filter("_high >= _low")
    s = s.select("*", F.explode(F.sequence("_low", "_high")).alias("station"))
    part = F.least(F.greatest((F.col("station") * F.col("_step") - F.col("at")) / F.col("seg"), F.lit(0.0)), F.lit(1.0))
    return s.select("path_id", "station", (F.col("x") + part * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + part * (F.col("y1") - F.col("y"))).alias("y"))


def path_safety(scored: DataFrame, paths: DataFrame) -> DataFrame:
    """path_id, max_occ, mean_clearance from stations with p; a path without stations (no length) has 0 and 1."""
    a = scored.groupBy("path_id").agg(F.max("p").alias("max_occ"), F.avg(1 - F.col("p")).alias("mean_clearance"))
    return paths.select("path_id").distinct().join(a, "path_id", "left").select("path_id", F.coalesce("max_occ", F.lit(0.0)).alias("max_occ"), F.coalesce("mean_clearance", F.lit(1.0)).alias("mean_clearance"))


def mean_absolute_error(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.avg(F.abs(a - b)).alias("mae"), F.count(F.lit(1)).alias("n"))
