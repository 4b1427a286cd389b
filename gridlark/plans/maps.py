"""Map building: fused windows cleaned and written, scenes fitted and their grids stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import hash_order, sample_each, sample_exact
from ..operators.mixture import FIELDS, GmmParams, fit_each, nav_slice, occupancy_grids, occupied_voxels, shrink, with_occupancy
from ..operators.points import bounds, clean, project_xyz, voxel_centroids
from ..sources.scans import register


def prepare_fused(spark: SparkSession, source: str, target: str, box=None, voxel_size=None, visible=False, confidence=None, keep=None, drop=None, xyz_only=False, xyzrgb_only=False, comments: Sequence[str] = ()) -> DataFrame:
    """Reads PLY windows, filters, keeps the first point of each voxel in file order, and writes PLY files in the order
    of the input's records."""
    register(spark)
    p = clean(spark.read.format("ply").load(source), ("pid",), box, visible, confidence, keep, drop, voxel_size)
    out = project_xyz(p.orderBy("pid").drop("pid"), xyz_only, xyzrgb_only)
    out.write.format("ply").mode("overwrite").option("comments", "\n".join(comments)).save(target)
    return p


def load_cloud(spark: SparkSession, path: str, voxel: float | None, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """A PLY cloud as (fit points, all points): coordinates as doubles, colours, where there are any, from 0 to 1. The
    fit points are the voxels' centroids (all points without a voxel size), at most `cap` of them by a seeded hash."""
    register(spark)
    df = spark.read.format("ply").load(path)
    rgb = [c for c in ("red", "green", "blue") if c in df.columns]
    cloud = df.select("pid", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[(F.col(c) / 255.0).alias(c) for c in rgb])
    own = voxel_centroids(cloud, voxel, *rgb).withColumn("pid", F.xxhash64("vx", "vy", "vz")).select(*cloud.columns) if voxel else cloud
    return sample_exact(own, cap, hash_order(F.col("pid"), seed=seed), "pid"), cloud


def load_map(spark: SparkSession, target: str, scene: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixture, reference density and grid of a trained scene."""
    return tuple(spark.read.parquet(f"{target}/{part}/scene={scene}") for part in ("gmm", "reference", "grid"))


def query_map(spark: SparkSession, target: str, scene: str, points: DataFrame, lam: float, power: float) -> DataFrame:
    """Occupancy p of points by a stored map."""
    gmm, reference, _ = load_map(spark, target, scene)
    return with_occupancy(points, gmm, reference, lam, power).drop("density")


def untrained(scenes: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes without a finished map."""
    return scenes.join(done.select("scene").distinct(), "scene", "left_anti")


def save_models(models: DataFrame, target: str) -> None:
    """Stores components and reference densities by scene; scenes that are there already are replaced, others stay. A
    scene without components has not been fitted: that is an error."""
    bad = models.filter("comp IS NULL").select("scene").first()
    if bad is not None or models.isEmpty():
        raise ValueError(f"not fitted: {bad['scene'] if bad else 'no scene'}")
    own = models.select("scene", "comp", *FIELDS), models.select("scene", "density_ref").distinct()
    for part, table in zip(("gmm", "reference"), own, strict=True):
        table.repartition("scene").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene").parquet(f"{target}/{part}")


def train(points: DataFrame, target: str, params: GmmParams, n: int, lam: float, power: float, cap: int, threshold: float, voxel: float | None = None, narrow: bool = False, sharpen: float | None = None, whole_bounds: bool = False) -> DataFrame:
    """Fits all scenes of `points` (scene, pid, x, y, z) in one job, each in a task, scores their grids in another, and
    stores mixture, reference density and grid by scene.

    At most `cap` points of a scene are fitted, a seeded exact sample; with `voxel`, of the voxels' centroids. `sharpen`
    shrinks the components after the reference density was taken. The grid spans the bounds of the fitted points (of
    all points with `whole_bounds`), widened by a tenth. Grids are stored as floats if `narrow`. Returns scene, free
    share, navigation slice and elapsed seconds (fit and grid), the quickest first; a scene that fails is reported with
    its error and leaves the others alone."""
    spark = points.sparkSession
    own = points.select("scene", "pid", "x", "y", "z")
    if voxel:
        own = voxel_centroids(own, voxel, by=("scene",)).withColumn("pid", F.xxhash64("vx", "vy", "vz")).select("scene", "pid", "x", "y", "z")
    own = sample_each(own, "scene", cap, hash_order(F.col("pid"), seed=params.seed), "pid").cache()
    fits = fit_each(own, params).cache()
    done = fits.filter("comp IS NOT NULL")
    if sharpen:
        done = shrink(done, sharpen)
    report = fits.groupBy("scene").agg(F.first("error").isNull().alias("ok"), F.first("error").alias("error"), F.first("seconds").alias("seconds"))
    if not done.isEmpty():
        save_models(done, target)
        references = done.select("scene", "density_ref").distinct()
        box = bounds(points.select("scene", "x", "y", "z") if whole_bounds else own, 0.1, "scene").join(F.broadcast(references), "scene", "left_semi")
        grid = occupancy_grids(box, done, references, n, lam, power).cache()
        stored = grid.drop("seconds").withColumn("p", F.col("p").cast("float")) if narrow else grid.drop("seconds")
        stored.repartition("scene").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene").parquet(f"{target}/grid")
        free = grid.groupBy("scene").agg(F.avg((F.col("p") < threshold).cast("double")).alias("free_share"), F.sum("seconds").alias("drawn"))
        report = report.join(free, "scene", "left").join(nav_slice(grid, threshold, "scene").select("scene", F.col("iz").alias("nav_iz")), "scene", "left")
    else:
        report = report.withColumns({"free_share": F.lit(None).cast("double"), "drawn": F.lit(None).cast("double"), "nav_iz": F.lit(None).cast("int")})
    rows = report.select("scene", "ok", "free_share", "nav_iz", (F.col("seconds") + F.coalesce("drawn", F.lit(0.0))).alias("elapsed_s"), "error").orderBy("elapsed_s", "scene").collect()
    own.unpersist()
    return spark.createDataFrame([tuple(r) for r in rows], "scene string, ok boolean, free_share double, nav_iz int, elapsed_s double, error string")


def trained(report: DataFrame) -> DataFrame:
    """n_ok, n: how many scenes were trained, and of how many."""
    return report.agg(F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("n"))


def export_occupied(grid: DataFrame, threshold: float, target: str) -> None:
    """Occupied cells as one coloured PLY file; nothing is written if there are none."""
    register(grid.sparkSession)
    cells = occupied_voxels(grid, threshold)
    if not cells.isEmpty():
        cells.coalesce(1).write.format("ply").mode("overwrite").save(target)
