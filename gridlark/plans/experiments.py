"""The evaluations: planners on one map, and maps that grow in stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import d, grid_index, occupancy
from ..functions.ranking import hash_order, sample_exact
from ..operators.mixture import GmmParams, fit_each, nav_slice, occupancy_grids, with_density_bulk, with_occupancy
from ..operators.paths import lengths, path_safety, smoothness, stations
from ..operators.planners import MixtureMap, RrtConfig, Scene, free_in_both, grid_of, plan_trials, sample_pairs
from ..operators.points import within
from ..operators.stages import query_box, staged
from ..operators.stats import median, split_rollup, top_advantage

PLANNERS = ("rrt_mixture", "rrt_grid", "astar_mixture", "astar_grid")
#: Positions along a path at which its safety is measured.
STATIONS = 300

#: Scores positions (x, y): adds p.
Score = Callable[[DataFrame], DataFrame]


def scene_table(spark: SparkSession, scenes: Sequence[tuple[str, str, str]]) -> DataFrame:
    """label, folder, split of the scenes of an evaluation."""
    return spark.createDataFrame(list(scenes), "label string, folder string, split string")


def mixture_score(gmm: DataFrame, reference: DataFrame, lam: float, power: float, z: float) -> Score:
    """Occupancy by one scene's mixture on the plane z."""
    return lambda df: with_occupancy(df.withColumn("z", F.lit(float(z))), gmm, reference, lam, power).drop("density", "z")


def exploded(plans: DataFrame, path: str) -> DataFrame:
    return plans.filter("success").select(F.concat_ws("/", "scene", "planner", "trial").alias("path_id"), F.posexplode(path).alias("seq", "p")).select("path_id", "seq", "p.x", "p.y")


def trial_metrics(plans: DataFrame, score: Score | None = None, at: str = "stations", zero: str = "floor") -> DataFrame:
    """One row a trial and planner, metrics null where it failed: length and turns of the path as planned and as
    smoothed, and, with a score, the largest occupancy and the mean clearance of the smoothed path. at: "stations" even
    along the path, or its "waypoints" alone. zero: the rule for segments without length, see smoothness()."""
    out = plans.withColumn("path_id", F.concat_ws("/", "scene", "planner", "trial"))
    for path, tag in (("path", "raw"), ("smoothed", "smooth")):
        p = exploded(plans, path)
        out = out.join(lengths(p).withColumnRenamed("length", f"{tag}_length"), "path_id", "left").join(smoothness(p, zero).withColumnRenamed("smoothness", f"{tag}_turns"), "path_id", "left")
    if score is not None:
        p = exploded(plans, "smoothed")
        out = out.join(path_safety(score(stations(p, STATIONS) if at == "stations" else p), p), "path_id", "left")
    return out.drop("path_id")


def summary(metrics: DataFrame, *by: str, score: bool = False) -> DataFrame:
    """by, planner: trials, success rate, and medians over successes (of the time over all trials)."""
    kept = ("raw_length", "smooth_length", "raw_turns", "smooth_turns", *(("max_occ", "mean_clearance") if score else ()))
    return metrics.groupBy(*by, "planner").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("double")).alias("rate"), *[median(F.col(c)).alias(c) for c in kept], median(F.col("time_s")).alias("time_med"))


def compare_planners(pairs: DataFrame, scenes: dict[str, Scene], rrt: RrtConfig, seed: int, planners: Sequence[str] = PLANNERS, score: Score | None = None, smooth_by: str = "own", timed: str = "plan") -> DataFrame:
    """scene, planner: success rate and medians. Plans are computed once and cached."""
    plans = plan_trials(pairs, scenes, rrt, tuple(planners), seed, smooth_by=smooth_by, timed=timed).cache()
    return summary(trial_metrics(plans, score), "scene", score=score is not None)


#: The scenes of the published evaluation: label, the window's folder, split.
SCENES = (
    ("0000a", "2013_05_28_drive_0000_sync_0000000002_0000000385_clean", "train"),
    ("0000b", "2013_05_28_drive_0000_sync_0000000834_0000001286_clean", "train"),
    ("0002", "2013_05_28_drive_0002_sync_0000004391_0000004625_clean", "train"),
    ("0003", "2013_05_28_drive_0003_sync_0000000002_0000000282_clean", "train"),
    ("0004", "2013_05_28_drive_0004_sync_0000002897_0000003118_clean", "train"),
    ("0005", "2013_05_28_drive_0005_sync_0000000002_0000000357_clean", "train"),
    ("0006", "2013_05_28_drive_0006_sync_0000000002_0000000403_clean", "train"),
    ("0007", "2013_05_28_drive_0007_sync_0000000002_0000000125_clean", "train"),
    ("0009", "2013_05_28_drive_0009_sync_0000000002_0000000292_clean", "test"),
    ("0010", "2013_05_28_drive_0010_sync_0000000002_0000000208_clean", "test"),
)


@dataclass
class Evaluation:
    """What evaluate_scenes() found: a row for each trial and planner; for each scene and planner; for each split and
    planner; and the scenes with the largest advantage."""

    trials: DataFrame
    scenes: DataFrame
    splits: DataFrame
    top: DataFrame


def evaluate_scenes(scenes: DataFrame, models: DataFrame, references: DataFrame, grids: DataFrame, rrt: RrtConfig, seed: int, trials: int, least: float, most: float, lam: float, power: float, edge_step: float, planners: Sequence[str] = PLANNERS) -> Evaluation:
    """All planners on all scenes (label, folder, split) in one plan. `models` (components), `references` (density_ref)
    and `grids` (cells with p) have a column scene, which is the scenes' folder.

    Each scene's navigation slice gives its free cells; trials run between those that are free by the model, too. The
    driver holds a slice and the components of each scene. Roll-ups: free shares, rates and medians by scene, by split
    the mean of rates and the median of medians, and the two scenes with the largest ratio of turns between the plain
    grid search and the tree on the mixture."""
    names = scenes.select(F.col("folder").alias("scene"), "label", "split")
    own = grids.join(F.broadcast(names.select("scene")), "scene", "left_semi")
    nav = nav_slice(own, rrt.threshold, "scene").select("scene", "iz")
    planes = own.join(F.broadcast(nav), ["scene", "iz"]).select("scene", "ix", "iy", "x", "y", "z", "p").cache()
    scored = with_density_bulk(planes, models, by="scene").join(F.broadcast(references.select("scene", "density_ref")), "scene")
    scored = scored.withColumns({"p_model": occupancy(F.col("density"), F.col("density_ref"), lam, power), "is_free": F.col("p") < rrt.threshold}).drop("density", "density_ref")
    pairs = sample_pairs(free_in_both(scored, "p_model", rrt.threshold), trials, least, most, seed, ("scene",))
    pairs = pairs.withColumn("trial", F.row_number().over(Window.partitionBy("scene").orderBy("h")))
    refs = {r["scene"]: r["density_ref"] for r in references.collect()}
    held, comps = planes.toPandas(), models.orderBy("scene", "comp").toPandas()
    maps = {}
    for scene, t in held.groupby("scene"):
        c = comps[comps.scene == scene]
        z = float(t.z.iloc[0])
        maps[scene] = Scene(grid_of(t, rrt.threshold), MixtureMap(c.w.to_numpy(float), c[["mx", "my", "mz"]].to_numpy(float), c[["vx", "vy", "vz"]].to_numpy(float), refs[scene], lam, power, z), edge_step)
    heights = planes.groupBy("scene").agg(F.first("z").alias("z"))
    plans = plan_trials(pairs, maps, rrt, tuple(planners), seed).cache()

    def score(df: DataFrame) -> DataFrame:
        d = df.withColumn("scene", F.split_part("path_id", F.lit("/"), F.lit(1))).join(F.broadcast(heights), "scene")
        d = with_density_bulk(d, models, by="scene").join(F.broadcast(references.select("scene", "density_ref")), "scene")
        return d.withColumn("p", occupancy(F.col("density"), F.col("density_ref"), lam, power)).drop("density", "density_ref", "z", "scene")

    m = trial_metrics(plans, score).join(F.broadcast(names), "scene")
    free = scored.groupBy("scene").agg((F.avg(F.col("is_free").cast("double")) * 100).alias("free_pct"), (F.avg((F.col("p_model") < rrt.threshold).cast("double")) * 100).alias("model_free_pct"))
    by_scene = summary(m, "scene", "label", "split", score=True).join(F.broadcast(free), "scene")
    turns = m.withColumnRenamed("raw_turns", "metric")
    return Evaluation(m, by_scene, split_rollup(turns), top_advantage(turns, "rrt_mixture", "astar_grid"))


def incremental(
    points: DataFrame, fractions: Sequence[float], components: int, max_iter: int, cells: int, queries: int, lam: float, power: float, seed: int, z_band: float,
    pairs: DataFrame | None = None, rrt: RrtConfig | None = None, z: float | None = None, edge_step: float | None = None, cap: int = 40_000, truth_cap: int = 200_000,
) -> DataFrame:
    """stage, fraction, n_obs, update_s_gmm, update_s_grid, gmm_mae, grid_mae: at each stage a fresh fit on at most `cap`
    of the points seen so far (a seeded sample), compared on held-out positions with a fit on all points (at most
    `truth_cap`). The grid spans all points seen, widened by a tenth; positions outside it are left out, unless no more
    than 100 are inside. update_s_gmm is the time of the fit, update_s_grid adds the time that scoring the grid took.

    With pairs (trial, sx, sy, gx, gy) trees on the stage's mixture (gmm_...) and on its grid (grid_...) plan them, each
    trial with the seed seed + 1000 * stage + trial: success rates, and medians over successes of the turns and of the
    largest occupancy at the waypoints by the fit on all points. The grid is cut at the height z (None: the middle).

    All stages are one plan: their fits one job, their grids another, their trials a third."""
    spark, stages = points.sparkSession, len(fractions)
    s = staged(points.select("pid", *[d(c).alias(c) for c in "xyz"]), "pid", seed, fractions).cache()
    name = lambda i: F.concat(F.lit("stage-"), F.lpad(i.cast("string"), 3, "0"))
    per = s.groupBy("first_stage").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))]).toPandas().set_index("first_stage").reindex(range(stages))
    seen = per.n.fillna(0).cumsum().astype(int).tolist()
    raw = pd.DataFrame({c: per[c].cummin() if c.startswith("lo") else per[c].cummax() for c in per.columns if c != "n"}).ffill()
    wide = raw.copy()
    for c in "xyz":
        pad = (raw[f"hi_{c}"] - raw[f"lo_{c}"]) * 0.1
        wide[f"lo_{c}"], wide[f"hi_{c}"] = raw[f"lo_{c}"] - pad, raw[f"hi_{c}"] + pad
    sides = [f"{e}_{c}" for c in "xyz" for e in ("lo", "hi")]
    boxes = spark.createDataFrame([(f"stage-{i:03d}", *map(float, wide.loc[i, sides])) for i in range(stages)], "scene string, " + ", ".join(f"{c} double" for c in sides))
    # One row for each point and stage that may sample it: a hash by stage thins large stages before they are ranked.
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.col("pid").cast("string")))
    share = F.element_at(F.array(*[F.lit(min(1.0, (1.02 * cap + 6 * cap**0.5 + 100) / max(1, n))) for n in seen]), F.col("i") + 1)
    e = s.select("*", F.explode(F.sequence("first_stage", F.lit(stages - 1))).alias("i")).withColumn("h", h).filter(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) <= share)
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy("i").orderBy("h", "pid"))).filter(F.col("nth") <= cap)
    truth_points = sample_exact(s, truth_cap, hash_order(F.col("pid"), seed=seed), "pid")
    work = e.select(name(F.col("i")).alias("scene"), "pid", "x", "y", "z").unionByName(truth_points.select(F.lit("truth").alias("scene"), "pid", "x", "y", "z"))
    models = fit_each(work, GmmParams(components, max_iter=max_iter, seed=seed), seeds={f"stage-{i:03d}": seed + i for i in range(stages)} | {"truth": seed}).cache()
    fits = models.toPandas()
    if len(bad := fits[fits.error.notna()]):
        raise ValueError(f"{bad.scene.iloc[0]}: {bad.error.iloc[0]}")
    references = models.select("scene", "density_ref").distinct()
    took = fits.groupby("scene").seconds.first()
    grids = occupancy_grids(boxes, models.filter("scene != 'truth'"), references, cells, lam, power).cache()
    drawn = grids.groupBy("scene").agg(F.sum("seconds").alias("s")).toPandas().set_index("scene").s

    truth, ref = models.filter("scene = 'truth'").drop("scene"), references.filter("scene = 'truth'").select("density_ref")
    whole = boxes.filter(F.col("scene") == f"stage-{stages - 1:03d}").drop("scene")
    q = with_occupancy(query_box(spark, queries, whole, seed, z_band, z), truth, ref, lam, power, "truth").drop("density")
    held = q.join(F.broadcast(boxes)).withColumn("inside", within(*"xyz"))
    held = held.withColumn("many", F.count_if("inside").over(Window.partitionBy("scene"))).filter(F.col("inside") | (F.col("many") <= 100))
    step = lambda c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (cells - 1)
    held = held.withColumns({f"i{c}": grid_index(d(c), F.col(f"lo_{c}"), step(c), cells) for c in "xyz"}).select("scene", "qid", "x", "y", "z", "truth", "ix", "iy", "iz")
    both = with_density_bulk(held, models, by="scene").join(F.broadcast(references), "scene").withColumn("gmm", occupancy(F.col("density"), F.col("density_ref"), lam, power))
    both = both.join(grids.select("scene", "ix", "iy", "iz", F.col("p").alias("cell")), ["scene", "ix", "iy", "iz"])
    error = {r["scene"]: r for r in both.groupBy("scene").agg(F.avg(F.abs(F.col("gmm") - F.col("truth"))).alias("gmm"), F.avg(F.abs(F.col("cell") - F.col("truth"))).alias("cell")).collect()}
    rows = []
    for i, f in enumerate(fractions):
        k = f"stage-{i:03d}"
        mae = [float(error[k][c]) if k in error and error[k][c] is not None else None for c in ("gmm", "cell")]
        rows.append([i, float(f), seen[i], float(took[k]), float(took[k] + drawn[k]), *mae])
    names, more = ("success", "max_occ", "turns"), ""
    if pairs is not None and rrt is not None:
        height = F.lit(float(z)) if z is not None else (F.col("lo_z") + F.col("hi_z")) / 2
        cut = boxes.select("scene", grid_index(height, F.col("lo_z"), step("z"), cells).alias("iz"), height.alias("height"))
        planes = grids.join(F.broadcast(cut), ["scene", "iz"]).select("scene", "ix", "iy", "x", "y", "p", "height").toPandas()
        last = wide.loc[stages - 1]
        area = tuple(float(last[c]) for c in ("lo_x", "hi_x", "lo_y", "hi_y"))
        scenes = {}
        for k, t in planes.groupby("scene"):
            c = fits[fits.scene == k].sort_values("comp")
            mix = MixtureMap(c.w.to_numpy(float), c[["mx", "my", "mz"]].to_numpy(float), c[["vx", "vy", "vz"]].to_numpy(float), float(c.density_ref.iloc[0]), lam, power, float(t.height.iloc[0]))
            scenes[k] = Scene(grid_of(t, rrt.threshold), mix, edge_step or rrt.edge_step, area)
        tried = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(stages - 1)))).select(name(F.col("i")).alias("scene"), "trial", "sx", "sy", "gx", "gy", (F.lit(seed) + 1000 * F.col("i") + F.col("trial")).cast("long").alias("seed"))
        plans = plan_trials(tried, scenes, rrt, ("rrt_mixture", "rrt_grid"), seed).cache()
        flat = float(z) if z is not None else float((last["lo_z"] + last["hi_z"]) / 2)
        m = trial_metrics(plans, mixture_score(truth, ref, lam, power, flat), "waypoints", "skip").groupBy("scene", "planner").agg(F.avg(F.col("success").cast("double")).alias("success"), median(F.when(F.col("success"), F.col("max_occ"))).alias("max_occ"), median(F.col("smooth_turns")).alias("turns"))
        by = {(r["scene"], r["planner"]): r for r in m.collect()}
        for i, row in enumerate(rows):
            row += [by[f"stage-{i:03d}", p][c] for p in ("rrt_mixture", "rrt_grid") for c in names]
        more = "".join(f", {p}_{c} double" for p in ("gmm", "grid") for c in names)
        plans.unpersist()
    for t in (grids, models, s):
        t.unpersist()
    return spark.createDataFrame([tuple(r) for r in rows], "stage int, fraction double, n_obs long, update_s_gmm double, update_s_grid double, gmm_mae double, grid_mae double" + more)
