"""Summaries of trials (scene, split, trial, planner, success, metric, time_s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def median(x: Column) -> Column:
    """Exact; NaN counts as missing, and the median of nothing is null."""
    return F.percentile(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.5))


def over_successes(x: str = "metric") -> Column:
    return F.when(F.col("success"), F.col(x))


def success_stats(trials: DataFrame, *by: str) -> DataFrame:
    """Rate, mean and population deviation over successes, and of the time over all trials."""
    m = over_successes()
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"), F.avg(F.col("success").cast("double")).alias("rate"),
        F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.avg("time_s").alias("time_mean"), F.stddev_pop("time_s").alias("time_std"),
    )


def medians(trials: DataFrame, *by: str) -> DataFrame:
    return trials.groupBy(*by).agg(F.avg(F.col("success").cast("double")).alias("rate"), median(over_successes()).alias("med"), median(F.col("time_s")).alias("time_med"))


def split_rollup(trials: DataFrame) -> DataFrame:
    """Of each split: mean of the scenes' rates, median of the scenes' medians."""
    return medians(trials, "split", "scene", "planner").groupBy("split", "planner").agg(F.avg("rate").alias("mean_rate"), median(F.col("med")).alias("med_of_med"))


def heatmap(trials: DataFrame) -> DataFrame:
    """split ('all' for both), planner, median over scenes of the scene medians: one grouping-set aggregate."""
    return medians(trials, "split", "scene", "planner").groupingSets([["split", "planner"], ["planner"]], "split", "planner").agg(median(F.col("med")).alias("med"), F.grouping("split").alias("_g")).select(F.when(F.col("_g") == 1, "all").otherwise(F.col("split")).alias("split"), "planner", "med")


def heatmap_means(trials: DataFrame) -> DataFrame:
    """split, mean over planners of the heat map's row."""
    return heatmap(trials).groupBy("split").agg(F.avg("med").alias("mean"))


def value_lists(trials: DataFrame, *by: str) -> DataFrame:
    """The values of a box plot in order, with their median: a list a group, as long as it has successful trials."""
    return trials.groupBy(*by).agg(F.array_sort(F.collect_list(over_successes())).alias("metrics"), median(over_successes()).alias("med"))


def top_advantage(trials: DataFrame, better: str, worse: str, n: int = 2) -> DataFrame:
    """The n scenes with the largest ratio worse / max(better, 1e-6) of medians; scenes without one last."""
    m = medians(trials, "scene", "planner").groupBy("scene").pivot("planner", [better, worse]).agg(F.first("med"))
    a, b = F.col(f"`{worse}`"), F.col(f"`{better}`")
    return m.select("scene", F.when(b.isNotNull(), a / F.greatest(b, F.lit(1e-6))).alias("advantage")).orderBy(F.desc_nulls_last("advantage"), "scene").limit(n)


def first_success(trials: DataFrame) -> DataFrame:
    """The first successful trial of each scene and planner, with its metric; scenes without one are absent."""
    return trials.filter("success").groupBy("scene", "planner").agg(F.min("trial").alias("trial"), F.min_by("metric", "trial").alias("metric"))


def joint_trials(trials: DataFrame, n: int) -> DataFrame:
    """The first n slots of each scene in which all planners succeeded; a slot is a trial's place in its planner's order."""
    w = Window.partitionBy("scene", "planner").orderBy("trial")
    s = trials.withColumn("slot", F.row_number().over(w)).groupBy("scene", "slot").agg(F.bool_and("success").alias("ok"), F.count(F.lit(1)).alias("planners"))
    own = F.row_number().over(Window.partitionBy("scene").orderBy("slot"))
    return s.filter("ok").withColumn("_n", own).filter(F.col("_n") <= n).select("scene", "slot", "planners")
