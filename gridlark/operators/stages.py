"""Incremental mapping: cumulative prefixes of a seeded order, and what each stage's map says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.ranking import hash_order, ranked

#: Shares of all points that the eleven stages have seen.
FRACTIONS = (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)


def staged(df: DataFrame, key: str, seed: int | str, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Adds `first_stage`, the first stage (from 0) that sees the row: stage s sees the first max(1, int(f * N)) rows
    of the seeded order. Stages are cumulative, so one number a row tells all; nothing is multiplied by stages."""
    rank, many = fresh(df, "rank", "many")
    r = ranked(df, hash_order(F.col(key), seed=seed), key, name=rank)
    n = df.agg(F.count(F.lit(1)).alias(many))
    r = r.join(F.broadcast(n))
    stage = F.lit(len(fractions))
    for s in reversed(range(len(fractions))):
        upto = F.greatest(F.lit(1), (F.lit(float(fractions[s])) * F.col(many)).cast("long"))
        stage = F.when(F.col(rank) <= upto, F.lit(s)).otherwise(stage)
    return r.withColumn("first_stage", stage).filter(F.col("first_stage") < len(fractions)).drop(rank, many)


def prefix_stats(df: DataFrame, value: str, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """stage, fraction, n_obs, total, least, most of `value` over each cumulative prefix: one aggregate by first stage,
    then running sums over as many rows as there are stages."""
    from pyspark.sql.window import Window

    per = df.groupBy("first_stage").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.min(value).alias("a"), F.max(value).alias("b"))
    spark = df.sparkSession
    stages = spark.createDataFrame([(i, float(f)) for i, f in enumerate(fractions)], "first_stage int, fraction double")
    j = stages.join(per, "first_stage", "left")
    w = Window.orderBy("first_stage")
    return j.select(F.col("first_stage").alias("stage"), "fraction", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_obs"), F.sum("s").over(w).alias("total"), F.min("a").over(w).alias("least"), F.max("b").over(w).alias("most"))


def query_box(spark, n: int, box: DataFrame, seed: int | str, z_band: float, z: float | None = None) -> DataFrame:
    """n held-out positions, uniform in the box's x and y and within z_band of the height z (None: the box's middle), by
    seeded hashes."""
    part = lambda c: F.conv(F.substring(hash_order(F.col("id"), F.lit(c), seed=seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    q = spark.range(n).join(F.broadcast(box))
    at = lambda c: F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * part(c)
    z = ((F.col("lo_z") + F.col("hi_z")) / 2 if z is None else F.lit(float(z))) + (part("z") * 2 - 1) * z_band
    return q.select(F.col("id").alias("qid"), at("x").alias("x"), at("y").alias("y"), z.alias("z"))
