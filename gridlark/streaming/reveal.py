"""Maps that grow with a stream: files of points arrive, each micro-batch is appended to what has been seen, and the
stage's map is fitted anew on all of it (a stage's result is that of a fresh fit, not of an updated one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mixture import GmmParams, fit
from ..operators.points import bounds


def reveal(spark: SparkSession, source: str, schema: str, seen: str, results: str, checkpoint: str, params: GmmParams, files_per_stage: int = 1) -> StreamingQuery:
    """Runs over the Parquet files in `source`, a stage for each batch of them, until none is left.

    `seen` holds the accumulated points by batch, `results` one row a stage (n_obs, components, log-likelihood, bounds).
    Both are partitioned by batch and a repeated batch overwrites its own part, so a restart after a failure neither
    loses nor doubles a stage."""

    def stage(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        own = spark.read.parquet(seen).filter(F.col("batch") <= number).select("pid", "x", "y", "z")
        model, history = fit(own.withColumn("scene", F.lit("stage")), params)
        out = bounds(own).withColumns({"n_obs": F.lit(own.count()), "components": F.lit(model.count()), "log_likelihood": F.lit(float(history["stage"][-1]))})
        out.coalesce(1).write.mode("overwrite").parquet(f"{results}/stage={number}")

    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_stage).parquet(source)
    return points.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
