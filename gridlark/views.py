"""The driver's tables as inputs of the spatial operators, and the same views as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that order points: unique, so that survivors and prefixes are defined.
POINT_ORDER = ("ok", "ln", "pk", "sk", "x")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("z"),
        F.col("l_linenumber").alias("semantic_id"), (F.col("l_returnflag") != "N").cast("int").alias("is_visible"), (1 - F.col("l_tax") * 10).alias("confidence"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("frame"),
    )


def qpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], F.col("label"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component a label: share, means and variances (an M step from the labels as responsibilities)."""
    q = qpoints(spark, sf_dir)
    n = q.select(F.count(F.lit(1)).alias("n"))
    stats = q.groupBy(F.col("label").alias("comp")).agg(F.count(F.lit(1)).alias("c"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[(F.var_pop(c) + F.lit(1e-4)).alias(f"v{c}") for c in "xyz"])
    return stats.join(F.broadcast(n)).select("comp", (F.col("c") / F.col("n")).alias("w"), "mx", "my", "mz", "vx", "vy", "vz")


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us")
    start = F.first("us").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return e.select(F.col("user_id").alias("path_id"), F.row_number().over(w).alias("seq"), ((F.col("us") - start) / F.lit(3.6e9)).alias("x"), F.col("value").alias("y"))


#: Sequences into which events are dealt; poses and probes of one sequence meet.
SEQUENCES = 8


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signup events as poses of their sequence: frame (microseconds), unit quaternion about a tilted axis, translation."""
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    half = F.col("value") / 100
    return e.select(
        (F.col("user_id") % SEQUENCES).alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("frame"),
        F.cos(half).alias("qw"), (F.sin(half) / 3).alias("qx"), (F.sin(half) * 2 / 3).alias("qy"), (F.sin(half) * 2 / 3).alias("qz"),
        F.col("value").alias("tx"), (F.col("user_id") * F.lit(1.0)).alias("ty"), (F.col("value") / 2).alias("tz"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other events as scan points of their sequence's frames."""
    e = table(spark, sf_dir, "events").filter("event_type != 'signup'")
    return e.select((F.col("user_id") % SEQUENCES).alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("frame"), F.col("event_id").alias("pid"), F.col("value").alias("x"), (F.col("value") / 3).alias("y"), (F.col("event_id") % 7 * F.lit(1.0)).alias("z"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("planner"), (F.col("o_orderstatus") != "P").alias("success"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("metric"),
        (F.col("o_totalprice") / 1000).alias("time_s"), F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("o_custkey") % 10).cast("int").alias("scene"),
    )


#: The same views in DuckDB SQL; each holds those it needs.
SQL = {
    "points": """points AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 AS z,
  l_linenumber AS semantic_id, (l_returnflag <> 'N')::INTEGER AS is_visible, 1 - l_tax * 10 AS confidence, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INTEGER AS frame FROM lineitem)""",
    "qpoints": "qpoints AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)",
    "gmm": """gmm AS (SELECT label AS comp, count(*)::DOUBLE / (SELECT count(*) FROM qpoints) AS w, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
  var_pop(x) + 1e-4::DOUBLE AS vx, var_pop(y) + 1e-4::DOUBLE AS vy, var_pop(z) + 1e-4::DOUBLE AS vz FROM qpoints GROUP BY label)""",
    "path_pts": """path_pts AS (SELECT user_id AS path_id, row_number() OVER w AS seq, (epoch_us(ts) - first(epoch_us(ts)) OVER w) / 3.6e9::DOUBLE AS x, value AS y
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts)))""",
    "poses": """poses AS (SELECT user_id % 8 AS seq, epoch_us(ts) AS frame, cos(value / 100) AS qw, sin(value / 100) / 3 AS qx, sin(value / 100) * 2 / 3 AS qy, sin(value / 100) * 2 / 3 AS qz,
  value AS tx, user_id * 1.0::DOUBLE AS ty, value / 2 AS tz FROM events WHERE event_type = 'signup')""",
    "probes": "probes AS (SELECT user_id % 8 AS seq, epoch_us(ts) AS frame, event_id AS pid, value AS x, value / 3 AS y, (event_id % 7)::DOUBLE AS z FROM events WHERE event_type <> 'signup')",
    "trials": """trials AS (SELECT o_orderkey AS trial, o_orderpriority AS planner, o_orderstatus <> 'P' AS success, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS metric, o_totalprice / 1000 AS time_s,
  CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, (o_custkey % 10)::INTEGER AS scene FROM orders)""",
}


def sql(*views: str) -> str:
    return "WITH " + ",\n".join(SQL[v] for v in views)
