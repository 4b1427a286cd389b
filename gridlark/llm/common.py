"""What the operators of this subpackage share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import mapped as mapped, ship, tables_folder

#: White space of the word definition used throughout: [^\x20\x09-\x0D]+ is a word.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read by Spark (any file system Spark knows)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df`, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{tables_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, file: str, place: str) -> DataFrame:
    """`df` with two longs that together name each row, the same whenever the frame is read again: the row's file (by a
    hash of its path) and its place there, if `df` is a Parquet table as it was read; else a number written with it."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            m = df.metadataColumn("_metadata")
            return df.select("*", F.xxhash64(m["file_path"]).alias(file), m["row_index"].alias(place))
        except AnalysisException:  # a format whose files have no numbered rows
            pass
    return written(df.select("*", F.lit(0).cast("long").alias(file), F.monotonically_increasing_id().alias(place)), "rows")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(df: DataFrame, text: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(df[text].cast("string"), F.lit(""))
