"""Exact global ranks and samples without bringing a table to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import fresh

#: Leading hex digits of the hash that make a bucket: 65,536 buckets, whose counts are summed in order.
DIGITS = 4


def hash_order(*parts: Column, seed: int | str) -> Column:
    """A seeded pseudo-random order as 32 hex digits, equal in every engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def ranked(df: DataFrame, order: Column, *ties: str, name: str = "rank") -> DataFrame:
    """Adds the exact 1-based rank by a hex hash. Rows are sorted within buckets of the hash's leading digits; the
    buckets' first ranks come from running sums over their counts, at most 16 ** DIGITS rows."""
    h, bucket, n, first, r = fresh(df, "h", "bucket", "n", "first", "r")
    b = df.withColumn(h, order).withColumn(bucket, F.substring(h, 1, DIGITS))
    counts = b.groupBy(bucket).agg(F.count(F.lit(1)).alias(n))
    starts = counts.select(bucket, F.coalesce(F.sum(n).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(h, *ties))
    return b.withColumn(r, within).join(F.broadcast(starts), bucket).withColumn(name, F.col(first) + F.col(r)).select(*df.columns, name)


def sample_exact(df: DataFrame, n: int, order: Column, *ties: str) -> DataFrame:
    """Exactly min(n, rows) rows, the first by a hex hash."""
    (rank,) = fresh(df, "rank")
    return ranked(df, order, *ties, name=rank).filter(F.col(rank) <= n).drop(rank)


def sample_each(df: DataFrame, by: str, n: int, order: Column, *ties: str) -> DataFrame:
    """Exactly min(n, rows) rows of each group, the first by a hex hash. There are few groups (their counts go to the
    driver); of large ones the hash's leading digits first leave little more than n rows, which are then ranked."""
    h, rank = fresh(df, "h", "rank")
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    d = df.withColumn(h, order)
    keep = F.lit(True)
    for group, many in counts.items():
        share = (1.02 * n + 6 * n**0.5 + 100) / many
        if share < 1:
            keep = F.when(F.col(by).eqNullSafe(F.lit(group)), F.substring(h, 1, 8) <= f"{int(share * 16**8):08x}").otherwise(keep)
    r = F.row_number().over(Window.partitionBy(by).orderBy(h, *ties))
    return d.filter(keep).withColumn(rank, r).filter(F.col(rank) <= n).select(*df.columns)


#: first_rows() narrows tables of more than this many times the rows asked for.
NARROW = 20


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by a numeric column (ties in any order).

    A plain top-n would send n rows of every partition to one task. In large tables an approximate quantile, taken a
    little too high, first filters where they are: what remains is about n rows, and if the quantile came out too low
    after all, the plain form is used."""
    total = df.count()
    if total <= NARROW * n:
        return df.orderBy(order).limit(n)
    cut = df.agg(F.percentile_approx(order, F.lit(min(1.0, 1.2 * n / total + 2e-4)), F.lit(20_000))).first()[0]
    near = df.filter(F.col(order) <= F.lit(cut))
    return (near if near.count() >= n else df).orderBy(order).limit(n)
