"""Cleaning point clouds: crops, attribute filters, thinning, projections, one point a voxel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import d, finite, inside, norm, voxel
from ..functions.names import fresh
from ..functions.ranking import hash_order, sample_exact

#: Attribute names as files spell them; the first that exists is used.
VISIBLE = ("is_visible", "isVisible", "visible")
SEMANTIC = ("semantic_id", "semanticID", "semantic")


def present(df: DataFrame, names: Sequence[str] | str) -> str | None:
    return next((n for n in ([names] if isinstance(names, str) else names) if n in df.columns), None)


def crop(df: DataFrame, box: Sequence[float] | None) -> DataFrame:
    """Inclusive at both ends; None keeps all."""
    return df if box is None else df.filter(inside(box))


def visible_only(df: DataFrame) -> DataFrame:
    """Points seen at least once; a table without the attribute passes whole."""
    c = present(df, VISIBLE)
    return df if c is None else df.filter(F.col(c) > 0)


def min_confidence(df: DataFrame, least: float | None) -> DataFrame:
    """NaN is no confidence: Spark would take it for more than any number."""
    c = present(df, "confidence")
    return df if c is None or least is None else df.filter(~F.isnan(c) & (F.col(c) >= least))


def by_semantic(df: DataFrame, keep: Sequence[int] | DataFrame | None = None, drop: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Semi and anti join with lists of semantic ids; lists go into the filter, tables are joined."""
    c = present(df, SEMANTIC)
    if c is None:
        return df
    for ids, kind in ((keep, "left_semi"), (drop, "left_anti")):
        if isinstance(ids, DataFrame):
            df = df.join(ids.select(F.col(ids.columns[0]).alias(c)), c, kind)
        elif ids is not None:
            df = df.filter(F.col(c).isin(*ids) if kind == "left_semi" else ~F.col(c).isin(*ids))
    return df


def first_per_voxel(df: DataFrame, size: float | None, order: Sequence[str]) -> DataFrame:
    """The first row of each voxel by `order`, with all its columns; no size (or none above 0) keeps all.

    A hash aggregate with map-side combine: dropDuplicates would keep any row, and a window would sort them all."""
    if size is None or size <= 0:
        return df
    key = [voxel(F.col(c), size).alias(f"_v{c}") for c in "xyz"]
    return df.groupBy(*key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_r")).select("_r.*")


def clean(df: DataFrame, order: Sequence[str], box=None, visible: bool = False, confidence: float | None = None, keep=None, drop=None, voxel_size: float | None = None) -> DataFrame:
    """All filters, then one point a voxel."""
    df = crop(df, box)
    df = visible_only(df) if visible else df
    return first_per_voxel(by_semantic(min_confidence(df, confidence), keep, drop), voxel_size, order)


def voxel_centroids(df: DataFrame, size: float, *more: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean position (and of `more` columns) of each voxel; voxels start at the least corner of the cloud, or of each
    group `by`."""
    low = df.groupBy(*by).agg(*[F.min(c).alias(f"_l{c}") for c in "xyz"])
    at = df.join(F.broadcast(low), list(by)) if by else df.join(F.broadcast(low))
    key = [F.floor((d(c) - F.col(f"_l{c}")) / F.lit(float(size))).alias(f"v{c}") for c in "xyz"]
    return at.groupBy(*by, *key).agg(*[F.avg(d(c)).alias(c) for c in ("x", "y", "z", *more)], F.count(F.lit(1)).alias("n"))


def bounds(df: DataFrame, padding: float = 0.0, *by: str) -> DataFrame:
    """Least and greatest of each axis, widened by `padding` times the extent at both ends."""
    b = df.groupBy(*by).agg(*[f(d(c)).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    wide = lambda c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * padding
    return b.select(*by, *[x for c in "xyz" for x in ((F.col(f"lo_{c}") - wide(c)).alias(f"lo_{c}"), (F.col(f"hi_{c}") + wide(c)).alias(f"hi_{c}"))])


def select_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in the given order; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.select(*names)


def project_xyz(df: DataFrame, xyz_only: bool = False, xyzrgb_only: bool = False) -> DataFrame:
    """Coordinates alone, or with those of the colours that exist; xyz_only wins."""
    if xyz_only:
        return select_fields(df, ["x", "y", "z"])
    return df.select(*[c for c in ("x", "y", "z", "red", "green", "blue") if c in df.columns]) if xyzrgb_only else df


def frames(df: DataFrame, first: int | None = None, last: int | None = None, stride: int = 1, frame: str = "frame") -> DataFrame:
    """Points of the frames in [first, last], of these every stride-th in order. Only distinct frames are ranked."""
    if first is not None:
        df = df.filter(F.col(frame) >= first)
    if last is not None:
        df = df.filter(F.col(frame) <= last)
    if stride <= 1:
        return df
    own = df.select(frame).distinct()
    kept = own.withColumn("_n", F.row_number().over(Window.orderBy(frame))).filter((F.col("_n") - 1) % stride == 0).select(frame)
    return df.join(kept, frame, "left_semi")


def every_nth(df: DataFrame, n: int, number: Column) -> DataFrame:
    """Every nth point of a scan by its number in the scan, from 0."""
    return df if n <= 1 else df.filter(number % n == 0)


def finite_points(df: DataFrame) -> DataFrame:
    return df.filter(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))


def in_range(df: DataFrame, least: float, most: float) -> DataFrame:
    """Distance from the sensor within [least, most], and all coordinates finite."""
    r = norm(d("x"), d("y"), d("z"))
    return finite_points(df).filter((r >= least) & (r <= most))


def narrowed(df: DataFrame) -> DataFrame:
    """Coordinates as floats, as stored."""
    return df.withColumns({c: F.col(c).cast("float") for c in "xyz"})


def in_bounds_or_all(df: DataFrame, box: DataFrame, more_than: int = 100) -> DataFrame:
    """Rows inside the box (one row of bounds()); all rows, if no more than `more_than` are inside."""
    j = df.join(F.broadcast(box))
    inside, many = fresh(j, "inside", "many")
    j = j.withColumn(inside, within(*"xyz"))
    n = j.agg(F.count_if(inside).alias(many))
    return j.join(F.broadcast(n)).filter(F.col(inside) | (F.col(many) <= more_than)).select(*df.columns)


def within(*axes: str) -> Column:
    """Whether a row lies in the box beside it (lo_x, hi_x, ...)."""
    ok = F.lit(True)
    for c in axes:
        ok = ok & d(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return ok


def inside_count(df: DataFrame, box: DataFrame) -> DataFrame:
    """n_inside, n: how many rows lie in the box, and of how many."""
    return df.join(F.broadcast(box)).agg(F.count_if(within(*"xyz")).alias("n_inside"), F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, n: int, seed: int | str, *key: str) -> DataFrame:
    """At most n points for a picture, by a seeded hash of the key columns."""
    return sample_exact(df, n, hash_order(*[F.col(k) for k in key], seed=seed), *key)
