from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlark.functions import geometry as g
from gridlark.functions.ranking import first_rows, hash_order, ranked, sample_exact
from gridlark.operators import points as pt

SCHEMA = "pid long, x double, y double, z double, semantic int"
coordinate = st.floats(-5, 5, allow_nan=False).map(lambda v: round(v, 2))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(coordinate, coordinate, coordinate, st.integers(0, 4)), max_size=40), size=st.sampled_from([0.5, 1.0, 3.0]))
def test_voxels_keep_their_first_point(spark, rows, size):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    want: dict = {}
    for i, r in enumerate(rows):
        want.setdefault(tuple(math.floor(v / size) for v in r[:3]), i)
    once = pt.first_per_voxel(df, size, ("pid",))
    assert sorted(r["pid"] for r in once.collect()) == sorted(want.values())
    assert pt.first_per_voxel(once, size, ("pid",)).count() == len(want)


def test_no_voxel_size_keeps_all(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1), (2, 0.0, 0.0, 0.0, 1)], SCHEMA)
    assert pt.first_per_voxel(df, None, ("pid",)).count() == pt.first_per_voxel(df, 0, ("pid",)).count() == 2


def test_negative_coordinates_floor(spark):
    df = spark.createDataFrame([(1, -0.1, 0.0, 0.0, 1), (2, 0.1, 0.0, 0.0, 1), (3, -1.0, 0.0, 0.0, 1)], SCHEMA)
    assert sorted(r["pid"] for r in pt.first_per_voxel(df, 1.0, ("pid",)).collect()) == [1, 2]


def test_crop_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1), (2, 1.0, 1.0, 1.0, 1), (3, 1.0001, 1.0, 1.0, 1)], SCHEMA)
    assert [r["pid"] for r in pt.crop(df, (0, 1, 0, 1, 0, 1)).orderBy("pid").collect()] == [1, 2]
    with pytest.raises(ValueError):
        pt.crop(df, (1, 0, 0, 1, 0, 1))


def test_absent_attributes_filter_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    assert pt.clean(df, ("pid",), visible=True, confidence=0.5, keep=(1,), drop=(2,)).count() == 1


def test_both_spellings_are_known(spark):
    for name in pt.SEMANTIC:
        df = spark.createDataFrame([(1, 7), (2, 8)], f"pid long, {name} int")
        assert pt.by_semantic(df, keep=(7,)).first()["pid"] == 1
    df = spark.createDataFrame([(1, 0), (2, 3)], "pid long, isVisible int")
    assert pt.visible_only(df).first()["pid"] == 2


def test_nan_confidence_is_none(spark):
    df = spark.createDataFrame([(1, math.nan), (2, 0.9), (3, 0.1)], "pid long, confidence double")
    assert [r["pid"] for r in pt.min_confidence(df, 0.5).collect()] == [2]


def test_half_goes_to_even(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, -9.0, 99.0)], "v double")
    got = [r[0] for r in df.select(g.grid_index(F.col("v"), F.lit(0.0), F.lit(1.0), 4)).collect()]
    assert got == [0, 2, 2, 0, 3]


def test_missing_field_is_an_error(spark):
    with pytest.raises(ValueError):
        pt.select_fields(spark.range(1), ["id", "nope"])


def test_xyz_wins_over_colours(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4, 5)], "x double, y double, z double, red int, semantic int")
    assert pt.project_xyz(df, True, True).columns == ["x", "y", "z"]
    assert pt.project_xyz(df, False, True).columns == ["x", "y", "z", "red"]


def test_ranks_are_exact(spark):
    df = spark.range(3000)
    got = ranked(df, hash_order(F.col("id"), seed=3), "id").collect()
    import hashlib

    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
    assert {r["id"]: r["rank"] for r in got} == {i: n + 1 for n, i in enumerate(order)}
    assert sample_exact(df, 17, hash_order(F.col("id"), seed=3), "id").count() == 17
    assert sample_exact(df, 9999, hash_order(F.col("id"), seed=3), "id").count() == 3000


@pytest.mark.parametrize("n", [50, 101])
def test_fallback_depends_on_the_count(spark, n):
    df = spark.range(300).select("id", *[F.col("id").cast("double").alias(c) for c in "xyz"])
    box = pt.bounds(df.filter(F.col("id") < n))
    assert pt.in_bounds_or_all(df, box).count() == (n if n > 100 else 300)


def test_sequence_names(spark):
    df = spark.createDataFrame([("3",), ("2013_05_28_drive_0010_sync",)], "s string")
    assert [r[0] for r in df.select(g.sequence_name(F.col("s"))).collect()] == ["2013_05_28_drive_0003_sync", "2013_05_28_drive_0010_sync"]


def test_filters_reach_the_scan(spark):
    from gridlark.views import points

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = pt.crop(points(spark, "/root/testdata/sf0.001"), (5, 60, 5, 40, 1, 9)).select("x", "y")
    plan = p._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_quantity,5.0)" in plan and "LessThanOrEqual(l_quantity,40.0)" in plan
    assert "l_returnflag" not in plan and "Exchange" not in plan


def test_first_rows(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("id")).repartition(5)
    assert sorted(r["id"] for r in first_rows(df, "id", 30).collect()) == list(range(30))
    assert first_rows(df, "id", 40_000).count() == 40_000
