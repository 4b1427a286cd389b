from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import geometry as g
from gridlark.operators import mixture as mx

COMP = "comp int, w double, mx double, my double, mz double, vx double, vy double, vz double"


def model(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], COMP)


def test_density_of_one_component(spark):
    p = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    got = mx.with_density(p, model(spark, (1, 0, 2, 1, 4, 1, 9))).first()["density"]
    assert got == pytest.approx(np.exp(-0.5 * (1 / 4 + 0 + 4 / 9)) / np.sqrt((2 * np.pi) ** 3 * 36))


def test_density_far_away_stays_finite(spark):
    p = spark.createDataFrame([(1e4, 0.0, 0.0)], "x double, y double, z double")
    m = model(spark, (0.5, 0, 0, 0, 1, 1, 1), (0.5, 1, 1, 1, 1, 1, 1), (0.0, 0, 0, 0, 1, 1, 1))
    assert mx.with_density(p, m).first()["density"] == 0.0


def test_forms_agree(spark):
    """The fold over an array equals the cross join with a grouped log-sum-exp."""
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(50, 3)))], "pid long, x double, y double, z double")
    m = model(spark, *[(0.25, *rng.normal(size=3), *(rng.random(3) + 0.1)) for _ in range(4)])
    lp = F.log("w") - ((F.col("x") - F.col("mx")) ** 2 / F.col("vx") + (F.col("y") - F.col("my")) ** 2 / F.col("vy") + (F.col("z") - F.col("mz")) ** 2 / F.col("vz") + F.log(F.col("vx") * F.col("vy") * F.col("vz")) + 3 * np.log(2 * np.pi)) / 2
    joined = {r["pid"]: r["d"] for r in p.crossJoin(m).groupBy("pid").agg(F.sum(F.exp(lp)).alias("d")).collect()}
    folded = {r["pid"]: r["density"] for r in mx.with_density(p, m).collect()}
    assert all(folded[k] == pytest.approx(v, rel=1e-9) for k, v in joined.items())


def test_bulk_scores_agree(spark):
    from gridlark.session import ship

    ship(spark)
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, *map(float, v + [1e5, 0, 0])) for i, v in enumerate(rng.normal(size=(60, 3)) * 3)], "pid long, x double, y double, z double")
    m = model(spark, *[(0.2, 1e5 + rng.normal(), *rng.normal(size=2), *(rng.random(3) + 0.1)) for _ in range(4)], (0, 0, 0, 0, 1, 1, 1))
    a, b = ({r["pid"]: r["density"] for r in f(p, m).collect()} for f in (mx.with_density, mx.with_density_bulk))
    assert all(b[k] == pytest.approx(v, rel=1e-6, abs=1e-12) for k, v in a.items())


def test_grids_equal_the_fold(spark):
    from gridlark.operators.points import bounds

    p = spark.range(50).select(F.col("id").alias("pid"), *[(F.col("id") % k).cast("double").alias(c) for k, c in ((7, "x"), (5, "y"), (3, "z"))])
    m, ref = model(spark, (0.5, 1, 1, 1, 1, 2, 1), (0.5, 4, 3, 2, 1, 1, 1)), spark.createDataFrame([(0.02,)], "density_ref double")
    small = {tuple(r[c] for c in ("ix", "iy", "iz")): r["p"] for r in mx.with_occupancy(mx.lattice(bounds(p, 0.1), 6), m, ref, 10.0, 1.0).collect()}
    large = mx.occupancy_grid(bounds(p, 0.1), m, ref, 6, 10.0, 1.0)
    assert large.columns == ["ix", "iy", "iz", "x", "y", "z", "p"]
    assert all(small[tuple(r)[:3]] == pytest.approx(r["p"], abs=1e-9) for r in large.collect())


def test_occupancy_is_bounded_and_monotone(spark):
    d = spark.createDataFrame([(float(v),) for v in (-1, 0, 1e-9, 0.1, 1, 50)], "d double")
    got = [r[0] for r in d.select(g.occupancy(F.col("d"), 0.5, 10.0, 2.0)).collect()]
    assert got == sorted(got) and got[0] == got[1] == 0 and got[-1] <= 1


def test_shrinking(spark):
    m = model(spark, (1, 0, 0, 0, 4, 4, 4))
    assert mx.shrink(m, 0.5).first()["vx"] == 1.0
    with pytest.raises(ValueError):
        mx.shrink(m, 0)


def test_first_slice_wins_ties(spark):
    grid = spark.createDataFrame([(0, 0, z, p) for z, p in ((0, 0.1), (1, 0.9), (2, 0.9))], "ix int, iy int, iz int, p double")
    assert mx.nav_slice(grid, 0.35).first()["iz"] == 1


def numpy_em(x, w, m, v, reg, rounds):
    lls = []
    for _ in range(rounds):
        lp = np.log(w) - 0.5 * (np.log(v).sum(1) + 3 * np.log(2 * np.pi)) - 0.5 * (((x[:, None] - m) ** 2) / v).sum(2)
        top = lp.max(1, keepdims=True)
        ll = top[:, 0] + np.log(np.exp(lp - top).sum(1))
        r = np.exp(lp - ll[:, None])
        n = r.sum(0)
        m = r.T @ x / n[:, None]
        v = np.stack([(r[:, k, None] * (x - m[k]) ** 2).sum(0) / n[k] for k in range(len(n))]) + reg
        w = n / n.sum()
        lls.append(ll.mean())
    return w, m, v, lls


def test_fit_recovers_components_in_world_coordinates(spark):
    """Two scenes far from the origin in one job; the likelihood does not fall, and steps equal numpy's."""
    rng = np.random.default_rng(1)
    centres = {"a": np.array([[1e5, 2e5, 10], [1e5 + 8, 2e5, 10]]), "b": np.array([[0.0, 0, 0], [0, 9, 0]])}
    rows = [(s, i * 2 + k, *map(float, c[k] + rng.normal(size=3))) for s, c in centres.items() for i in range(400) for k in (0, 1)]
    p = spark.createDataFrame(rows, "scene string, pid long, x double, y double, z double").repartition(3)
    got, history = mx.fit(p, mx.GmmParams(2, max_iter=30, seed=4))
    for s, c in centres.items():
        assert all(b >= a - 1e-6 for a, b in zip(history[s], history[s][1:], strict=False))
        own = sorted((r for r in got.filter(F.col("scene") == s).collect()), key=lambda r: (r["mx"], r["my"]))
        assert np.allclose([[r["mx"], r["my"], r["mz"]] for r in own], c, atol=0.2)
        x = np.array([r[2:] for r in rows if r[0] == s])
        w, m, v, _ = numpy_em(x, *(np.array([[r[k] for k in ks] for r in own]) if len(ks) > 1 else np.array([r[ks[0]] for r in own]) for ks in (("w",), ("mx", "my", "mz"), ("vx", "vy", "vz"))), 1e-4, 1)
        assert np.allclose(m, [[r["mx"], r["my"], r["mz"]] for r in own], atol=0.02) and np.allclose(v, [[r["vx"], r["vy"], r["vz"]] for r in own], atol=0.05)


def test_no_row_for_point_and_component(spark):
    p = spark.range(10).select(F.col("id").alias("pid"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
    plan = mx.with_density(p, model(spark, (1, 0, 0, 0, 1, 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan
