from __future__ import annotations

import math

import numpy as np
import pytest

from gridlark.functions import geometry as g
from gridlark.operators import paths as pa
from gridlark.operators import poses as po

S = "path_id string, seq int, x double, y double"


def paths(spark, **ps):
    return spark.createDataFrame([(k, i, float(a), float(b)) for k, p in ps.items() for i, (a, b) in enumerate(p)], S)


def values(df, c):
    return {r["path_id"]: r[c] for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return paths(spark, one=[(0, 0)], two=[(0, 0), (3, 4)], line=[(0, 0), (1, 0), (2, 0)], right=[(0, 0), (1, 0), (1, 1)], back=[(0, 0), (1, 0), (0, 0)], repeated=[(0, 0), (1, 0), (1, 0), (2, 0)], still=[(1, 1), (1, 1), (1, 1)])


def test_lengths(odd):
    assert values(pa.lengths(odd), "length") == {"one": 0, "two": 5, "line": 2, "right": 2, "back": 2, "repeated": 2, "still": 0}


def test_smoothness_has_two_rules(odd):
    floor, skip = values(pa.smoothness(odd, "floor"), "smoothness"), values(pa.smoothness(odd, "skip"), "smoothness")
    assert floor["right"] == skip["right"] == pytest.approx(math.pi / 2) and floor["back"] == pytest.approx(math.pi)
    assert floor["repeated"] == pytest.approx(math.pi) and skip["repeated"] == 0
    assert floor["one"] == floor["two"] == 0 and skip["one"] is None and skip["two"] is None
    with pytest.raises(ValueError):
        pa.smoothness(odd, "other")


def test_stations_equal_interpolation(spark, odd):
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=(30, 2)), 0)
    df = odd.unionByName(paths(spark, walk=walk))
    got = pa.stations(df, 50).collect()
    own = sorted((r["station"], r["x"], r["y"]) for r in got if r["path_id"] == "walk")
    at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(walk, axis=0).T))])
    t = np.linspace(0, at[-1], 50)
    assert np.allclose([r[1:] for r in own], np.stack([np.interp(t, at, walk[:, i]) for i in (0, 1)], 1))
    assert {r["path_id"] for r in got} == {"two", "line", "right", "back", "repeated", "walk"}
    assert sum(r["path_id"] == "repeated" for r in got) == 50


def test_paths_without_length_are_safe(odd):
    scored = pa.stations(odd, 5).selectExpr("path_id", "0.4 AS p")
    got = {r["path_id"]: (r["max_occ"], r["mean_clearance"]) for r in pa.path_safety(scored, odd).collect()}
    assert got["still"] == (0, 1) and got["two"][0] == pytest.approx(0.4)


def test_edge_samples(spark):
    e = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 1.0, 0.0)], "edge_id string, x0 double, y0 double, x1 double, y1 double")
    got = pa.edge_samples(e, 0.3).collect()
    assert sorted(round(r["x"], 6) for r in got if r["edge_id"] == "b") == [0, 0.333333, 0.666667, 1] and sum(r["edge_id"] == "a" for r in got) == 2


def rotation(axis, angle):
    axis = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


@pytest.mark.parametrize(("axis", "angle"), [((0, 0, 1), 0.5), ((1, 0, 0), math.pi), ((0, 1, 0), math.pi), ((0, 0, 1), math.pi), ((1, 2, 3), 3.0), ((1, 1, 1), 0.0)])
def test_rotations_go_round(spark, axis, angle):
    m = rotation(axis, angle)
    df = spark.createDataFrame([tuple(map(float, m.ravel()))], ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    q = po.quaternion(df).drop(*df.columns)
    back = po.rotation(q).first()
    assert np.allclose([back[f"r{i}{j}"] for i in range(3) for j in range(3)], m.ravel(), atol=1e-9)


def pose(frame, angle, x, sign=1):
    return (0, frame, sign * math.cos(angle / 2), 0.0, 0.0, sign * math.sin(angle / 2), x, 0.0, 0.0)


POSE = "seq int, frame long, qw double, qx double, qy double, qz double, tx double, ty double, tz double"


def test_poses_between_and_outside(spark):
    poses = spark.createDataFrame([pose(2, 0, 0.0), pose(5, 1.2, 3.0, -1), pose(9, 1.2001, 3.0)], POSE)
    frames = spark.createDataFrame([(0, f) for f in (0, 2, 3, 5, 7, 9, 12)], "seq int, frame long")
    got = {r["frame"]: r for r in po.interpolated(frames, poses).collect()}
    assert sorted(got) == [0, 2, 3, 5, 7, 9, 12]
    angle = lambda f: 2 * math.atan2(abs(got[f]["qz"]), abs(got[f]["qw"]))
    assert angle(0) == 0 and got[0]["tx"] == 0 and angle(12) == pytest.approx(1.2001) and angle(3) == pytest.approx(0.4) and got[3]["tx"] == pytest.approx(1)
    assert angle(7) == pytest.approx(1.20005, abs=1e-6) and all(math.hypot(r["qw"], r["qx"], r["qy"], r["qz"]) == pytest.approx(1) for r in got.values())


def test_world_points_with_calibration(spark):
    poses = spark.createDataFrame([pose(1, math.pi / 2, 10.0)], POSE)
    points = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0)], "seq int, frame long, x double, y double, z double")
    c = np.eye(4)
    c[0, 3] = 2.0
    r = po.to_world(points, poses, calibration=c).first()
    assert (r["wx"], r["wy"], r["wz"]) == pytest.approx((10, -1, 0))


def test_slerp_columns(spark):
    from pyspark.sql import functions as F

    p, q = [F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)], [F.lit(x) for x in (math.cos(0.5), math.sin(0.5), 0.0, 0.0)]
    for t in (0.0, 0.25, 1.0):
        r = spark.range(1).select(*g.slerp(p, q, F.lit(t))).first()
        assert r[0] == pytest.approx(math.cos(0.5 * t)) and r[1] == pytest.approx(math.sin(0.5 * t))
