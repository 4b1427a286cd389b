from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.operators import planners as pl


def grid(rows: list[str], threshold: float = 0.5) -> pl.GridMap:
    p = np.array([[1.0 if c == "#" else 0.0 for c in r] for r in rows])
    return pl.GridMap(p, np.arange(p.shape[0], dtype=float), np.arange(p.shape[1], dtype=float), threshold)


def dijkstra(g: pl.GridMap, a, b) -> float | None:
    best, heap, free = {a: 0.0}, [(0.0, a)], g.free
    if not free[a] or not free[b]:
        return None
    while heap:
        d, u = heapq.heappop(heap)
        if u == b:
            return d
        for i, j, c in pl.MOVES:
            v = (u[0] + i, u[1] + j)
            if 0 <= v[0] < free.shape[0] and 0 <= v[1] < free.shape[1] and free[v] and d + c < best.get(v, math.inf) - 1e-12:
                best[v] = d + c
                heapq.heappush(heap, (d + c, v))
    return None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("..#", min_size=7, max_size=7), min_size=6, max_size=6))
def test_a_star_is_optimal(rows):
    g = grid(rows)
    path, info = pl.a_star(g, np.array([0.0, 0.0]), np.array([5.0, 6.0]))
    want = dijkstra(g, (0, 0), (5, 6))
    assert info["success"] == (want is not None)
    if want is not None:
        assert info["cost"] == pytest.approx(want) and path[0] == (0, 0) and path[-1] == (5, 6)
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:], strict=False))


def test_gap_corner_and_ends():
    assert pl.a_star(grid(["..........", "....#....."] * 5), np.zeros(2), np.array([9.0, 9.0]))[1]["success"]
    assert pl.a_star(grid([".#", "#."]), np.zeros(2), np.ones(2))[1]["cost"] == pytest.approx(math.sqrt(2))
    assert pl.a_star(grid(["#.", ".."]), np.zeros(2), np.ones(2))[1]["error"] == "start is occupied"
    path, info = pl.a_star(grid([".."]), np.zeros(2), np.zeros(2))
    assert path == [(0, 0)] and info["cost"] == 0


def test_edges_are_sampled_wider_than_the_step():
    """Of an edge twice the step long only the ends are tested."""
    g = grid([".....", "..#..", "....."])
    assert pl.edge_test(g, 2.0, 0.5)(np.array([1.0, 0.0]), np.array([1.0, 4.0]))
    assert not pl.edge_test(g, 0.5, 0.5)(np.array([1.0, 0.0]), np.array([1.0, 4.0]))


CONFIG = dict(step_size=1.0, max_iter=900, goal_radius=0.8, neighbor_radius=2.5, goal_bias=0.05, threshold=0.5, edge_step=0.1)


def test_rrt_star_paths_are_free():
    g = grid(["..........", "..........", "######.###", "..........", ".........."])
    free = pl.edge_test(g, 0.1, 0.5)
    path, info = pl.rrt_star(g, (0, 4, 0, 9), (0, 0), (4, 8), pl.RrtConfig(**CONFIG), np.random.default_rng(3))
    assert info["success"] and path[0] == (0, 0)
    assert all(free(np.array(a), np.array(b)) for a, b in zip(path, path[1:], strict=False))
    short = pl.smooth(path, free)
    length = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))
    assert length(short) <= length(path) + 1e-9 and short[0] == path[0] and short[-1] == path[-1]
    again, _ = pl.rrt_star(g, (0, 4, 0, 9), (0, 0), (4, 8), pl.RrtConfig(**CONFIG), np.random.default_rng(3))
    assert again == path


def test_rrt_star_reports_failures():
    g = grid(["...", "###", "..."])
    assert pl.rrt_star(g, (0, 2, 0, 2), (0, 0), (2, 2), pl.RrtConfig(**CONFIG | {"max_iter": 50}), np.random.default_rng(0))[1]["error"] == "no path"
    assert pl.rrt_star(g, (0, 2, 0, 2), (1, 1), (2, 2), pl.RrtConfig(**CONFIG), np.random.default_rng(0))[1] == {"success": False, "nodes": 0, "cost": None, "error": "start is occupied", "time_s": 0.0}


def test_user_collision_test():
    g = grid(["...."] * 4)
    path, _ = pl.rrt_star(g, (0, 3, 0, 3), (0, 0), (3, 3), pl.RrtConfig(**CONFIG), np.random.default_rng(1), collision=lambda a, b: b[0] >= b[1] - 1e-9)
    assert path and all(x >= y - 1e-9 for x, y in path)


def test_smoothing_takes_the_next_point_untested():
    assert pl.smooth([(0, 0), (1, 0), (2, 0)], lambda a, b: False) == [(0, 0), (1, 0), (2, 0)]
    assert pl.smooth([(0, 0), (1, 0), (2, 0)], lambda a, b: True) == [(0, 0), (2, 0)]
    assert pl.smooth(None, lambda a, b: True) is None


def test_mixture_map_equals_the_columns(spark):
    from gridlark.operators.mixture import with_occupancy

    m = pl.MixtureMap(np.array([0.3, 0.7]), np.array([[0.0, 0, 0], [1, 1, 0]]), np.array([[1.0, 2, 1], [0.5, 0.5, 1]]), 0.05, 10.0, 1.0, 0.1)
    gmm = spark.createDataFrame([(i, float(m.w[i]), *map(float, m.m[i]), *map(float, m.v[i])) for i in (0, 1)], "comp int, w double, mx double, my double, mz double, vx double, vy double, vz double")
    xy = np.random.default_rng(0).normal(size=(20, 2))
    p = spark.createDataFrame([(float(a), float(b), 0.1) for a, b in xy], "x double, y double, z double")
    ref = spark.createDataFrame([(0.05,)], "density_ref double")
    got = sorted(r["p"] for r in with_occupancy(p, gmm, ref, 10.0, 1.0).collect())
    assert np.allclose(got, sorted(m.value(xy)))


@pytest.mark.parametrize("mode", ["per_trial", "sequential"])
def test_trials_on_spark(spark, mode):
    from gridlark.session import ship

    ship(spark)
    g = grid(["......"] * 6)
    m = pl.MixtureMap(np.array([1.0]), np.array([[9.0, 9, 0]]), np.array([[0.1, 0.1, 0.1]]), 1.0, 10.0, 1.0, 0.0)
    pairs = spark.createDataFrame([("s", i, 0.0, 0.0, 5.0, float(i)) for i in range(4)], "scene string, trial long, sx double, sy double, gx double, gy double")
    out = pl.plan_trials(pairs, {"s": pl.Scene(g, m, 0.1)}, pl.RrtConfig(**CONFIG | {"max_iter": 200}), ("astar_grid", "rrt_mixture"), 42, mode).collect()
    assert len(out) == 8 and all(r["success"] for r in out if r["planner"] == "astar_grid")
    again = pl.plan_trials(pairs.repartition(3), {"s": pl.Scene(g, m, 0.1)}, pl.RrtConfig(**CONFIG | {"max_iter": 200}), ("astar_grid", "rrt_mixture"), 42, mode).collect()
    key = lambda r: (r["planner"], r["trial"], r["path"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_frontiers_that_are_not_settled_are_an_error(spark):
    free = spark.createDataFrame([(i, 0, True) for i in range(5)], "ix int, iy int, is_free boolean")
    pairs = spark.createDataFrame([(0, 0, 0, 4, 0)], "trial long, sx_i int, sy_i int, gx_i int, gy_i int")
    assert [r["cost"] for r in pl.frontier_costs(free, pairs).collect()] == [4.0]
    with pytest.raises(RuntimeError):
        pl.frontier_costs(free, pairs, rounds=2)


def test_users_planners_and_collision_tests(spark):
    g = grid(["......"] * 6)
    m = pl.MixtureMap(np.array([1.0]), np.array([[9.0, 9, 0]]), np.array([[0.1, 0.1, 0.1]]), 1.0, 10.0, 1.0, 0.0)
    pairs = spark.createDataFrame([("s", i, 0.0, 0.0, 5.0, 5.0, 100 + i) for i in range(2)], "scene string, trial long, sx double, sy double, gx double, gy double, seed long")
    straight = lambda scene, start, goal, config, rng, collision: ([start, goal], {"success": True, "nodes": 2, "cost": 1.0, "time_s": 0.0, "error": None})
    out = pl.plan_trials(pairs, {"s": pl.Scene(g, m, 0.1)}, pl.RrtConfig(**CONFIG | {"max_iter": 400}), {"line": straight, "rrt_grid": pl.PLANNERS["rrt_grid"]}, 0, collision=lambda scene: lambda a, b: bool(b[0] >= b[1] - 1e-9)).collect()
    by = {(r["planner"], r["trial"]): r for r in out}
    assert len(by["line", 0]["path"]) == 2
    assert all(x["x"] >= x["y"] - 1e-9 for k, r in by.items() if k[0] == "rrt_grid" and r["success"] for x in r["path"])
    path, _ = pl.rrt_star(g, (0, 5, 0, 5), (0, 0), (5, 5), pl.RrtConfig(**CONFIG | {"max_iter": 400}), np.random.default_rng(101), lambda a, b: bool(b[0] >= b[1] - 1e-9))
    assert (by["rrt_grid", 1]["path"] is None) == (path is None) and (path is None or [(p["x"], p["y"]) for p in by["rrt_grid", 1]["path"]] == path)


def test_drawn_pairs(spark):
    cells = spark.createDataFrame([(s, i, j, float(i), float(j)) for s in "ab" for i in range(6 if s == "a" else 2) for j in range(6)], "scene string, ix int, iy int, x double, y double")
    p = pl.sample_pairs(cells, 10, 2.0, 4.0, 7, ("scene",)).collect()
    assert sum(r["scene"] == "a" for r in p) == 10 and all(2 <= math.dist((r["sx"], r["sy"]), (r["gx"], r["gy"])) <= 4 for r in p)
    assert pl.sample_pairs(cells, 10, 50.0, 60.0, 7, ("scene",)).count() == 0
    t = pl.topped_up(pl.sample_pairs(cells.filter("scene = 'a'").limit(2), 3, 0.0, 9.0, 7), 8).collect()
    assert sorted(r["trial"] for r in t) == list(range(8))
