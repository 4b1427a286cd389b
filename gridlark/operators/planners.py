"""Planners over occupancy maps. A search is sequential within one trial, so trials are what Spark distributes: each
task takes batches of trials and plans them one by one with numpy, the scene's map sent along once."""

from __future__ import annotations

import heapq
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import hash_order
from ..session import checkpoint_folder, ship

Edge = Callable[[np.ndarray, np.ndarray], bool]


@dataclass
class GridMap:
    """Cell values of one slice with their axes; a cell is free below the threshold."""

    p: np.ndarray
    xs: np.ndarray
    ys: np.ndarray
    threshold: float

    @property
    def step(self) -> tuple[float, float]:
        return tuple((a[-1] - a[0]) / (len(a) - 1) if len(a) > 1 else 1.0 for a in (self.xs, self.ys))

    @property
    def free(self) -> np.ndarray:
        return self.p < self.threshold

    def cells(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cells (half to even), clamped at the border."""
        out = []
        for axis, a in enumerate((self.xs, self.ys)):
            out.append(np.clip(np.rint((xy[..., axis] - a[0]) / self.step[axis]), 0, len(a) - 1).astype(int))
        return out[0], out[1]

    def value(self, xy: np.ndarray) -> np.ndarray:
        return self.p[self.cells(np.asarray(xy, float))]


@dataclass
class MixtureMap:
    """Occupancy of a mixture on the plane z."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    reference: float
    lam: float
    power: float
    z: float

    def value(self, xy: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.asarray(xy, float), np.full((*np.shape(xy)[:-1], 1), self.z)], -1)
        lp = np.log(self.w) - 0.5 * (np.log(self.v).sum(1) + 3 * math.log(2 * math.pi) + (((x[..., None, :] - self.m) ** 2) / self.v).sum(-1))
        top = lp.max(-1, keepdims=True)
        dens = np.exp(top[..., 0]) * np.exp(lp - top).sum(-1)
        return 1 - np.exp(-self.lam * np.clip(dens / (self.reference + 1e-12), 0, None) ** self.power)


def edge_test(map_: GridMap | MixtureMap, step: float, threshold: float) -> Edge:
    """An edge is free if all its samples are; samples as in edge_samples()."""

    def free(a: np.ndarray, b: np.ndarray) -> bool:
        n = max(2, math.ceil(float(np.hypot(*(b - a))) / step))
        t = np.linspace(0, 1, n)[:, None]
        return bool((map_.value(a + t * (b - a)) < threshold).all())

    return free


# --- A* -------------------------------------------------------------------------------------------------------------

MOVES = [(i, j, math.sqrt(2) if i and j else 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def a_star(grid: GridMap, start: np.ndarray, goal: np.ndarray) -> tuple[list[tuple[float, float]] | None, dict]:
    """Shortest 8-connected walk between the cells of start and goal; corners may be cut. The path has cell centres.
    cost is in metres: the cost in cells times the mean cell side.

    Cells are numbered row by row in a map with an occupied border, so a move is an addition and never leaves the map;
    the distances still to go are computed for all cells at once."""
    began, wide = time.perf_counter(), grid.p.shape[1] + 2
    rows, columns = grid.cells(np.array([start, goal], float))
    first, last = ((rows + 1) * wide + columns + 1).tolist()
    passable = np.pad(grid.free, 1).ravel().tolist()
    info = {"success": False, "nodes": 0, "cost": None, "error": None}
    for name, cell in (("start", first), ("goal", last)):
        if not passable[cell]:
            return None, info | {"time_s": time.perf_counter() - began, "error": f"{name} is occupied"}
    across = np.abs(np.arange(len(grid.xs) + 2) - (rows[1] + 1))[:, None]
    along = np.abs(np.arange(wide) - (columns[1] + 1))[None]
    to_go = (across + along + (math.sqrt(2) - 2) * np.minimum(across, along)).ravel().tolist()
    cost, back = [math.inf] * len(passable), [-1] * len(passable)
    moves = [(i * wide + j, c) for i, j, c in MOVES]
    cost[first] = 0.0
    queue, expanded = [(to_go[first], 0.0, first)], 0
    while queue:
        _, g, cell = heapq.heappop(queue)
        if g > cost[cell] or not passable[cell]:  # a cheaper way was found since, or the cell is done
            continue
        expanded += 1
        if cell == last:
            walk = [cell]
            while back[walk[-1]] >= 0:
                walk.append(back[walk[-1]])
            path = [(float(grid.xs[c // wide - 1]), float(grid.ys[c % wide - 1])) for c in reversed(walk)]
            return path, info | {"success": True, "nodes": expanded, "cost": g * sum(grid.step) / 2, "time_s": time.perf_counter() - began}
        passable[cell] = False
        for step, c in moves:
            near = cell + step
            if passable[near] and g + c < cost[near]:
                cost[near], back[near] = g + c, cell
                heapq.heappush(queue, (g + c + to_go[near], g + c, near))
    return None, info | {"nodes": expanded, "time_s": time.perf_counter() - began, "error": "no path"}


# --- RRT* -----------------------------------------------------------------------------------------------------------


@dataclass
class RrtConfig:
    step_size: float
    max_iter: int
    goal_radius: float
    neighbor_radius: float
    goal_bias: float
    threshold: float
    edge_step: float
    #: New nodes become visible to searches for neighbours in batches of this many.
    snapshot: int = 20


def rrt_star(map_: GridMap | MixtureMap, box: tuple[float, float, float, float], start, goal, config: RrtConfig, rng: np.random.Generator, collision: Edge | None = None):
    """Asymptotically better trees: every iteration samples (the goal with probability goal_bias), steers from the
    nearest visible node, and, where that edge is free, connects to the cheapest visible neighbour and rewires the
    others. Costs are not passed on to descendants, and the goal is served by the node that was cheapest when it was
    inserted; the exact goal is appended if it is more than 1 cm away and reachable."""
    began = time.perf_counter()
    start, goal = np.asarray(start, float), np.asarray(goal, float)
    free = collision or edge_test(map_, config.edge_step, config.threshold)
    info = {"success": False, "nodes": 0, "cost": None, "error": None}
    for name, end in (("start", start), ("goal", goal)):
        if not free(end, end):
            return None, info | {"time_s": 0.0, "error": f"{name} is occupied"}
    at = np.empty((config.max_iter + 1, 2))
    cost, parent = np.zeros(config.max_iter + 1), np.full(config.max_iter + 1, -1)
    at[0], n, seen, best, best_cost = start, 1, 1, -1, math.inf
    low, high = np.array([box[0], box[2]]), np.array([box[1], box[3]])
    for _ in range(config.max_iter):
        aim = goal if rng.random() < config.goal_bias else rng.uniform(low, high)
        if n - seen >= config.snapshot:
            seen = n
        away = np.hypot(*(at[:seen] - aim).T)
        near = int(away.argmin())
        far = float(away[near])
        new = aim if far <= config.step_size else at[near] + (aim - at[near]) * (config.step_size / far)
        if not free(at[near], new):
            continue
        gap = np.hypot(*(at[:seen] - new).T)
        around = np.flatnonzero(gap <= config.neighbor_radius)
        up, total = near, cost[near] + float(np.hypot(*(new - at[near])))
        for k in around:
            if cost[k] + gap[k] < total and free(at[k], new):
                up, total = int(k), float(cost[k] + gap[k])
        at[n], cost[n], parent[n] = new, total, up
        for k in around:
            if total + gap[k] < cost[k] and free(new, at[k]):
                parent[k], cost[k] = n, total + gap[k]
        if float(np.hypot(*(new - goal))) <= config.goal_radius and total < best_cost:
            best, best_cost = n, total
        n += 1
    if best < 0:
        return None, info | {"nodes": n, "time_s": time.perf_counter() - began, "error": "no path"}
    chain = [best]
    while parent[chain[-1]] >= 0:
        chain.append(int(parent[chain[-1]]))
    path = [tuple(map(float, at[k])) for k in reversed(chain)]
    if np.hypot(*(at[best] - goal)) > 0.01 and free(at[best], goal):
        path.append(tuple(map(float, goal)))
    return path, info | {"success": True, "nodes": n, "cost": float(best_cost), "time_s": time.perf_counter() - began}


def smooth(path: list[tuple[float, float]] | None, free: Edge) -> list[tuple[float, float]] | None:
    """From each waypoint on to the farthest one that can be reached directly; the next one is taken untested."""
    if path is None or len(path) < 3:
        return path
    p, out, i = np.asarray(path, float), [path[0]], 0
    while i < len(path) - 1:
        j = len(path) - 1
        while j > i + 1 and not free(p[i], p[j]):
            j -= 1
        out.append(path[j])
        i = j
    return out


# --- On Spark -------------------------------------------------------------------------------------------------------

PLAN_SCHEMA = "scene string, trial long, planner string, success boolean, nodes int, cost double, time_s double, error string, path array<struct<x:double,y:double>>, smoothed array<struct<x:double,y:double>>"


@dataclass
class Scene:
    """What a trial needs: maps (as many numbers as the map has cells and components), how densely edges are sampled,
    and where trees may grow (None: the grid's extent)."""

    grid: GridMap
    mixture: MixtureMap
    edge_step: float
    box: tuple[float, float, float, float] | None = None

    @cached_property
    def mixture_grid(self) -> GridMap:
        """The mixture's values at the grid's cells, made once in a process."""
        g = self.grid
        return GridMap(self.mixture.value(np.stack(np.meshgrid(g.xs, g.ys, indexing="ij"), -1)), g.xs, g.ys, g.threshold)


#: Plans one trial: path and info, and the edge test that smooths it (None: that of the planner's own map).
Planner = Callable[[Scene, tuple, tuple, RrtConfig, np.random.Generator, Edge | None], tuple[list | None, dict]]


def _rrt(map_of: Callable[[Scene], GridMap | MixtureMap]) -> Planner:
    def plan(scene, start, goal, config, rng, collision):
        box = scene.box or (scene.grid.xs[0], scene.grid.xs[-1], scene.grid.ys[0], scene.grid.ys[-1])
        return rrt_star(map_of(scene), box, start, goal, config, rng, collision)

    return plan


def _a_star(grid_of: Callable[[Scene], GridMap]) -> Planner:
    return lambda scene, start, goal, config, rng, collision: a_star(grid_of(scene), np.array(start), np.array(goal))


PLANNERS: dict[str, Planner] = {
    "rrt_mixture": _rrt(lambda s: s.mixture),
    "rrt_grid": _rrt(lambda s: s.grid),
    "astar_mixture": _a_star(lambda s: s.mixture_grid),
    "astar_grid": _a_star(lambda s: s.grid),
}


def grid_from(free: DataFrame, threshold: float) -> GridMap:
    """A slice (ix, iy, x, y, p) as a map for the planners: one map, of a size set by its resolution."""
    return grid_of(free.select("ix", "iy", "x", "y", "p").toPandas(), threshold)


def grid_of(t: pd.DataFrame, threshold: float) -> GridMap:
    p = np.full((t.ix.max() + 1, t.iy.max() + 1), np.inf)
    p[t.ix, t.iy] = t.p
    return GridMap(p, t.groupby("ix").x.first().sort_index().to_numpy(), t.groupby("iy").y.first().sort_index().to_numpy(), threshold)


def mixture_from(gmm: DataFrame, reference: float, lam: float, power: float, z: float) -> MixtureMap:
    t = gmm.orderBy("comp").toPandas()
    return MixtureMap(t.w.to_numpy(float), t[["mx", "my", "mz"]].to_numpy(float), t[["vx", "vy", "vz"]].to_numpy(float), reference, lam, power, z)


def plan_trials(
    pairs: DataFrame, scenes: dict[str, Scene], rrt: RrtConfig, planners: Sequence[str] | dict[str, Planner], seed: int, mode: str = "per_trial", smooth_by: str = "own", timed: str = "plan",
    collision: Callable[[Scene], Edge] | None = None,
) -> DataFrame:
    """Plans every pair (scene, trial, sx, sy, gx, gy) with every planner, by name from PLANNERS or given as functions.

    mode="per_trial": each trial has its own generator (the row's `seed`, or else seed + trial), so trials are
    independent rows and spread over all tasks. mode="sequential": one generator a scene and planner runs through its
    trials in order, which ties them to one task. smooth_by: "own" smooths with the planner's map, "mixture" always with
    the mixture. timed: "plan", or "all" for the time with smoothing. collision: makes a scene's edge test, which trees
    and smoothing then use in place of their maps'."""
    ship(pairs.sparkSession)
    sent = pairs.sparkSession.sparkContext.broadcast(scenes)
    conf, table = asdict(rrt), planners if isinstance(planners, dict) else {p: PLANNERS[p] for p in planners}
    if mode not in ("per_trial", "sequential"):
        raise ValueError("mode is per_trial or sequential")

    def one(row, rng: np.random.Generator) -> tuple:
        s, config = sent.value[row.scene], RrtConfig(**conf)
        own = collision(s) if collision else None
        path, info = table[row.planner](s, (row.sx, row.sy), (row.gx, row.gy), config, rng, own)
        free = own or edge_test(s.mixture if smooth_by == "mixture" or not row.planner.endswith("grid") else s.grid, s.edge_step, config.threshold)
        began = time.perf_counter()
        smoothed = smooth(path, free)
        if timed == "all":
            info["time_s"] += time.perf_counter() - began
        points = lambda ps: None if ps is None else [{"x": float(x), "y": float(y)} for x, y in ps]
        return (row.scene, row.trial, row.planner, info["success"], info["nodes"], info["cost"], info["time_s"], info["error"], points(path), points(smoothed))

    columns = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame([one(r, np.random.default_rng(int(r.seed))) for r in b.itertuples()], columns=columns)

    def group(b: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        return pd.DataFrame([one(r, rng) for r in b.sort_values("trial").itertuples()], columns=columns)

    own_seed = F.col("seed").cast("long") if "seed" in pairs.columns else F.lit(seed) + F.col("trial").cast("long")
    work = pairs.select("scene", F.col("trial").cast("long").alias("trial"), "sx", "sy", "gx", "gy", own_seed.alias("seed"), F.explode(F.array(*map(F.lit, table))).alias("planner"))
    if mode == "sequential":
        return work.groupBy("scene", "planner").applyInPandas(group, PLAN_SCHEMA)
    spread = work.repartition(max(1, pairs.sparkSession.sparkContext.defaultParallelism), "scene", "trial", "planner")
    return spread.mapInPandas(batches, PLAN_SCHEMA)


#: Draws for each pair that is wanted.
ATTEMPTS = 500


def free_in_both(free: DataFrame, p: str, threshold: float) -> DataFrame:
    """The free cells of a map whose occupancy `p` by the model is below the threshold, too."""
    return free.filter(F.col("is_free") & (F.col(p) < threshold))


def sample_pairs(cells: DataFrame, n: int, least: float, most: float, seed: int | str, by: Sequence[str] = ()) -> DataFrame:
    """n pairs of the cells (ix, iy, x, y) whose distance is in [least, most], for each group `by`: of ATTEMPTS * n seeded
    draws of two cells the first n that fit; fewer, if so many draws hold fewer. `h` is the draw's number.

    What is numbered are the cells of a map, as many as its resolution; no pairs are made but those drawn."""
    whole = Window.partitionBy(*by)
    c = cells.select(*by, "ix", "iy", "x", "y", (F.row_number().over(whole.orderBy("ix", "iy")) - 1).alias("k"), F.count(F.lit(1)).over(whole).alias("m"))
    groups = c.groupBy(*by).agg(F.max("m").alias("m")).filter("m IS NOT NULL")
    draw = lambda end: (F.conv(F.substring(hash_order(F.col("h"), F.lit(end), seed=seed), 1, 8), 16, 10).cast("long") % F.col("m")).cast("int")
    draws = groups.select(*by, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ATTEMPTS * n - 1).cast("long"))).alias("h")).select(*by, "h", draw("a").alias("i"), draw("b").alias("j"))
    start = c.select(*by, F.col("k").alias("i"), F.col("ix").alias("sx_i"), F.col("iy").alias("sy_i"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    goal = c.select(*by, F.col("k").alias("j"), F.col("ix").alias("gx_i"), F.col("iy").alias("gy_i"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    far = F.sqrt((F.col("sx") - F.col("gx")) * (F.col("sx") - F.col("gx")) + (F.col("sy") - F.col("gy")) * (F.col("sy") - F.col("gy")))
    fit = draws.join(start, [*by, "i"]).join(goal, [*by, "j"]).filter(far.between(least, most)).drop("i", "j")
    return fit.withColumn("nth", F.row_number().over(whole.orderBy("h"))).filter(F.col("nth") <= n).drop("nth")


def topped_up(pairs: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """trial 0 .. n-1 of each group: its pairs in their order, repeated from the first if there are too few."""
    whole = Window.partitionBy(*by)
    p = pairs.withColumns({"k": F.row_number().over(whole.orderBy("h")) - 1, "m": F.count(F.lit(1)).over(whole)})
    times = F.sequence(F.col("k").cast("long"), F.lit(n - 1).cast("long"), F.col("m").cast("long"))
    return p.filter(F.col("k") < n).withColumn("trial", F.explode(times)).drop("k", "m", "h")


def frontier_costs(free: DataFrame, pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Cheapest costs by relaxing frontiers as joins (a check of the planner on small maps): trial, cost in cells; null
    if the goal is not reachable. Each round joins the frontier with the eight moves and keeps improvements; rounds
    are checkpointed to the shared folder. It goes on until nothing improves; if `rounds` are given and run out before,
    that is an error."""
    spark = free.sparkSession
    checkpoint_folder(spark)
    cells = free.filter("is_free").select("ix", "iy")
    moves = spark.createDataFrame([(i, j, c) for i, j, c in MOVES], "di int, dj int, c double")
    known = pairs.join(cells, (F.col("sx_i") == F.col("ix")) & (F.col("sy_i") == F.col("iy"))).select("trial", "ix", "iy", F.lit(0.0).alias("g")).checkpoint()
    frontier, done = known, 0
    while True:
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"costs not settled after {rounds} rounds")
        done += 1
        step = frontier.crossJoin(F.broadcast(moves)).select("trial", (F.col("ix") + F.col("di")).alias("ix"), (F.col("iy") + F.col("dj")).alias("iy"), (F.col("g") + F.col("c")).alias("g")).join(cells, ["ix", "iy"], "left_semi").groupBy("trial", "ix", "iy").agg(F.min("g").alias("g"))
        old = known.withColumnRenamed("g", "old")
        frontier = step.join(old, ["trial", "ix", "iy"], "left").filter("old IS NULL OR g < old - 1e-9").select("trial", "ix", "iy", "g").checkpoint()
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier).groupBy("trial", "ix", "iy").agg(F.min("g").alias("g")).checkpoint()
    goals = pairs.select("trial", F.col("gx_i").alias("ix"), F.col("gy_i").alias("iy"))
    return goals.join(known, ["trial", "ix", "iy"], "left").select("trial", F.col("g").alias("cost"))
