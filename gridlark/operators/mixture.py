"""Gaussian-mixture occupancy: densities, occupancy grids, navigation slices, and the EM fit as distributed sums.

A mixture is a table of components (comp, w, mx, my, mz, vx, vy, vz), diagonal covariances, one set for each scene.
For scoring, a scene's components are gathered into one array (as long as the model has components, however many
points there are) and every point folds over it: no shuffle of points, no row per point and component."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import at_step, d, grid_index, occupancy
from ..functions.ranking import first_rows, hash_order, sample_exact
from ..session import mapped, ship

FIELDS = ("w", "mx", "my", "mz", "vx", "vy", "vz")
_LOG_2PI = 3 * math.log(2 * math.pi)
#: Rows that the reference density is taken over, and its percentile.
REFERENCE_ROWS, REFERENCE_SHARE = 50_000, 0.95


def gathered(gmm: DataFrame, *by: str) -> DataFrame:
    """Components as one array (in the order of comp) for each scene."""
    return gmm.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("comp", *FIELDS))).alias("comps"))


def density_of(comps: Column, x: Column, y: Column, z: Column) -> Column:
    """Mixture density by log-sum-exp over the components, stable far from all of them."""

    def log_term(c: Column) -> Column:
        square = sum(((p - c[m]) * (p - c[m]) / c[v] for p, m, v in ((y, "my", "vy"), (z, "mz", "vz"))), (x - c["mx"]) * (x - c["mx"]) / c["vx"])
        return F.log(c["w"]) - (square + F.log(c["vx"] * c["vy"] * c["vz"]) + _LOG_2PI) / 2

    terms = F.transform(F.filter(comps, lambda c: c["w"] > 0), log_term)
    most = F.array_max(terms)
    return F.exp(most) * F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.exp(t - most))


def with_density(points: DataFrame, gmm: DataFrame, *by: str, name: str = "density") -> DataFrame:
    """Adds the mixture density at each point; `by` are the columns that tell scenes apart (none: one model).

    What is broadcast is one row a scene with its components: bounded by scenes times components, not by points."""
    g = gathered(gmm, *by)
    j = points.join(F.broadcast(g), list(by)) if by else points.join(F.broadcast(g))
    return j.withColumn(name, density_of(F.col("comps"), d("x"), d("y"), d("z"))).drop("comps")


def with_density_bulk(points: DataFrame, gmm: DataFrame, name: str = "density", by: str | None = None, seconds: str | None = None) -> DataFrame:
    """with_density() for very many rows of one model, or of one for each value of `by`: the components (as many rows as
    the models have) go to the tasks, which score Arrow batches by matrix products. `seconds` adds each row's share of
    the time that its batch took."""
    c = gmm.orderBy(*([by] if by else []), "comp").filter("w > 0").select(*([by] if by else []), *FIELDS).toPandas()
    models = {}
    for key, own in c.groupby(by) if by else [(None, c)]:
        a = own[list(FIELDS)].to_numpy(float)
        centre = a[:, 1:4].mean(0) if len(a) else np.zeros(3)
        models[key] = (a[:, 0], a[:, 1:4] - centre, a[:, 4:7], centre)

    def density(x: np.ndarray, key) -> np.ndarray:
        if key not in models or not len(models[key][0]):
            return np.zeros(len(x))
        w, m, v, centre = models[key]
        lp = _log_parts(x - centre, w, m, v)
        top = lp.max(1, keepdims=True)
        return np.exp(top[:, 0]) * np.exp(lp - top).sum(1)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in "xyz"], 1)
            out, took = np.zeros(len(x)), np.zeros(len(x))
            groups = np.array(b.column(by).to_pylist(), object) if by else np.full(len(x), None, object)
            for key in dict.fromkeys(groups.tolist()):
                own = np.flatnonzero(groups == key) if by else np.arange(len(x))
                began = time.perf_counter()
                out[own] = density(x[own], key)
                took[own] = (time.perf_counter() - began) / max(1, len(own))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), *([pa.array(took)] if seconds else [])], [*b.schema.names, name, *([seconds] if seconds else [])])

    more = [T.StructField(c, T.DoubleType()) for c in (name, *([seconds] if seconds else []))]
    return mapped(points, score, T.StructType([*points.schema.fields, *more]))


def reference_density(points: DataFrame, gmm: DataFrame, order: str, rows: int = REFERENCE_ROWS, share: float = REFERENCE_SHARE) -> DataFrame:
    """density_ref: the exact percentile of the density over the first rows by `order`."""
    return with_density_bulk(first_rows(points, order, rows).select(*"xyz"), gmm).agg(F.percentile("density", F.lit(share)).alias("density_ref"))


def with_occupancy(points: DataFrame, gmm: DataFrame, reference: DataFrame, lam: float, power: float, name: str = "p") -> DataFrame:
    return with_density(points, gmm).join(F.broadcast(reference)).withColumn(name, occupancy(F.col("density"), F.col("density_ref"), lam, power)).drop("density_ref")


def shrink(gmm: DataFrame, factor: float) -> DataFrame:
    """Sharpened components: variances times factor squared. The reference density is left as it was."""
    if factor <= 0:
        raise ValueError("the factor must be above 0")
    return gmm.withColumns({v: F.col(v) * F.lit(factor * factor) for v in ("vx", "vy", "vz")})


def axes(box: DataFrame, n: int) -> DataFrame:
    """dim, i, v: n evenly spaced values of each axis of the box."""
    long = box.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in "xyz"])).alias("b")).select("b.*")
    return long.select("dim", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("dim", "i", at_step(F.col("lo"), F.col("hi"), F.col("i"), n).alias("v"))


def lattice(box: DataFrame, n: int, m: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """ix, iy, iz, x, y, z: all cells of the box, made on the executors from a range of cell numbers; of several boxes
    the columns `keep` tell them apart."""
    spark, nz = box.sparkSession, m or n
    cells = spark.range(0, n * n * nz).select((F.col("id") / (n * nz)).cast("int").alias("ix"), (F.col("id") / nz % n).cast("int").alias("iy"), (F.col("id") % nz).cast("int").alias("iz"))
    at = lambda c, i, k: at_step(F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(i), k).alias(c)
    return cells.join(F.broadcast(box)).select(*keep, "ix", "iy", "iz", at("x", "ix", n), at("y", "iy", n), at("z", "iz", nz))


def occupancy_grid(box: DataFrame, gmm: DataFrame, reference: DataFrame, n: int, lam: float, power: float) -> DataFrame:
    """ix, iy, iz, x, y, z, p over the box."""
    scored = with_density_bulk(lattice(box, n), gmm).join(F.broadcast(reference))
    return scored.withColumn("p", occupancy(F.col("density"), F.col("density_ref"), lam, power)).drop("density", "density_ref")


def occupancy_grids(boxes: DataFrame, gmm: DataFrame, references: DataFrame, n: int, lam: float, power: float) -> DataFrame:
    """scene, ix, iy, iz, x, y, z, p, seconds: the grids of all scenes (boxes, components and reference density by scene)
    in one job. `seconds` is a cell's share of the time that scoring took."""
    cells = with_density_bulk(lattice(boxes, n, keep=("scene",)), gmm, by="scene", seconds="seconds").join(F.broadcast(references.select("scene", "density_ref")), "scene")
    return cells.withColumn("p", occupancy(F.col("density"), F.col("density_ref"), lam, power)).select("scene", "ix", "iy", "iz", "x", "y", "z", "p", "seconds")


def is_occupied(p: Column, threshold: float) -> Column:
    return p >= threshold


def slice_shares(grid: DataFrame, threshold: float, *by: str) -> DataFrame:
    return grid.groupBy(*by, "iz").agg(F.avg((F.col("p") >= threshold).cast("double")).alias("share"))


def nav_slice(grid: DataFrame, threshold: float, *by: str) -> DataFrame:
    """iz of the slice with the largest occupied share, the first of equal ones; of each group `by`."""
    return slice_shares(grid, threshold, *by).groupBy(*by).agg(F.max_by("iz", F.struct("share", -F.col("iz"))).alias("iz"), F.max("share").alias("share"))


def free_map(grid: DataFrame, threshold: float) -> DataFrame:
    """ix, iy, x, y, p, is_free of the navigation slice."""
    s = nav_slice(grid, threshold).select("iz")
    return grid.join(F.broadcast(s), "iz").select("ix", "iy", "x", "y", "p", (F.col("p") < threshold).alias("is_free"))


def occupied_voxels(grid: DataFrame, threshold: float) -> DataFrame:
    """Occupied cells as coloured points: red with p, blue without."""
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    return grid.filter(F.col("p") >= threshold).select("x", "y", "z", p.alias("red"), F.lit(0.0).alias("green"), (1 - p).alias("blue"))


def mid_slices(grid: DataFrame, n: int) -> DataFrame:
    """The three middle slices: plane, i, j, p."""
    one = lambda plane, fixed, i, j: grid.filter(F.col(fixed) == n // 2).select(F.lit(plane).alias("plane"), F.col(i).alias("i"), F.col(j).alias("j"), "p")
    return one("yz", "ix", "iy", "iz").unionByName(one("xz", "iy", "ix", "iz")).unionByName(one("xy", "iz", "ix", "iy"))


def cell_of(points: DataFrame, box: DataFrame, n: int) -> DataFrame:
    """Adds the cell of each point in the box's grid of n cells an axis: half to even, clamped at the border."""
    j = points.join(F.broadcast(box))
    step = lambda c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (n - 1)
    return j.withColumns({f"i{c}": grid_index(d(c), F.col(f"lo_{c}"), step(c), n) for c in "xyz"}).drop(*[f"{e}_{c}" for c in "xyz" for e in ("lo", "hi")])


def grid_lookup(points: DataFrame, grid: DataFrame, box: DataFrame, n: int, name: str = "p") -> DataFrame:
    """The grid's value at each point's cell, by an equi-join on the cell."""
    return cell_of(points, box, n).join(grid.select("ix", "iy", "iz", F.col("p").alias(name)), ["ix", "iy", "iz"])


# --- EM -------------------------------------------------------------------------------------------------------------


@dataclass
class GmmParams:
    components: int = 64
    reg_covar: float = 1e-4
    max_iter: int = 100
    tol: float = 1e-3
    seed: int = 0


def _log_parts(x: np.ndarray, w, m, v) -> np.ndarray:
    """Log of each component's part of the density at each row, as matrix products; x and m about a near centre."""
    with np.errstate(divide="ignore"):
        base = np.log(w) - 0.5 * (np.log(v).sum(1) + _LOG_2PI + (m * m / v).sum(1))
    return base + x @ (m / v).T - 0.5 * (x * x) @ (1 / v).T


def sufficient_statistics(points: DataFrame, models: dict, centre: dict) -> DataFrame:
    """scene, comp, r, sums of x, y, z and their squares (about the scene's centre) and the log-likelihood: partial
    sums of each batch of points on the executors, then one row a scene and component."""
    schema = "scene string, comp int, r double, rx double, ry double, rz double, rxx double, ryy double, rzz double, ll double"

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            scene = np.array(b.column("scene").to_pylist(), object)
            xyz = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)
            rows = []
            for s in sorted(set(scene.tolist()) & models.keys()):
                w, m, v = models[s]
                x = xyz[scene == s] - centre[s]
                lp = _log_parts(x, w, m - centre[s], v)
                top = lp.max(1, keepdims=True)
                ll = top[:, 0] + np.log(np.exp(lp - top).sum(1))
                r = np.exp(lp - ll[:, None])
                for k in range(len(w)):
                    rows.append((s, k, r[:, k].sum(), *(r[:, k] @ x), *(r[:, k] @ x**2), ll.sum() if k == 0 else 0.0))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.float64()) for c in cols[2:]]], names=["scene", "comp", "r", "rx", "ry", "rz", "rxx", "ryy", "rzz", "ll"])

    sums = ("r", "rx", "ry", "rz", "rxx", "ryy", "rzz", "ll")
    return mapped(points.select("scene", *[d(c).alias(c) for c in "xyz"]), partial, schema).groupBy("scene", "comp").agg(*[F.sum(c).alias(c) for c in sums])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Labels by k-means with distance-weighted seeds."""
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        p = near / near.sum() if near.sum() > 0 else None
        centres.append(x[rng.choice(len(x), p=p)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = np.concatenate([((part[:, None] - c[None]) ** 2).sum(2).argmin(1) for part in np.array_split(x, max(1, len(x) // 20_000))])
        n = np.bincount(label, minlength=k)
        s = np.stack([np.bincount(label, x[:, i], k) for i in range(3)], 1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return label


#: Points of a scene that k-means starts from (an exact seeded sample; EM itself runs over all points).
INITIAL = 20_000


def fit(points: DataFrame, params: GmmParams, order: str = "pid") -> tuple[DataFrame, dict[str, list[float]]]:
    """Fits one mixture a scene by EM over `points` (scene, order, x, y, z): components table and the log-likelihoods.

    All scenes go through one job an iteration; the driver holds scenes x components parameters. Points are cached, as
    every iteration reads them. A scene leaves when its mean log-likelihood changes by less than tol."""
    spark = points.sparkSession
    points = points.select("scene", order, *[d(c).alias(c) for c in "xyz"]).cache()
    counts = {r["scene"]: (r["n"], np.array([r["x"], r["y"], r["z"]])) for r in points.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"]).collect()}
    models, history, rng = {}, {s: [] for s in counts}, np.random.default_rng(params.seed)
    for s in sorted(counts):
        start = sample_exact(points.filter(F.col("scene") == s), INITIAL, hash_order(F.col(order), seed=params.seed), order).select("x", "y", "z").orderBy("x", "y", "z").toPandas().to_numpy()
        k = min(params.components, len(start))
        label = _kmeans(start, k, rng)
        n = np.maximum(np.bincount(label, minlength=k), 1e-9)
        m = np.stack([np.bincount(label, start[:, i], k) for i in range(3)], 1) / n[:, None]
        v = np.stack([np.bincount(label, (start[:, i] - m[label, i]) ** 2, k) for i in range(3)], 1) / n[:, None] + params.reg_covar
        models[s] = (n / n.sum(), m, v)
    active, centre = set(models), {s: c for s, (_, c) in counts.items()}
    for _ in range(params.max_iter):
        if not active:
            break
        own = {s: models[s] for s in active}
        got = sufficient_statistics(points.filter(F.col("scene").isin(*active)), own, centre).collect()
        for s in sorted(active):
            rows = sorted((r for r in got if r["scene"] == s), key=lambda r: r["comp"])
            r = np.array([x["r"] for x in rows]) + 10 * np.finfo(float).eps
            m = np.array([[x["rx"], x["ry"], x["rz"]] for x in rows]) / r[:, None]
            v = np.array([[x["rxx"], x["ryy"], x["rzz"]] for x in rows]) / r[:, None] - m**2 + params.reg_covar
            models[s] = (r / r.sum(), m + centre[s], np.maximum(v, params.reg_covar))
            history[s].append(sum(x["ll"] for x in rows) / counts[s][0])
            if len(history[s]) > 1 and abs(history[s][-1] - history[s][-2]) < params.tol:
                active.discard(s)
    points.unpersist()
    rows = [(s, k, float(w[k]), *map(float, m[k]), *map(float, v[k])) for s, (w, m, v) in sorted(models.items()) for k in range(len(w))]
    return spark.createDataFrame(rows, "scene string, comp int, w double, mx double, my double, mz double, vx double, vy double, vz double"), history


MODEL = "scene string, comp int, w double, mx double, my double, mz double, vx double, vy double, vz double, density_ref double, n_fit long, log_likelihood double, rounds int, seconds double, error string"
#: Rows whose responsibilities are held at a time.
TOGETHER = 50_000


def em(x: np.ndarray, params: GmmParams, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Weights, means, variances and the mean log-likelihoods of a fit to the rows of x, in one task."""
    if not np.isfinite(x).all():
        raise ValueError("points with coordinates that are not finite")
    rng, centre = np.random.default_rng(seed), x.mean(0)
    x = x - centre
    start = x if len(x) <= INITIAL else x[np.sort(rng.choice(len(x), INITIAL, replace=False))]
    k = min(params.components, len(start))
    label = _kmeans(start, k, rng)
    n = np.maximum(np.bincount(label, minlength=k), 1e-9)
    m = np.stack([np.bincount(label, start[:, i], k) for i in range(3)], 1) / n[:, None]
    v = np.stack([np.bincount(label, (start[:, i] - m[label, i]) ** 2, k) for i in range(3)], 1) / n[:, None] + params.reg_covar
    w, history = n / n.sum(), []
    for _ in range(params.max_iter):
        r, rx, rxx, ll = np.zeros(k), np.zeros((k, 3)), np.zeros((k, 3)), 0.0
        for a in range(0, len(x), TOGETHER):
            part = x[a : a + TOGETHER]
            lp = _log_parts(part, w, m, v)
            top = lp.max(1, keepdims=True)
            own = top[:, 0] + np.log(np.exp(lp - top).sum(1))
            p = np.exp(lp - own[:, None])
            r, rx, rxx, ll = r + p.sum(0), rx + p.T @ part, rxx + p.T @ part**2, ll + own.sum()
        r = r + 10 * np.finfo(float).eps
        m = rx / r[:, None]
        v = np.maximum(rxx / r[:, None] - m**2 + params.reg_covar, params.reg_covar)
        w = r / r.sum()
        history.append(ll / len(x))
        if len(history) > 1 and abs(history[-1] - history[-2]) < params.tol:
            break
    return w, m + centre, v, history


def fit_each(points: DataFrame, params: GmmParams, order: str = "pid", seeds: dict[str, int] | None = None) -> DataFrame:
    """MODEL: a mixture for each scene of `points` (scene, order, x, y, z), all scenes in one job, each in a task of its
    own; for points that a task can hold, such as samples of a stated size (fit() spreads larger scenes over all tasks).
    With each come its reference density (over the first rows by `order`), the time it took and, if the fit failed, the
    error in a row without components."""
    names = [c.split()[0] for c in MODEL.split(", ")]

    def one(t: pd.DataFrame) -> pd.DataFrame:
        began, scene = time.perf_counter(), t["scene"].iloc[0]
        try:
            x = t.sort_values([order, "x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
            w, m, v, history = em(x, params, (seeds or {}).get(scene, params.seed))
            lp = _log_parts(x[:REFERENCE_ROWS] - m.mean(0), w, m - m.mean(0), v)
            top = lp.max(1, keepdims=True)
            ref = float(np.percentile(np.exp(top[:, 0]) * np.exp(lp - top).sum(1), 100 * REFERENCE_SHARE))
            rows = [(scene, k, w[k], *m[k], *v[k], ref, len(x), history[-1], len(history), time.perf_counter() - began, None) for k in range(len(w))]
        except Exception as e:  # noqa: BLE001  one scene's failure is a row of the result
            rows = [(scene, *[None] * 8, None, len(t), None, None, time.perf_counter() - began, str(e)[:500])]
        return pd.DataFrame(rows, columns=names)

    ship(points.sparkSession)
    return points.select("scene", order, *[d(c).alias(c) for c in "xyz"]).groupBy("scene").applyInPandas(one, MODEL)


def em_step(points: DataFrame, gmm: DataFrame, reg_covar: float = 1e-4) -> DataFrame:
    """One EM step as DataFrame operations: responsibilities by folding over the components, moments by one aggregate."""
    g = gathered(gmm)
    j = points.join(F.broadcast(g)).select(d("x").alias("x"), d("y").alias("y"), d("z").alias("z"), "comps")
    total = density_of(F.col("comps"), F.col("x"), F.col("y"), F.col("z"))
    one = lambda c: density_of(F.array(c), F.col("x"), F.col("y"), F.col("z"))
    e = j.withColumn("total", total).select("x", "y", "z", "total", F.explode("comps").alias("c")).select("x", "y", "z", F.col("c.comp").alias("comp"), (one(F.col("c")) / F.col("total")).alias("r"))
    sums = e.groupBy("comp").agg(F.sum("r").alias("n"), *[F.sum(F.col("r") * F.col(c)).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col("r") * F.col(c) * F.col(c)).alias(f"q{c}") for c in "xyz"])
    count = points.agg(F.count(F.lit(1)).alias("rows"))
    mean = {c: F.col(f"s{c}") / F.col("n") for c in "xyz"}
    return sums.join(F.broadcast(count)).select("comp", (F.col("n") / F.col("rows")).alias("w"), *[mean[c].alias(f"m{c}") for c in "xyz"], *[(F.col(f"q{c}") / F.col("n") - mean[c] * mean[c] + reg_covar).alias(f"v{c}") for c in "xyz"])
