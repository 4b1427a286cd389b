"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions.ranking import hash_order, sample_exact
from .operators import mixture as mx
from .operators import paths as pa
from .operators import planners as pl
from .operators import points as pt
from .operators import poses as po
from .operators import stages as sg
from .operators import stats as st
from .plans.experiments import SCENES
from .session import checkpoint_folder, tables_folder
from .views import POINT_ORDER, mixture, path_points, points, poses, probes, qpoints, sql, table, trials

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Production parameters of the queries.
BOX = (5.0, 60.0, 5.0, 40.0, 1.0, 9.0)
CELLS, LAM, POWER, THRESHOLD, EXPORT = 16, 10.0, 1.0, 0.35, 0.3
STEP, STATIONS, SEED = 0.02, 20, 42
#: The growing maps: shares of the points seen, size of the fits and grids, held-out positions.
REVEALED = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
FIT_COMPONENTS, FIT_ROUNDS, FIT_CELLS, HELD_OUT = 32, 60, 64, 3000


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, *but: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


# --- Points -----------------------------------------------------------------------------------------------------------

P = sql("points")
_BOX = "x BETWEEN 5 AND 60 AND y BETWEEN 5 AND 40 AND z BETWEEN 1 AND 9"
_VOXEL = "floor(x / 2.5)::BIGINT, floor(y / 2.5)::BIGINT, floor(z / 2.5)::BIGINT"
_FIRST = "row_number() OVER (PARTITION BY {v} ORDER BY ok, ln, pk, sk, x)"


@query(f"""{P}, c AS (SELECT * FROM points WHERE {_BOX} AND semantic_id IN (1, 2, 3, 5)),
r AS (SELECT *, {_FIRST.format(v=_VOXEL)} AS k FROM c)
SELECT semantic_id, count(*) AS n, round(min(x), 6) AS min_x, round(max(z), 6) AS max_z FROM r WHERE k = 1 GROUP BY semantic_id""")
def points_slice(spark, sf_dir):
    p = pt.clean(points(spark, sf_dir), POINT_ORDER, box=BOX, keep=(1, 2, 3, 5), voxel_size=2.5)
    return p.groupBy("semantic_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("z"), 6).alias("max_z"))


@query(f"{P} SELECT ok, ln, round(x, 6) AS x, y, round(z, 6) AS z FROM points WHERE {_BOX}")
def points_crop(spark, sf_dir):
    return rounded(pt.crop(points(spark, sf_dir), BOX).select("ok", "ln", "x", "y", "z"))


@query(f"{P} SELECT ok, ln, is_visible, round(confidence, 6) AS confidence FROM points WHERE is_visible > 0 AND confidence >= 0.55")
def points_visible_confidence(spark, sf_dir):
    return rounded(pt.min_confidence(pt.visible_only(points(spark, sf_dir)), 0.55).select("ok", "ln", "is_visible", "confidence"))


@query(f"{P} SELECT ok, ln, semantic_id, round(x, 6) AS x FROM points WHERE semantic_id IN (1, 2, 4, 6) AND semantic_id NOT IN (4)")
def points_keep_drop_semantic(spark, sf_dir):
    return rounded(pt.by_semantic(points(spark, sf_dir), keep=(1, 2, 4, 6), drop=(4,)).select("ok", "ln", "semantic_id", "x"))


@query(f"{P} SELECT ok, ln, semantic_id FROM points WHERE semantic_id IN (SELECT l_linenumber FROM lineitem WHERE l_linenumber % 2 = 1) AND semantic_id NOT IN (SELECT l_linenumber FROM lineitem WHERE l_linenumber > 5)")
def points_semi_anti(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id")).distinct()
    return pt.by_semantic(points(spark, sf_dir), ids.filter("id % 2 = 1"), ids.filter("id > 5")).select("ok", "ln", "semantic_id")


@query(f"{P}, r AS (SELECT *, {_FIRST.format(v=_VOXEL)} AS k FROM points) SELECT ok, ln, pk, sk, round(x, 6) AS x, y, round(z, 6) AS z, semantic_id FROM r WHERE k = 1")
def voxel_first(spark, sf_dir):
    return rounded(pt.first_per_voxel(points(spark, sf_dir), 2.5, POINT_ORDER).select("ok", "ln", "pk", "sk", "x", "y", "z", "semantic_id"))


@query(f"""{P}, l AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM points)
SELECT floor((x - lx) / 5)::BIGINT AS vx, floor((y - ly) / 5)::BIGINT AS vy, floor((z - lz) / 5)::BIGINT AS vz, round(avg(x) * count(*), 5) AS x, round(avg(y) * count(*), 5) AS y, round(avg(z) * count(*), 5) AS z, count(*) AS n FROM points, l GROUP BY 1, 2, 3""")
def voxel_centroid(spark, sf_dir):
    """Means times counts: rounding the means themselves would meet ties."""
    v = pt.voxel_centroids(points(spark, sf_dir).select("x", "y", "z"), 5.0)
    return rounded(v.withColumns({c: F.col(c) * F.col("n") for c in "xyz"}), 5)


def _bounds_sql(source: str, pad: str, by: str = "") -> str:
    wide = ", ".join(f"round(min({c}) - (max({c}) - min({c})) * {pad}, 9) AS lo_{c}, round(max({c}) + (max({c}) - min({c})) * {pad}, 9) AS hi_{c}" for c in "xyz")
    return f"SELECT {by + ', ' if by else ''}{wide} FROM {source}{' GROUP BY ' + by if by else ''}"


@query(f"{P} {_bounds_sql('points', '0.1::DOUBLE', 'semantic_id')}")
def bounds_padded(spark, sf_dir):
    return rounded(pt.bounds(points(spark, sf_dir), 0.1, "semantic_id"), 9)


@query(f"""{P}, f AS (SELECT frame, row_number() OVER (ORDER BY frame) AS n FROM (SELECT DISTINCT frame FROM points WHERE frame BETWEEN 1500 AND 2500))
SELECT p.frame, count(*) AS n, round(sum(x), 6) AS sx FROM points p JOIN f USING (frame) WHERE (f.n - 1) % 7 = 0 GROUP BY p.frame""")
def frame_range_stride(spark, sf_dir):
    p = pt.frames(points(spark, sf_dir), 1500, 2500, 7)
    return p.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("sx"))


@query(f"{P}, n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ok, ln, pk, sk, x) - 1 AS pid FROM points) SELECT frame, pid, ok, round(x, 6) AS x FROM n WHERE pid % 5 = 0")
def nth_point(spark, sf_dir):
    from pyspark.sql.window import Window

    p = points(spark, sf_dir).withColumn("pid", (F.row_number().over(Window.partitionBy("frame").orderBy(*POINT_ORDER)) - 1).cast("long"))
    return rounded(pt.every_nth(p, 5, F.col("pid")).select("frame", "pid", "ok", "x"))


@query(f"{P} SELECT ok, ln, round(sqrt(x * x + y * y + z * z), 6) AS r FROM points WHERE sqrt(x * x + y * y + z * z) BETWEEN 20 AND 50")
def sensor_range(spark, sf_dir):
    p = pt.in_range(points(spark, sf_dir), 20.0, 50.0)
    return rounded(p.select("ok", "ln", g.norm(F.col("x"), F.col("y"), F.col("z")).alias("r")))


@query(f"{P}, q AS (SELECT ok, ln, CASE WHEN ln = 3 THEN 'NaN'::DOUBLE WHEN ln = 5 THEN 'Infinity'::DOUBLE ELSE x END AS x FROM points) SELECT ok, ln, round(x, 6) AS x FROM q WHERE isfinite(x)")
def finite_rows(spark, sf_dir):
    x = F.when(F.col("ln") == 3, F.lit(math.nan)).when(F.col("ln") == 5, F.lit(math.inf)).otherwise(F.col("x"))
    return rounded(pt.finite_points(points(spark, sf_dir).withColumn("x", x)).select("ok", "ln", "x"))


@query(f"""{P}, c AS (SELECT * FROM points WHERE {_BOX} AND is_visible > 0 AND confidence >= 0.35 AND semantic_id IN (1, 2, 3, 4) AND semantic_id NOT IN (2)),
r AS (SELECT *, {_FIRST.format(v=_VOXEL.replace('2.5', '1.5'))} AS k FROM c) SELECT ok, ln, pk, sk, round(x, 6) AS x, y, round(z, 6) AS z FROM r WHERE k = 1""")
def composite_filter(spark, sf_dir):
    p = pt.clean(points(spark, sf_dir), POINT_ORDER, BOX, True, 0.35, (1, 2, 3, 4), (2,), 1.5)
    return rounded(p.select("ok", "ln", "pk", "sk", "x", "y", "z"))


@query(f"{P} SELECT round(x, 6) AS x, y, round(z, 6) AS z FROM points")
def xyz_only(spark, sf_dir):
    return rounded(pt.project_xyz(points(spark, sf_dir), xyz_only=True))


@query(f"""{P}, n AS (SELECT ok, ln, pk, sk, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z FROM points),
r AS (SELECT *, row_number() OVER (PARTITION BY floor(x::DOUBLE / 0.5)::BIGINT, floor(y::DOUBLE / 0.5)::BIGINT, floor(z::DOUBLE / 0.5)::BIGINT ORDER BY ok, ln, pk, sk, x) AS k FROM n) SELECT ok, ln, pk, sk, x, y, z FROM r WHERE k = 1""")
def narrow_then_voxel(spark, sf_dir):
    p = pt.narrowed(points(spark, sf_dir).select("ok", "ln", "pk", "sk", "x", "y", "z"))
    return pt.first_per_voxel(p, 0.5, POINT_ORDER)


@query(f"{P} SELECT frame, ok, ln, 0::FLOAT AS intensity, row_number() OVER (PARTITION BY frame ORDER BY ok, ln, pk, sk, x)::INTEGER AS nr FROM points")
def frame_and_intensity(spark, sf_dir):
    from pyspark.sql.window import Window

    return points(spark, sf_dir).select("frame", "ok", "ln", F.lit(0.0).cast("float").alias("intensity"), F.row_number().over(Window.partitionBy("frame").orderBy(*POINT_ORDER)).alias("nr"))


@query(f"{P} SELECT count(*) AS before, count(*) FILTER (WHERE {_BOX}) AS inside, count(DISTINCT ({_VOXEL})) AS voxels, round(avg(({_BOX})::INTEGER::DOUBLE) * 100, 6) AS inside_pct FROM points")
def points_counts(spark, sf_dir):
    keys = [g.voxel(F.col(c), 2.5) for c in "xyz"]
    return rounded(points(spark, sf_dir).agg(F.count(F.lit(1)).alias("before"), F.count_if(g.inside(BOX)).alias("inside"), F.count_distinct(*keys).alias("voxels"), (F.avg(g.inside(BOX).cast("double")) * 100).alias("inside_pct")))


@query(f"{P}, h AS (SELECT ok, ln, pk, sk, x, md5(concat_ws(':', '42', ok, ln, pk, sk)) AS h FROM points) SELECT ok, ln, pk, sk, round(x, 6) AS x FROM h ORDER BY h, ok, ln, pk, sk LIMIT 500")
def sample_without_replacement(spark, sf_dir):
    p = points(spark, sf_dir).select("ok", "ln", "pk", "sk", "x")
    return rounded(sample_exact(p, 500, hash_order(F.col("ok"), F.col("ln"), F.col("pk"), F.col("sk"), seed=SEED), "ok", "ln", "pk", "sk"))


# --- Mixture and grid -------------------------------------------------------------------------------------------------

G = sql("qpoints", "gmm")
_LP = "ln(w) - 0.5 * (power({x} - mx, 2) / vx + power({y} - my, 2) / vy + power({z} - mz, 2) / vz + ln(vx * vy * vz) + 3 * ln(2 * pi()))"


def _density_sql(source: str, key: str, name: str = "dens", gmm: str = "gmm", x: str = "x", y: str = "y", z: str = "z") -> str:
    return f"{name} AS (SELECT {key}, exp(m) * sum(exp(lp - m)) AS density FROM (SELECT {key}, lp, max(lp) OVER (PARTITION BY {key}) AS m FROM (SELECT {key}, {_LP.format(x=x, y=y, z=z)} AS lp FROM {source}, {gmm})) GROUP BY {key}, m)"


_REF = "ref AS (SELECT quantile_cont(density, 0.95) AS density_ref FROM (SELECT density FROM dens ORDER BY vec_id LIMIT 50000))"
_OCC = "1 - exp(-10 * power(greatest({d} / (density_ref + 1e-12), 0), 1))"
_BOUNDS = "box AS (" + ", ".join([f"SELECT {', '.join(f'min({c}) - (max({c}) - min({c})) * 0.1::DOUBLE AS lo_{c}, max({c}) + (max({c}) - min({c})) * 0.1::DOUBLE AS hi_{c}' for c in 'xyz')} FROM qpoints"]) + ")"
_CELLS = f"cells AS (SELECT (i // {CELLS * CELLS})::INTEGER AS ix, (i // {CELLS} % {CELLS})::INTEGER AS iy, (i % {CELLS})::INTEGER AS iz FROM range({CELLS ** 3}) r(i)), lat AS (SELECT ix, iy, iz, ix * {CELLS * CELLS} + iy * {CELLS} + iz AS cell, lo_x + (hi_x - lo_x) * ix / {CELLS - 1} AS x, lo_y + (hi_y - lo_y) * iy / {CELLS - 1} AS y, lo_z + (hi_z - lo_z) * iz / {CELLS - 1} AS z FROM cells, box)"
GRID = f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF}, {_BOUNDS}, {_CELLS}, {_density_sql('lat', 'cell', 'cd')}, grid AS (SELECT ix, iy, iz, x, y, z, {_OCC.format(d='cd.density')} AS p FROM lat JOIN cd USING (cell), ref)"
_SLICE = f"shares AS (SELECT iz, avg((p >= {THRESHOLD}::DOUBLE)::INTEGER::DOUBLE) AS share FROM grid GROUP BY iz), nav AS (SELECT iz, share FROM shares ORDER BY share DESC, iz LIMIT 1), fm AS (SELECT ix, iy, x, y, p, p < {THRESHOLD}::DOUBLE AS is_free FROM grid JOIN nav USING (iz))"


def _reference(spark, sf_dir):
    return mx.reference_density(qpoints(spark, sf_dir), mixture(spark, sf_dir), "vec_id")


def _box(spark, sf_dir):
    return pt.bounds(qpoints(spark, sf_dir), 0.1)


def _grid(spark, sf_dir):
    return mx.occupancy_grid(_box(spark, sf_dir), mixture(spark, sf_dir), _reference(spark, sf_dir), CELLS, LAM, POWER)


@query(f"{G} SELECT comp, round(w, 6) AS w, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vz, 6) AS vz FROM gmm")
def gmm_components(spark, sf_dir):
    return rounded(mixture(spark, sf_dir))


@query(f"{G}, {_density_sql('qpoints', 'vec_id')} SELECT vec_id, round(density, 6) AS density FROM dens")
def density(spark, sf_dir):
    return rounded(mx.with_density(qpoints(spark, sf_dir), mixture(spark, sf_dir)).select("vec_id", "density"))


@query(f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF} SELECT round(density_ref, 6) AS density_ref FROM ref")
def density_ref_p95(spark, sf_dir):
    return rounded(_reference(spark, sf_dir))


@query(f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF} SELECT vec_id, round({_OCC.format(d='density')}, 6) AS p, {_OCC.format(d='density')} >= 0.35::DOUBLE AS occupied FROM dens, ref")
def occupancy(spark, sf_dir):
    o = mx.with_occupancy(qpoints(spark, sf_dir), mixture(spark, sf_dir), _reference(spark, sf_dir), LAM, POWER)
    return o.select("vec_id", F.round("p", 6).alias("p"), (F.col("p") >= THRESHOLD).alias("occupied"))


_SHRUNK = "shrunk AS (SELECT comp, w, mx, my, mz, vx * 0.25::DOUBLE AS vx, vy * 0.25::DOUBLE AS vy, vz * 0.25::DOUBLE AS vz FROM gmm)"


@query(f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF}, {_SHRUNK}, {_density_sql('qpoints', 'vec_id', 'sd', 'shrunk')} SELECT vec_id, round({_OCC.format(d='sd.density')}, 6) AS p FROM sd, ref")
def shrink_covariances(spark, sf_dir):
    m = mixture(spark, sf_dir)
    o = mx.with_occupancy(qpoints(spark, sf_dir), mx.shrink(m, 0.5), _reference(spark, sf_dir), LAM, POWER)
    return rounded(o.select("vec_id", "p"))


@query(f"{GRID} SELECT ix, iy, iz, round(p, 6) AS p FROM grid")
def occ_grid(spark, sf_dir):
    return rounded(_grid(spark, sf_dir).select("ix", "iy", "iz", "p"))


@query(f"{G}, {_BOUNDS} SELECT d AS dim, i::INTEGER AS i, round(lo + (hi - lo) * i / 15, 6) AS v FROM (SELECT 'x' AS d, lo_x AS lo, hi_x AS hi FROM box UNION ALL SELECT 'y', lo_y, hi_y FROM box UNION ALL SELECT 'z', lo_z, hi_z FROM box), range(16) r(i)")
def grid_axes(spark, sf_dir):
    return rounded(mx.axes(_box(spark, sf_dir), CELLS))


@query(f"{GRID}, {_SLICE} SELECT iz, round(share, 6) AS share FROM nav")
def nav_slice(spark, sf_dir):
    return rounded(mx.nav_slice(_grid(spark, sf_dir), THRESHOLD))


@query(f"{GRID}, {_SLICE} SELECT ix, iy, round(x, 6) AS x, round(y, 6) AS y, round(p, 6) AS p, is_free FROM fm")
def free_map(spark, sf_dir):
    return rounded(mx.free_map(_grid(spark, sf_dir), THRESHOLD))


@query(f"{GRID}, {_SLICE} SELECT round(avg(is_free::INTEGER::DOUBLE) * 100, 6) AS free_pct, count(*) AS cells FROM fm")
def free_pct(spark, sf_dir):
    return rounded(mx.free_map(_grid(spark, sf_dir), THRESHOLD).agg((F.avg(F.col("is_free").cast("double")) * 100).alias("free_pct"), F.count(F.lit(1)).alias("cells")))


@query(f"{GRID} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(least(greatest(p, 0), 1), 6) AS red, 0.0::DOUBLE AS green, round(1 - least(greatest(p, 0), 1), 6) AS blue FROM grid WHERE p >= {EXPORT}::DOUBLE")
def occupied_voxels_color(spark, sf_dir):
    return rounded(mx.occupied_voxels(_grid(spark, sf_dir), EXPORT))


@query(f"{GRID} SELECT 'yz' AS plane, iy AS i, iz AS j, round(p, 6) AS p FROM grid WHERE ix = 8 UNION ALL SELECT 'xz', ix, iz, round(p, 6) FROM grid WHERE iy = 8 UNION ALL SELECT 'xy', ix, iy, round(p, 6) FROM grid WHERE iz = 8")
def mid_slices(spark, sf_dir):
    return rounded(mx.mid_slices(_grid(spark, sf_dir), CELLS))


_INDEX = ", ".join(f"least(greatest(round_even((q.{c} - lo_{c}) / ((hi_{c} - lo_{c}) / {CELLS - 1}), 0), 0), {CELLS - 1})::INTEGER AS i{c}" for c in "xyz")


@query(f"{G}, {_BOUNDS} SELECT vec_id, {_INDEX} FROM qpoints q, box")
def world_to_grid(spark, sf_dir):
    return mx.cell_of(qpoints(spark, sf_dir), _box(spark, sf_dir), CELLS).select("vec_id", "ix", "iy", "iz")


@query(f"{GRID}, c AS (SELECT vec_id, {_INDEX} FROM qpoints q, box) SELECT vec_id, round(p, 6) AS p FROM c JOIN grid USING (ix, iy, iz)")
def grid_lookup(spark, sf_dir):
    return rounded(mx.grid_lookup(qpoints(spark, sf_dir), _grid(spark, sf_dir), _box(spark, sf_dir), CELLS).select("vec_id", "p"))


@query(f"{GRID} SELECT iz, round(share, 6) AS share FROM (SELECT iz, avg((p >= {THRESHOLD}::DOUBLE)::INTEGER::DOUBLE) AS share FROM grid GROUP BY iz)")
def slice_shares(spark, sf_dir):
    return rounded(mx.slice_shares(_grid(spark, sf_dir), THRESHOLD))


_EM = f"""lp AS (SELECT vec_id, x, y, z, comp, {_LP.format(x='x', y='y', z='z')} AS lp FROM qpoints, gmm),
tot AS (SELECT vec_id, m + ln(sum(exp(lp - m))) AS ll FROM (SELECT vec_id, lp, max(lp) OVER (PARTITION BY vec_id) AS m FROM lp) GROUP BY vec_id, m),
r AS (SELECT comp, exp(lp - ll) AS r, x, y, z FROM lp JOIN tot USING (vec_id))"""


@query(f"""{G}, {_EM} SELECT comp, round(sum(r) / (SELECT count(*) FROM qpoints), 6) AS w, round(sum(r * x) / sum(r), 6) AS mx, round(sum(r * y) / sum(r), 6) AS my, round(sum(r * z) / sum(r), 6) AS mz,
round(sum(r * x * x) / sum(r) - power(sum(r * x) / sum(r), 2) + 1e-4::DOUBLE, 6) AS vx, round(sum(r * y * y) / sum(r) - power(sum(r * y) / sum(r), 2) + 1e-4::DOUBLE, 6) AS vy, round(sum(r * z * z) / sum(r) - power(sum(r * z) / sum(r), 2) + 1e-4::DOUBLE, 6) AS vz FROM r GROUP BY comp""")
def em_one_step(spark, sf_dir):
    return rounded(mx.em_step(qpoints(spark, sf_dir), mixture(spark, sf_dir)))


@query()
def gmm_fit(spark, sf_dir):
    """Two scenes fitted at once; compared with numpy in the tests."""
    q = qpoints(spark, sf_dir).select(F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("scene"), F.col("vec_id").alias("pid"), "x", "y", "z")
    model, _ = mx.fit(q, mx.GmmParams(components=4, max_iter=20))
    return rounded(model)


# --- Paths ------------------------------------------------------------------------------------------------------------

W = sql("path_pts")
_EDGES = "edges AS (SELECT *, path_id || ':' || seq AS edge_id FROM (SELECT path_id, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM path_pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)) WHERE x1 IS NOT NULL)"
_SAMPLES = "samples AS (SELECT edge_id, i::INTEGER AS i, x0 + (x1 - x0) * i / (n - 1) AS x, y0 + (y1 - y0) * i / (n - 1) AS y FROM (SELECT *, greatest(2, ceil(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / {step}))::INTEGER AS n FROM {edges}) e, LATERAL (SELECT unnest(range(n)) AS i))"
#: Edges between neighbouring query points, on the mixture's own plane.
_QEDGES = "qedges AS (SELECT a.vec_id::VARCHAR AS edge_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM qpoints a JOIN qpoints b ON b.vec_id = a.vec_id + 1)"


def _qedges(spark, sf_dir):
    q = qpoints(spark, sf_dir)
    a = q.select(F.col("vec_id").cast("string").alias("edge_id"), (F.col("vec_id") + 1).alias("n"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    return a.join(q.select(F.col("vec_id").alias("n"), F.col("x").alias("x1"), F.col("y").alias("y1")), "n").drop("n")


@query(f"{W}, {_EDGES}, {_SAMPLES.format(step='25.0::DOUBLE', edges='edges')} SELECT edge_id, i, round(x, 6) AS x, round(y, 6) AS y FROM samples")
def edge_samples(spark, sf_dir):
    return rounded(pa.edge_samples(pa.edges_of(path_points(spark, sf_dir)), 25.0))


@query(f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF}, {_QEDGES}, {_SAMPLES.format(step='0.02::DOUBLE', edges='qedges')}, s AS (SELECT edge_id || '/' || i AS k, edge_id, x, y, 0.0::DOUBLE AS z FROM samples), {_density_sql('s', 'k', 'sd')} SELECT edge_id, bool_and({_OCC.format(d='sd.density')} < 0.35::DOUBLE) AS is_free FROM s JOIN sd USING (k), ref GROUP BY edge_id")
def edge_free_gmm(spark, sf_dir):
    s = pa.edge_samples(_qedges(spark, sf_dir), STEP).withColumn("z", F.lit(0.0))
    return pa.all_free(mx.with_occupancy(s, mixture(spark, sf_dir), _reference(spark, sf_dir), LAM, POWER), THRESHOLD)


_I2 = ", ".join(f"least(greatest(round_even((q.{c} - lo_{c}) / ((hi_{c} - lo_{c}) / {CELLS - 1}), 0), 0), {CELLS - 1})::INTEGER AS i{c}" for c in "xy")


@query(f"{GRID}, {_SLICE}, {_QEDGES}, {_SAMPLES.format(step='0.02::DOUBLE', edges='qedges')}, c AS (SELECT edge_id, {_I2} FROM samples q, box) SELECT edge_id, bool_and(p < {THRESHOLD}::DOUBLE) AS is_free FROM c JOIN fm USING (ix, iy) GROUP BY edge_id")
def edge_free_grid(spark, sf_dir):
    s = pa.edge_samples(_qedges(spark, sf_dir), STEP).withColumn("z", F.lit(0.0))
    cells = mx.cell_of(s, _box(spark, sf_dir), CELLS)
    return pa.all_free(cells.join(mx.free_map(_grid(spark, sf_dir), THRESHOLD).select("ix", "iy", "p"), ["ix", "iy"]), THRESHOLD)


@query(f"{W}, s AS (SELECT path_id, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS s FROM path_pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, round(coalesce(sum(s), 0), 4) AS length FROM s GROUP BY path_id")
def path_length(spark, sf_dir):
    return rounded(pa.lengths(path_points(spark, sf_dir)), 4)


_SEG = "d AS (SELECT path_id, seq, lead(x) OVER w - x AS ax, lead(y) OVER w - y AS ay FROM path_pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)), t AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS ay2 FROM d WINDOW w AS (PARTITION BY path_id ORDER BY seq))"
_COS = "acos(least(greatest((ax * bx + ay * ay2) / ({na} * {nb}), -1), 1))"
_NA, _NB = "sqrt(ax * ax + ay * ay)", "sqrt(bx * bx + ay2 * ay2)"


@query(f"{W}, {_SEG} SELECT path_id, round(coalesce(sum(CASE WHEN bx IS NOT NULL THEN {_COS.format(na=f'greatest({_NA}, 1e-8)', nb=f'greatest({_NB}, 1e-8)')} END), 0), 5) AS smoothness FROM t GROUP BY path_id")
def path_smoothness_floor(spark, sf_dir):
    return rounded(pa.smoothness(path_points(spark, sf_dir), "floor"), 5)


@query(f"{W}, {_SEG} SELECT path_id, round(CASE WHEN count(*) >= 3 THEN coalesce(sum(CASE WHEN {_NA} >= 1e-9 AND {_NB} >= 1e-9 THEN {_COS.format(na=_NA, nb=_NB)} END), 0) END, 5) AS smoothness FROM t GROUP BY path_id")
def path_smoothness_skip(spark, sf_dir):
    return rounded(pa.smoothness(path_points(spark, sf_dir), "skip"), 5)


_STATIONS = f"""seg AS (SELECT path_id, seq, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM path_pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
len AS (SELECT *, sqrt(power(x1 - x, 2) + power(y1 - y, 2)) AS s FROM seg),
cum AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM len),
tot AS (SELECT path_id, sum(s) AS total FROM len GROUP BY path_id HAVING sum(s) >= 1e-6),
st AS (SELECT path_id, i::INTEGER AS station, i * total / {STATIONS - 1} AS d FROM tot, range({STATIONS}) r(i)),
hit AS (SELECT st.path_id, st.station, st.d, max(c.seq) AS seq FROM st JOIN cum c ON c.path_id = st.path_id AND c.s > 0 AND c.since <= st.d + 1e-9 GROUP BY ALL),
stations AS (SELECT h.path_id, h.station, c.x + least(greatest((h.d - c.since) / c.s, 0), 1) * (c.x1 - c.x) AS x, c.y + least(greatest((h.d - c.since) / c.s, 0), 1) * (c.y1 - c.y) AS y FROM hit h JOIN cum c USING (path_id, seq))"""


@query(f"{W}, {_STATIONS} SELECT path_id, station, round(x, 4) AS x, round(y, 4) AS y FROM stations")
def arc_length_interp(spark, sf_dir):
    return rounded(pa.stations(path_points(spark, sf_dir), STATIONS), 4)


#: Path positions scaled into the mixture's plane.
_ONMAP = "pos AS (SELECT {keys}, (x / 720 - 0.5) * 0.6 AS x, (y / 500 - 0.5) * 0.6 AS y, 0.0::DOUBLE AS z FROM {source})"


def _on_map(df):
    return df.withColumns({"x": (F.col("x") / 720 - 0.5) * 0.6, "y": (F.col("y") / 500 - 0.5) * 0.6, "z": F.lit(0.0)})


_SCORED = f"{sql('path_pts', 'qpoints', 'gmm')}, {_density_sql('qpoints', 'vec_id')}, {_REF}, {_STATIONS}, {_ONMAP.format(keys='path_id, station', source='stations')}, k AS (SELECT *, path_id || '/' || station AS k FROM pos), {_density_sql('k', 'k', 'kd')}, sc AS (SELECT path_id, {_OCC.format(d='kd.density')} AS p FROM k JOIN kd USING (k), ref)"


def _scored(spark, sf_dir):
    s = _on_map(pa.stations(path_points(spark, sf_dir), STATIONS))
    return mx.with_occupancy(s, mixture(spark, sf_dir), _reference(spark, sf_dir), LAM, POWER)


@query(f"{_SCORED} SELECT path_id, round(coalesce(max(p), 0), 5) AS max_occ FROM (SELECT DISTINCT path_id FROM path_pts) LEFT JOIN sc USING (path_id) GROUP BY path_id")
def max_occ_path(spark, sf_dir):
    return rounded(pa.path_safety(_scored(spark, sf_dir), path_points(spark, sf_dir)).select("path_id", "max_occ"), 5)


@query(f"{_SCORED} SELECT path_id, round(coalesce(avg(1 - p), 1), 5) AS mean_clearance FROM (SELECT DISTINCT path_id FROM path_pts) LEFT JOIN sc USING (path_id) GROUP BY path_id")
def clearance_path(spark, sf_dir):
    return rounded(pa.path_safety(_scored(spark, sf_dir), path_points(spark, sf_dir)).select("path_id", "mean_clearance"), 5)


@query(f"{sql('path_pts', 'qpoints', 'gmm')}, {_density_sql('qpoints', 'vec_id')}, {_REF}, {_ONMAP.format(keys='path_id, seq', source='path_pts')}, k AS (SELECT *, path_id || '/' || seq AS k FROM pos), {_density_sql('k', 'k', 'kd')} SELECT path_id, round(max({_OCC.format(d='kd.density')}), 5) AS max_occ FROM k JOIN kd USING (k), ref GROUP BY path_id")
def waypoint_max_occ(spark, sf_dir):
    s = mx.with_occupancy(_on_map(path_points(spark, sf_dir)), mixture(spark, sf_dir), _reference(spark, sf_dir), LAM, POWER)
    return rounded(s.groupBy("path_id").agg(F.max("p").alias("max_occ")), 5)


_SD = f"{_SHRUNK}, {_density_sql('qpoints', 'vec_id', 'sd', 'shrunk')}"


@query(f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF}, {_SD} SELECT round(avg(abs(({_OCC.format(d='dens.density')}) - ({_OCC.format(d='sd.density')}))), 6) AS mae, count(*) AS n FROM dens JOIN sd USING (vec_id), ref")
def map_mae(spark, sf_dir):
    m, r = mixture(spark, sf_dir), _reference(spark, sf_dir)
    a = mx.with_occupancy(qpoints(spark, sf_dir), m, r, LAM, POWER, "truth").drop("density")
    return rounded(pa.mean_absolute_error(mx.with_occupancy(a, mx.shrink(m, 0.5), r, LAM, POWER), F.col("truth"), F.col("p")))


@query(f"{GRID}, c AS (SELECT vec_id, {_INDEX} FROM qpoints q, box) SELECT round(avg(abs(grid.p - ({_OCC.format(d='dens.density')}))), 6) AS mae, count(*) AS n FROM c JOIN grid USING (ix, iy, iz) JOIN dens USING (vec_id), ref")
def grid_mae(spark, sf_dir):
    t = mx.with_occupancy(qpoints(spark, sf_dir), mixture(spark, sf_dir), _reference(spark, sf_dir), LAM, POWER, "truth").drop("density")
    return rounded(pa.mean_absolute_error(mx.grid_lookup(t, _grid(spark, sf_dir), _box(spark, sf_dir), CELLS), F.col("truth"), F.col("p")))


#: The published resolution.
FULL = 128
_FULL = f"cells AS (SELECT (i // {FULL * FULL})::INTEGER AS ix, (i // {FULL} % {FULL})::INTEGER AS iy, (i % {FULL})::INTEGER AS iz FROM range({FULL ** 3}) r(i)), lat AS (SELECT ix, iy, iz, (ix * {FULL} + iy) * {FULL} + iz AS cell, lo_x + (hi_x - lo_x) * ix / {FULL - 1} AS x, lo_y + (hi_y - lo_y) * iy / {FULL - 1} AS y, lo_z + (hi_z - lo_z) * iz / {FULL - 1} AS z FROM cells, box)"


@query(f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF}, {_BOUNDS}, {_FULL}, {_density_sql('lat', 'cell', 'cd')} SELECT iz, count(*) AS cells, round(avg(({_OCC.format(d='density')} >= {THRESHOLD}::DOUBLE)::INTEGER::DOUBLE), 5) AS share, round(sum({_OCC.format(d='density')}), 2) AS total FROM lat JOIN cd USING (cell), ref GROUP BY iz")
def full_grid_shares(spark, sf_dir):
    """Slices of the grid of 128 cells an axis."""
    grid = mx.occupancy_grid(_box(spark, sf_dir), mixture(spark, sf_dir), _reference(spark, sf_dir), FULL, LAM, POWER)
    s = grid.groupBy("iz").agg(F.count(F.lit(1)).alias("cells"), F.avg(mx.is_occupied(F.col("p"), THRESHOLD).cast("double")).alias("share"), F.sum("p").alias("total"))
    return s.select("iz", "cells", F.round("share", 5).alias("share"), F.round("total", 2).alias("total"))


@query(f"{G}, {_density_sql('qpoints', 'vec_id')}, {_REF} SELECT vec_id FROM dens, ref WHERE {_OCC.format(d='density')} >= {THRESHOLD}::DOUBLE")
def occupied_points(spark, sf_dir):
    o = mx.with_occupancy(qpoints(spark, sf_dir), mixture(spark, sf_dir), _reference(spark, sf_dir), LAM, POWER)
    return o.filter(mx.is_occupied(F.col("p"), THRESHOLD)).select("vec_id")


# --- Poses ------------------------------------------------------------------------------------------------------------

S = sql("poses", "probes")
_Q = ("qw", "qx", "qy", "qz")
_PLACED = f"""f AS (SELECT DISTINCT seq, frame FROM probes),
a AS (SELECT f.seq, f.frame, p.frame AS fa, {', '.join(f'p.{c} AS a_{c}' for c in (*_Q, 'tx', 'ty', 'tz'))} FROM f ASOF LEFT JOIN poses p ON f.seq = p.seq AND f.frame >= p.frame),
b AS (SELECT f.seq, f.frame, p.frame AS fb, {', '.join(f'p.{c} AS b_{c}' for c in (*_Q, 'tx', 'ty', 'tz'))} FROM f ASOF LEFT JOIN poses p ON f.seq = p.seq AND f.frame <= p.frame),
j AS (SELECT a.seq, a.frame, coalesce(fa, fb) AS fa, coalesce(fb, fa) AS fb, {', '.join(f'coalesce(a_{c}, b_{c}) AS a_{c}, coalesce(b_{c}, a_{c}) AS b_{c}' for c in (*_Q, 'tx', 'ty', 'tz'))} FROM a JOIN b USING (seq, frame)),
t AS (SELECT *, CASE WHEN fb > fa THEN (frame - fa)::DOUBLE / (fb - fa) ELSE 0 END AS t, {' + '.join(f'a_{c} * b_{c}' for c in _Q)} AS raw FROM j WHERE fa IS NOT NULL),
k AS (SELECT *, CASE WHEN raw < 0 THEN -1 ELSE 1 END AS sg, least(abs(raw), 1) AS dot FROM t),
w AS (SELECT *, CASE WHEN dot > 0.9995 THEN 1 - t ELSE sin((1 - t) * acos(dot)) / sin(acos(dot)) END AS wa, sg * CASE WHEN dot > 0.9995 THEN t ELSE sin(t * acos(dot)) / sin(acos(dot)) END AS wb FROM k),
m AS (SELECT *, {', '.join(f'wa * a_{c} + wb * b_{c} AS m_{c}' for c in _Q)} FROM w),
n AS (SELECT *, sqrt({' + '.join(f'm_{c} * m_{c}' for c in _Q)}) AS nn FROM m),
placed AS (SELECT seq, frame, {', '.join(f'CASE WHEN t = 0 THEN a_{c} ELSE m_{c} / nn END AS {c}' for c in _Q)}, {', '.join(f'(1 - t) * a_{c} + t * b_{c} AS {c}' for c in ('tx', 'ty', 'tz'))} FROM n)"""


@query(f"{S}, {_PLACED} SELECT seq, frame, {', '.join(f'round({c}, 5) AS {c}' for c in (*_Q, 'tx', 'ty', 'tz'))} FROM placed")
def pose_bracket_interp(spark, sf_dir):
    return rounded(po.interpolated(probes(spark, sf_dir), poses(spark, sf_dir)), 5)


_ROT = "1 - 2 * (qy * qy + qz * qz) AS r00, 2 * (qx * qy - qz * qw) AS r01, 2 * (qx * qz + qy * qw) AS r02, 2 * (qx * qy + qz * qw) AS r10, 1 - 2 * (qx * qx + qz * qz) AS r11, 2 * (qy * qz - qx * qw) AS r12, 2 * (qx * qz - qy * qw) AS r20, 2 * (qy * qz + qx * qw) AS r21, 1 - 2 * (qx * qx + qy * qy) AS r22"


@query(f"{S}, {_PLACED}, rot AS (SELECT *, {_ROT} FROM placed) SELECT p.pid, {', '.join(f'round(r{i}0 * x + r{i}1 * y + r{i}2 * z + t{c}, 5) AS w{c}' for i, c in enumerate('xyz'))} FROM probes p JOIN rot USING (seq, frame)")
def rigid_transform(spark, sf_dir):
    p = probes(spark, sf_dir)
    return rounded(po.to_world(p, po.interpolated(p, poses(spark, sf_dir))).select("pid", "wx", "wy", "wz"), 5)


@query(f"{S} SELECT seq, frame, {', '.join(f'round(r{i}{j}, 6) AS r{i}{j}' for i in range(3) for j in range(3))} FROM (SELECT *, {_ROT} FROM poses)")
def quat_to_matrix(spark, sf_dir):
    return rounded(po.rotation(poses(spark, sf_dir)).select("seq", "frame", *[f"r{i}{j}" for i in range(3) for j in range(3)]))


_TRACE = "CASE WHEN r00 + r11 + r22 > 0 THEN {0} WHEN r00 > r11 AND r00 > r22 THEN {1} WHEN r11 > r22 THEN {2} ELSE {3} END"
_S = ("(2 * sqrt(greatest(r00 + r11 + r22 + 1, 0)))", "(2 * sqrt(greatest(1 + r00 - r11 - r22, 0)))", "(2 * sqrt(greatest(1 + r11 - r00 - r22, 0)))", "(2 * sqrt(greatest(1 + r22 - r00 - r11, 0)))")
_QM = [
    _TRACE.format(f"{_S[0]} / 4", f"(r21 - r12) / {_S[1]}", f"(r02 - r20) / {_S[2]}", f"(r10 - r01) / {_S[3]}"),
    _TRACE.format(f"(r21 - r12) / {_S[0]}", f"{_S[1]} / 4", f"(r01 + r10) / {_S[2]}", f"(r02 + r20) / {_S[3]}"),
    _TRACE.format(f"(r02 - r20) / {_S[0]}", f"(r01 + r10) / {_S[1]}", f"{_S[2]} / 4", f"(r12 + r21) / {_S[3]}"),
    _TRACE.format(f"(r10 - r01) / {_S[0]}", f"(r02 + r20) / {_S[1]}", f"(r12 + r21) / {_S[2]}", f"{_S[3]} / 4"),
]


@query(f"{S}, rot AS (SELECT seq, frame, {_ROT} FROM poses) SELECT seq, frame, {', '.join(f'round({q}, 5) + 0 AS {c}' for q, c in zip(_QM, _Q, strict=True))} FROM rot")
def matrix_to_quat(spark, sf_dir):
    r = po.rotation(poses(spark, sf_dir)).select("seq", "frame", *[f"r{i}{j}" for i in range(3) for j in range(3)])
    q = rounded(po.quaternion(r).select("seq", "frame", *_Q), 5)
    return q.select("seq", "frame", *[(F.col(c) + 0).alias(c) for c in _Q])


@query(f"""{S}, {_PLACED}, rot AS (SELECT *, {_ROT} FROM placed), world AS (SELECT p.seq, p.frame, p.pid, r00 * x + r01 * y + r02 * z + tx AS wx, r10 * x + r11 * y + r12 * z + ty AS wy, r20 * x + r21 * y + r22 * z + tz AS wz
FROM probes p JOIN rot USING (seq, frame) WHERE sqrt(x * x + y * y + z * z) BETWEEN 2 AND 200 AND p.pid % 2 = 0),
c AS (SELECT *, wx::FLOAT AS x, wy::FLOAT AS y, wz::FLOAT AS z FROM world WHERE wx BETWEEN -100 AND 300 AND wy BETWEEN -100 AND 300 AND wz BETWEEN -100 AND 300),
r AS (SELECT *, row_number() OVER (PARTITION BY floor(x::DOUBLE / 5)::BIGINT, floor(y::DOUBLE / 5)::BIGINT, floor(z::DOUBLE / 5)::BIGINT ORDER BY frame, pid) AS k FROM c) SELECT pid, frame::BIGINT AS frame, round(x::DOUBLE, 3) AS x, round(y::DOUBLE, 3) AS y, round(z::DOUBLE, 3) AS z FROM r WHERE k = 1""")
def raw_accumulation(spark, sf_dir):
    from .plans.accumulate import accumulate

    p = accumulate(probes(spark, sf_dir), poses(spark, sf_dir), min_range=2.0, max_range=200.0, every=2, box=(-100.0, 300.0) * 3, voxel_size=5.0)
    return rounded(p.select("pid", "frame", *[F.col(c).cast("double").alias(c) for c in "xyz"]), 3)


# --- Trials -----------------------------------------------------------------------------------------------------------

T = sql("trials")


@query(f"{T} SELECT planner, count(*) AS n, count(*) FILTER (WHERE success) AS n_ok, round(avg(success::INTEGER::DOUBLE), 6) AS rate, round(avg(metric), 4) AS mean, round(stddev_pop(metric), 4) AS std, round(avg(time_s), 4) AS time_mean, round(stddev_pop(time_s), 4) AS time_std FROM trials GROUP BY planner")
def success_stats(spark, sf_dir):
    s = st.success_stats(trials(spark, sf_dir), "planner")
    return s.select("planner", "n", "n_ok", F.round("rate", 6).alias("rate"), *[F.round(c, 4).alias(c) for c in ("mean", "std", "time_mean", "time_std")])


@query(f"{T} SELECT scene, planner, round(avg(success::INTEGER::DOUBLE), 6) AS rate, round(quantile_cont(metric, 0.5), 5) AS med, round(quantile_cont(time_s, 0.5), 7) AS time_med FROM trials GROUP BY scene, planner")
def planner_medians(spark, sf_dir):
    m = st.medians(trials(spark, sf_dir), "scene", "planner")
    return m.select("scene", "planner", F.round("rate", 6).alias("rate"), F.round("med", 5).alias("med"), F.round("time_med", 7).alias("time_med"))


_MED = "m AS (SELECT split, scene, planner, avg(success::INTEGER::DOUBLE) AS rate, quantile_cont(metric, 0.5) AS med FROM trials GROUP BY ALL)"


@query(f"{T}, {_MED} SELECT split, planner, round(avg(rate), 6) AS mean_rate, round(quantile_cont(med, 0.5), 5) AS med_of_med FROM m GROUP BY split, planner")
def split_rollup(spark, sf_dir):
    s = st.split_rollup(trials(spark, sf_dir))
    return s.select("split", "planner", F.round("mean_rate", 6).alias("mean_rate"), F.round("med_of_med", 5).alias("med_of_med"))


@query(f"{T}, {_MED} SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, planner, round(quantile_cont(med, 0.5), 5) AS med FROM m GROUP BY GROUPING SETS ((split, planner), (planner))")
def heatmap_grouping_sets(spark, sf_dir):
    return rounded(st.heatmap(trials(spark, sf_dir)), 5)


@query(f"{T}, {_MED}, hm AS (SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, planner, quantile_cont(med, 0.5) AS med FROM m GROUP BY GROUPING SETS ((split, planner), (planner))) SELECT split, round(avg(med), 4) AS mean FROM hm GROUP BY split")
def heatmap_row_means(spark, sf_dir):
    return rounded(st.heatmap_means(trials(spark, sf_dir)), 4)


@query(f"{T} SELECT scene, planner, len(v) AS n, v[1] AS first, v[len(v)] AS last, round(med, 5) AS med FROM (SELECT scene, planner, list_sort(list(metric) FILTER (WHERE metric IS NOT NULL)) AS v, quantile_cont(metric, 0.5) AS med FROM trials GROUP BY scene, planner)")
def box_plot_values(spark, sf_dir):
    v = st.value_lists(trials(spark, sf_dir), "scene", "planner")
    return v.select("scene", "planner", F.size("metrics").cast("long").alias("n"), F.col("metrics")[0].alias("first"), F.element_at("metrics", -1).alias("last"), F.round("med", 5).alias("med"))


@query(f"{T}, m AS (SELECT scene, planner, quantile_cont(metric, 0.5) AS med FROM trials GROUP BY ALL), a AS (SELECT scene, max(med) FILTER (WHERE planner = '5-LOW') AS w, max(med) FILTER (WHERE planner = '1-URGENT') AS b FROM m GROUP BY scene) SELECT scene, round(CASE WHEN b IS NOT NULL THEN w / greatest(b, 1e-6) END, 6) AS advantage FROM a ORDER BY advantage DESC NULLS LAST, scene LIMIT 2")
def smo_advantage_top2(spark, sf_dir):
    return rounded(st.top_advantage(trials(spark, sf_dir), "1-URGENT", "5-LOW"))


@query(f"{T}, r AS (SELECT *, row_number() OVER (PARTITION BY scene, planner ORDER BY trial) AS k FROM trials WHERE success) SELECT scene, planner, trial, round(metric, 4) AS metric FROM r WHERE k = 1")
def first_success(spark, sf_dir):
    return rounded(st.first_success(trials(spark, sf_dir)), 4)


@query(f"{T}, s AS (SELECT scene, row_number() OVER (PARTITION BY scene, planner ORDER BY trial)::INTEGER AS slot, success FROM trials), j AS (SELECT scene, slot, bool_and(success) AS ok, count(*) AS planners FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY slot) AS k FROM j WHERE ok) SELECT scene, slot, planners FROM n WHERE k <= 3")
def joint_success(spark, sf_dir):
    return st.joint_trials(trials(spark, sf_dir), 3)


@query(f"{T} SELECT scene, round(quantile_cont(CASE WHEN trial % 7 <> 0 THEN time_s END, 0.5), 7) AS med FROM trials GROUP BY scene")
def nan_skip_median(spark, sf_dir):
    t = trials(spark, sf_dir).withColumn("time_s", F.when(F.col("trial") % 7 == 0, F.lit(math.nan)).otherwise(F.col("time_s")))
    return rounded(t.groupBy("scene").agg(st.median(F.col("time_s")).alias("med")), 7)


# --- Stages -----------------------------------------------------------------------------------------------------------

_FR = "(VALUES " + ", ".join(f"({i}, {f}::DOUBLE)" for i, f in enumerate(sg.FRACTIONS)) + ") fr(stage, fraction)"


@query(f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS k, count(*) OVER () AS n FROM events)
SELECT stage::INTEGER AS stage, fraction, count(*) AS n_obs, round(sum(value), 3) AS total, min(value) AS least, max(value) AS most FROM {_FR} JOIN r ON r.k <= greatest(1, trunc(fraction * n)::BIGINT) GROUP BY stage, fraction""")
def stage_prefix_stats(spark, sf_dir):
    s = sg.prefix_stats(sg.staged(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", SEED), "value")
    return s.select("stage", "fraction", "n_obs", F.round("total", 3).alias("total"), "least", "most")


@query(f"WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS k, count(*) OVER () AS n FROM events) SELECT event_id, min(stage)::INTEGER AS first_stage FROM {_FR} JOIN r ON r.k <= greatest(1, trunc(fraction * n)::BIGINT) GROUP BY event_id")
def stage_shuffle(spark, sf_dir):
    return sg.staged(table(spark, sf_dir, "events").select("event_id"), "event_id", SEED).select("event_id", "first_stage")


_HASH = "(('0x' || substr(md5('42:' || i || ':{c}'), 1, 8))::BIGINT::DOUBLE / 4294967296)"


@query(f"{G}, {_BOUNDS} SELECT i::BIGINT AS qid, round(lo_x + (hi_x - lo_x) * {_HASH.format(c='x')}, 6) AS x, round(lo_y + (hi_y - lo_y) * {_HASH.format(c='y')}, 6) AS y, round((lo_z + hi_z) / 2 + ({_HASH.format(c='z')} * 2 - 1) * 0.05::DOUBLE, 6) AS z FROM box, range(3000) r(i)")
def query_box(spark, sf_dir):
    return rounded(sg.query_box(spark, 3000, _box(spark, sf_dir), SEED, 0.05))


_PART = "pb AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "xyz") + " FROM qpoints WHERE vec_id {cond})"
_INB = " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in "xyz")


def _fallback_sql(cond: str) -> str:
    return f"{G}, {_PART.format(cond=cond)}, i AS (SELECT vec_id, {_INB} AS inside FROM qpoints, pb) SELECT vec_id FROM i WHERE inside OR (SELECT count(*) FROM i WHERE inside) <= 100"


@query(_fallback_sql("% 2 = 0"))
def in_bounds_filter(spark, sf_dir):
    q = qpoints(spark, sf_dir)
    return pt.in_bounds_or_all(q, pt.bounds(q.filter("vec_id % 2 = 0"))).select("vec_id")


@query(_fallback_sql("< 4"))
def in_bounds_fallback(spark, sf_dir):
    q = qpoints(spark, sf_dir)
    return pt.in_bounds_or_all(q, pt.bounds(q.filter("vec_id < 4"))).select("vec_id")


@query(f"{G}, {_PART.format(cond='% 2 = 0')} SELECT count(*) FILTER (WHERE {_INB}) AS n_inside, count(*) AS n FROM qpoints, pb")
def in_bounds_count(spark, sf_dir):
    q = qpoints(spark, sf_dir)
    return pt.inside_count(q, pt.bounds(q.filter("vec_id % 2 = 0")))


@query(f"{P}, h AS (SELECT ok, ln, pk, sk, x, md5(concat_ws(':', '7', ok, ln, pk, sk, x::VARCHAR)) AS h FROM (SELECT ok, ln, pk, sk, round(y * 100)::BIGINT AS x FROM points)) SELECT ok, ln, pk, sk, x FROM h ORDER BY h, ok, ln, pk, sk, x LIMIT 1000")
def cloud_preview(spark, sf_dir):
    p = points(spark, sf_dir).select("ok", "ln", "pk", "sk", F.round(F.col("y") * 100).cast("long").alias("x"))
    return pt.preview(p, 1000, 7, "ok", "ln", "pk", "sk", "x")


# --- Planning ---------------------------------------------------------------------------------------------------------

#: Ends are free in the grid, and by the model with twice the grid's sharpness.
_DRAW = "('0x' || substr(md5('42:' || h || ':{end}'), 1, 8))::BIGINT % m"
_PAIRS = f"""ends AS (SELECT ix, iy, x, y, row_number() OVER (ORDER BY ix, iy) - 1 AS k, count(*) OVER () AS m FROM fm WHERE is_free AND 1 - power(1 - p, 2) < {THRESHOLD}::DOUBLE),
draws AS (SELECT h, {_DRAW.format(end='a')} AS i, {_DRAW.format(end='b')} AS j FROM range({pl.ATTEMPTS * 24}) t(h), (SELECT max(m) AS m FROM ends)),
pairs AS (SELECT a.ix AS sx_i, a.iy AS sy_i, b.ix AS gx_i, b.iy AS gy_i, a.x AS sx, a.y AS sy, b.x AS gx, b.y AS gy, h FROM draws JOIN ends a ON a.k = i JOIN ends b ON b.k = j
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN 0.25::DOUBLE AND 0.8::DOUBLE ORDER BY h LIMIT 24)"""


def _ends(spark, sf_dir, fm, reference):
    own = mx.with_occupancy(fm, mixture(spark, sf_dir), reference, 2 * LAM, POWER, "p_model").drop("density")
    return pl.free_in_both(own, "p_model", THRESHOLD)


def _plane(grid):
    return grid.join(F.broadcast(mx.nav_slice(grid, THRESHOLD).select("iz")), "iz").withColumn("is_free", F.col("p") < THRESHOLD)


def _pairs(spark, sf_dir):
    return pl.sample_pairs(_ends(spark, sf_dir, _plane(_grid(spark, sf_dir)), _reference(spark, sf_dir)), 24, 0.25, 0.8, SEED)


@query(f"{GRID}, {_SLICE}, {_PAIRS} SELECT sx_i, sy_i, gx_i, gy_i, round(sx, 6) AS sx, round(sy, 6) AS sy, round(gx, 6) AS gx, round(gy, 6) AS gy FROM pairs")
def pair_sampling(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).select("sx_i", "sy_i", "gx_i", "gy_i", "sx", "sy", "gx", "gy"))


_TRIALS = "tp AS (SELECT i AS trial, sx_i, sy_i, gx_i, gy_i FROM range(30) r(i) JOIN (SELECT *, row_number() OVER (ORDER BY h) - 1 AS k, count(*) OVER () AS m FROM pairs) p ON i % p.m = p.k)"


@query(f"{GRID}, {_SLICE}, {_PAIRS}, {_TRIALS} SELECT trial::BIGINT AS trial, sx_i, sy_i, gx_i, gy_i FROM tp")
def pair_top_up(spark, sf_dir):
    return pl.topped_up(_pairs(spark, sf_dir), 30).select("trial", "sx_i", "sy_i", "gx_i", "gy_i")


def _setting(spark, sf_dir):
    """Pairs, scene and settings of the planner queries; the grid is made once."""
    m, box, ref = mixture(spark, sf_dir), _box(spark, sf_dir), _reference(spark, sf_dir).first()[0]
    reference = spark.createDataFrame([(ref,)], "density_ref double")
    cells = mx.occupancy_grid(box, m, reference, CELLS, LAM, POWER).cache()
    nav = mx.nav_slice(cells, THRESHOLD).select("iz").first()[0]
    fm = cells.filter(F.col("iz") == nav).select("ix", "iy", "x", "y", "z", "p", (F.col("p") < THRESHOLD).alias("is_free"))
    z = fm.select("z").first()[0]
    pairs = pl.topped_up(pl.sample_pairs(_ends(spark, sf_dir, fm, reference), 24, 0.25, 0.8, SEED), 30).withColumn("scene", F.lit("nav"))
    return pairs, {"nav": pl.Scene(pl.grid_from(fm, THRESHOLD), pl.mixture_from(m, ref, LAM, POWER, z), STEP)}, _RRT


_RRT = pl.RrtConfig(step_size=0.06, max_iter=600, goal_radius=0.06, neighbor_radius=0.15, goal_bias=0.05, threshold=THRESHOLD, edge_step=STEP)


_WALK = """RECURSIVE walk(trial, ix, iy, g) USING KEY (trial, ix, iy) AS (
  SELECT trial, sx_i, sy_i, 0.0::DOUBLE FROM tp
  UNION
  SELECT c.trial, c.ix, c.iy, min(c.g) FROM (SELECT w.trial, f.ix, f.iy, w.g + CASE WHEN abs(f.ix - w.ix) + abs(f.iy - w.iy) = 2 THEN sqrt(2) ELSE 1 END AS g FROM walk w JOIN fm f ON f.is_free AND abs(f.ix - w.ix) <= 1 AND abs(f.iy - w.iy) <= 1 AND (f.ix <> w.ix OR f.iy <> w.iy)) c
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk o WHERE o.trial = c.trial AND o.ix = c.ix AND o.iy = c.iy AND o.g <= c.g + 1e-9) GROUP BY c.trial, c.ix, c.iy)"""
_COST = GRID.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_SLICE}, {_PAIRS}, {_TRIALS}, {_WALK.removeprefix('RECURSIVE ')}"
_COST_OUT = "SELECT tp.trial::BIGINT AS trial, round(w.g, 6) AS cost FROM tp LEFT JOIN walk w ON w.trial = tp.trial AND w.ix = tp.gx_i AND w.iy = tp.gy_i"


@query(f"{_COST} {_COST_OUT}")
def astar_cost(spark, sf_dir):
    pairs, scenes, rrt = _setting(spark, sf_dir)
    side = sum(scenes["nav"].grid.step) / 2
    p = pl.plan_trials(pairs, scenes, rrt, ("astar_grid",), SEED)
    return p.select("trial", F.round(F.col("cost") / side, 6).alias("cost"))


@query(f"{_COST} {_COST_OUT}")
def frontier_cost(spark, sf_dir):
    fm = mx.free_map(_grid(spark, sf_dir), THRESHOLD)
    return rounded(pl.frontier_costs(fm, pl.topped_up(_pairs(spark, sf_dir), 30)))


@query()
def rrt_star_paths(spark, sf_dir):
    """Both maps' trees, smoothed by their own tests; properties are tested."""
    pairs, scenes, rrt = _setting(spark, sf_dir)
    return pl.plan_trials(pairs, scenes, rrt, ("rrt_grid", "rrt_mixture"), SEED).drop("time_s")


@query()
def planner_comparison(spark, sf_dir):
    """Four planners on the same pairs: rate and medians of length and turns, raw and smoothed."""
    from .plans.experiments import compare_planners

    pairs, scenes, rrt = _setting(spark, sf_dir)
    return rounded(compare_planners(pairs, scenes, rrt, SEED).drop("time_med"))


def _cloud(spark, sf_dir):
    return qpoints(spark, sf_dir).select(F.col("vec_id").alias("pid"), "x", "y", "z")


@query()
def incremental_mapping(spark, sf_dir):
    """Stages of a growing cloud, a refit at each, and the error of its map on held-out positions."""
    from .plans.experiments import incremental

    return rounded(incremental(_cloud(spark, sf_dir), REVEALED, FIT_COMPONENTS, FIT_ROUNDS, FIT_CELLS, HELD_OUT, LAM, POWER, SEED, 0.05))


#: With one component a fit is known in closed form, so that SQL can follow all of the stages.
_ONE = "exp(-0.5 * (power({x} - mx, 2) / vx + power({y} - my, 2) / vy + power({z} - mz, 2) / vz)) / sqrt(power(2 * pi(), 3) * vx * vy * vz)"
_ONE_OCC = "1 - exp(-10 * greatest({d} / ({ref} + 1e-12), 0))"
_STAGES = f"""fr(stage, fraction) AS (VALUES {', '.join(f'({i}, {f}::DOUBLE)' for i, f in enumerate(REVEALED))}),
r AS (SELECT x, y, z, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS k, count(*) OVER () AS n FROM qpoints),
st AS (SELECT stage, fraction, x, y, z FROM fr JOIN r ON r.k <= greatest(1, trunc(fraction * n)::BIGINT)),
md AS (SELECT stage, fraction, count(*) AS n_obs, {', '.join(f'avg({c}) AS m{c}, var_pop({c}) + 1e-4::DOUBLE AS v{c}, min({c}) - (max({c}) - min({c})) * 0.1::DOUBLE AS lo_{c}, max({c}) + (max({c}) - min({c})) * 0.1::DOUBLE AS hi_{c}' for c in 'xyz')} FROM st GROUP BY stage, fraction),
rf AS (SELECT stage, quantile_cont({_ONE.format(x='st.x', y='st.y', z='st.z')}, 0.95) AS density_ref FROM st JOIN md USING (stage) GROUP BY stage),
box AS (SELECT * FROM md WHERE stage = {len(REVEALED) - 1}),
q AS (SELECT i AS qid, lo_x + (hi_x - lo_x) * {_HASH.format(c='x')} AS x, lo_y + (hi_y - lo_y) * {_HASH.format(c='y')} AS y, (lo_z + hi_z) / 2 + ({_HASH.format(c='z')} * 2 - 1) * 0.05::DOUBLE AS z FROM box, range({HELD_OUT}) t(i)),
tr AS (SELECT q.*, {_ONE_OCC.format(d=_ONE.format(x='q.x', y='q.y', z='q.z'), ref='rf.density_ref')} AS truth FROM q, box JOIN rf USING (stage)),
he AS (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY stage) AS many FROM (SELECT md.*, rf.density_ref, tr.x, tr.y, tr.z, truth, tr.x BETWEEN lo_x AND hi_x AND tr.y BETWEEN lo_y AND hi_y AND tr.z BETWEEN lo_z AND hi_z AS inside FROM tr, md JOIN rf USING (stage))),
ce AS (SELECT *, {', '.join(f'lo_{c} + (hi_{c} - lo_{c}) * least(greatest(round_even(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / {FIT_CELLS - 1}), 0), 0), {FIT_CELLS - 1}) / {FIT_CELLS - 1} AS c{c}' for c in 'xyz')} FROM he WHERE inside OR many <= 100)"""


@query(f"""{sql('qpoints')}, {_STAGES} SELECT stage::INTEGER AS stage, fraction, n_obs, round(avg(abs({_ONE_OCC.format(d=_ONE.format(x='x', y='y', z='z'), ref='density_ref')} - truth)), 5) AS gmm_mae,
round(avg(abs({_ONE_OCC.format(d=_ONE.format(x='cx', y='cy', z='cz'), ref='density_ref')} - truth)), 5) AS grid_mae FROM ce GROUP BY stage, fraction, n_obs""")
def incremental_one_component(spark, sf_dir):
    """incremental_mapping with one component."""
    from .plans.experiments import incremental

    out = incremental(_cloud(spark, sf_dir), REVEALED, 1, FIT_ROUNDS, FIT_CELLS, HELD_OUT, LAM, POWER, SEED, 0.05)
    return rounded(out.select("stage", "fraction", "n_obs", "gmm_mae", "grid_mae"), 5, "fraction")


_SCENES = f"""md AS (SELECT label AS scene, {', '.join(f'avg({c}) AS m{c}, var_pop({c}) + 1e-4::DOUBLE AS v{c}, min({c}) - (max({c}) - min({c})) * 0.1::DOUBLE AS lo_{c}, max({c}) + (max({c}) - min({c})) * 0.1::DOUBLE AS hi_{c}' for c in 'xyz')} FROM qpoints GROUP BY label),
rf AS (SELECT scene, quantile_cont({_ONE.format(x='x', y='y', z='z')}, 0.95) AS density_ref FROM qpoints JOIN md ON label = scene GROUP BY scene),
gr AS (SELECT scene, (i // {CELLS * CELLS})::INTEGER AS ix, (i // {CELLS} % {CELLS})::INTEGER AS iy, (i % {CELLS})::INTEGER AS iz, md.*, density_ref FROM md JOIN rf USING (scene), range({CELLS ** 3}) r(i)),
gp AS (SELECT scene, ix, iy, iz, {_ONE_OCC.format(d=_ONE.format(x=f'(lo_x + (hi_x - lo_x) * ix / {CELLS - 1})', y=f'(lo_y + (hi_y - lo_y) * iy / {CELLS - 1})', z=f'(lo_z + (hi_z - lo_z) * iz / {CELLS - 1})'), ref='density_ref')} AS p FROM gr),
sh AS (SELECT scene, iz, avg((p >= {THRESHOLD}::DOUBLE)::INTEGER::DOUBLE) AS share FROM gp GROUP BY scene, iz),
nv AS (SELECT scene, iz, row_number() OVER (PARTITION BY scene ORDER BY share DESC, iz) AS k FROM sh)"""


@query(f"{sql('qpoints')}, {_SCENES} SELECT scene::VARCHAR AS scene, true AS ok, round(avg((p < {THRESHOLD}::DOUBLE)::INTEGER::DOUBLE), 6) AS free_share, any_value(nv.iz)::INTEGER AS nav_iz, round(any_value(density_ref), 5) AS density_ref, round(sum(p), 3) AS total FROM gp JOIN nv USING (scene) JOIN rf USING (scene) WHERE nv.k = 1 GROUP BY scene")
def trained_scenes(spark, sf_dir):
    """Scenes by label, fitted with one component in one job, stored, and read back."""
    from .plans.maps import train

    target = f"{tables_folder(spark)}/maps-{uuid.uuid4().hex}"
    own = qpoints(spark, sf_dir).select(F.col("label").cast("string").alias("scene"), F.col("vec_id").alias("pid"), "x", "y", "z")
    report = train(own, target, mx.GmmParams(1), CELLS, LAM, POWER, 200_000, THRESHOLD)
    stored = lambda part, *c: spark.read.schema("scene string, " + ", ".join(c)).parquet(f"{target}/{part}")
    total = stored("grid", "p double").groupBy("scene").agg(F.sum("p").alias("total"))
    ref = stored("reference", "density_ref double")
    return report.join(total, "scene").join(ref, "scene").select("scene", "ok", F.round("free_share", 6).alias("free_share"), "nav_iz", F.round("density_ref", 5).alias("density_ref"), F.round("total", 3).alias("total"))


def _scene_maps(spark, sf_dir):
    """Four scenes of the query points, fitted with four components each, and their grids."""
    own = qpoints(spark, sf_dir).select(F.concat(F.lit("scene-"), (F.col("vec_id") % 4).cast("string")).alias("scene"), F.col("vec_id").alias("pid"), "x", "y", "z")
    models = mx.fit_each(own, mx.GmmParams(4, max_iter=FIT_ROUNDS, seed=SEED)).cache()
    references = models.select("scene", "density_ref").distinct()
    grids = mx.occupancy_grids(pt.bounds(own, 0.1, "scene"), models, references, CELLS, 2 * LAM, POWER).cache()
    return models, references, grids


@query()
def multi_scene_evaluation(spark, sf_dir):
    """Four planners on four scenes as one plan: free shares, rates and medians by scene; tested against scene by scene."""
    from .plans.experiments import evaluate_scenes, scene_table

    models, references, grids = _scene_maps(spark, sf_dir)
    table_ = scene_table(spark, [(f"s{i}", f"scene-{i}", "test" if i == 3 else "train") for i in range(4)])
    e = evaluate_scenes(table_, models, references, grids, _RRT, SEED, 20, 0.25, 0.8, LAM, POWER, STEP)
    return rounded(e.scenes.drop("time_med"))


@query()
def single_scene_evaluation(spark, sf_dir):
    """Two planners on one scene, smoothed by the mixture, with safety along their paths; times include smoothing."""
    from .plans.experiments import compare_planners, mixture_score

    pairs, scenes, rrt = _setting(spark, sf_dir)
    m = scenes["nav"].mixture
    score = mixture_score(mixture(spark, sf_dir), spark.createDataFrame([(m.reference,)], "density_ref double"), LAM, POWER, m.z)
    return rounded(compare_planners(pairs, scenes, rrt, SEED, ("rrt_mixture", "astar_grid"), score, "mixture", "all").drop("time_med"))


@query()
def incremental_planning(spark, sf_dir):
    """Stages with trials: trees on each stage's maps plan the same pairs, judged by the map of all points."""
    from .plans.experiments import incremental

    pairs, scenes, rrt = _setting(spark, sf_dir)
    own = pairs.select("trial", "sx", "sy", "gx", "gy")
    return rounded(incremental(_cloud(spark, sf_dir), REVEALED, FIT_COMPONENTS, FIT_ROUNDS, FIT_CELLS, HELD_OUT, LAM, POWER, SEED, 0.05, own, rrt, scenes["nav"].mixture.z))


# --- Sources and sinks ------------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    """A new folder below the shared one, for files that a query writes and reads again."""
    return f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file://")


@query(f"{P} SELECT ok::INTEGER AS ok, ln::SMALLINT AS ln, x::FLOAT AS x, y::FLOAT AS y, z AS z, row_number() OVER (ORDER BY ok, ln, pk, sk, x) - 1 AS pid FROM points")
def ply_round_trip(spark, sf_dir):
    """All points in order to one PLY file and back, with their record numbers."""
    from .sources.scans import register

    register(spark)
    path = _folder(spark, "ply")
    p = points(spark, sf_dir).orderBy(*POINT_ORDER).select(F.col("ok").cast("int").alias("ok"), F.col("ln").cast("short").alias("ln"), F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), "z")
    p.coalesce(1).write.format("ply").mode("append").save(path)
    return spark.read.format("ply").load(path)


@query(f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ok, ln, pk, sk, x) - 1 AS pid FROM points) SELECT frame::BIGINT AS frame, pid, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z, semantic_id::FLOAT AS intensity FROM r WHERE frame BETWEEN 1500 AND 1600")
def scan_round_trip(spark, sf_dir):
    """Raw scans written as a file a frame and read back over a range of frames, whose files alone are opened."""
    from pyspark.sql.window import Window

    from .sources.scans import register, write_scans

    register(spark)
    path = _folder(spark, "scans")
    pid = (F.row_number().over(Window.partitionBy("frame").orderBy(*POINT_ORDER)) - 1).alias("pid")
    write_scans(points(spark, sf_dir).select(F.col("frame").cast("long").alias("frame"), pid, *[F.col(c).cast("float").alias(c) for c in "xyz"], F.col("semantic_id").cast("float").alias("intensity")), path)
    return spark.read.format("velodyne").load(path).filter("frame BETWEEN 1500 AND 1600")


@query("SELECT c_custkey AS frame, c_nationkey::DOUBLE AS tx, (c_custkey % 7)::DOUBLE AS ty, 1.0::DOUBLE AS last FROM customer")
def pose_file(spark, sf_dir):
    """Poses as lines of text, half of them with three rows of the matrix and half with four, read back."""
    from .sources.scans import read_poses

    path = f"{tables_folder(spark)}/poses-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer")
    short = F.concat_ws(" ", F.col("c_custkey").cast("string"), F.lit("1 0 0"), F.col("c_nationkey").cast("string"), F.lit("0 1 0"), (F.col("c_custkey") % 7).cast("string"), F.lit("0 0 1 0"))
    c.select(F.when(F.col("c_custkey") % 2 == 0, short).otherwise(F.concat_ws(" ", short, F.lit("0 0 0 1"))).alias("value")).write.text(path)
    return read_poses(spark, path).select("frame", F.col("m")[3].alias("tx"), F.col("m")[7].alias("ty"), F.col("m")[15].alias("last"))


@query("SELECT n_name || '.zip' AS archive, 'https://example.org/' || n_name || '.zip' AS source FROM nation")
def archive_list(spark, sf_dir):
    """A JSON object of archives, written and read back."""
    from .sources.scans import archive_manifest

    path = f"{tables_folder(spark)}/archives-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("n_name", F.lit(".zip")).alias("k"), F.concat(F.lit("https://example.org/"), "n_name", F.lit(".zip")).alias("v")))).alias("archives"))
    n.select(F.to_json(F.struct("archives")).alias("value")).coalesce(1).write.text(path)
    return archive_manifest(spark, path).select("archive", "source")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in SCENES) + ") t(label, folder, split)")
def scene_list(spark, sf_dir):
    from .plans.experiments import scene_table

    return scene_table(spark, SCENES)


# --- Catalog and scalars ----------------------------------------------------------------------------------------------


@query("SELECT o_custkey % 10 AS scene, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey < 12) GROUP BY 1")
def todo_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    todo = table(spark, sf_dir, "orders").join(done, "o_custkey", "left_anti")
    return todo.groupBy((F.col("o_custkey") % 10).alias("scene")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey AS entry, n_name AS "window", CASE WHEN n_name IS NULL THEN 'no sequence or window' WHEN n_regionkey IN (0, 2) THEN NULL ELSE 'no such window' END AS reason FROM nation""")
def manifest_windows(spark, sf_dir):
    from .sources.scans import matched_windows

    n = table(spark, sf_dir, "nation")
    m = n.select(F.col("n_nationkey").alias("entry"), F.col("n_regionkey").cast("string").alias("sequence"), F.concat("n_name", F.lit(".ply")).alias("window"), F.col("n_name").isNotNull().alias("valid"))
    have = n.filter("n_regionkey IN (0, 2)").select(F.col("n_regionkey").cast("string").alias("sequence"), F.col("n_name").alias("window"))
    ok, left = matched_windows(m, have)
    return ok.select("entry", "window", F.lit(None).cast("string").alias("reason")).unionByName(left.select("entry", "window", "reason"))


@query("""SELECT s_suppkey, '2013_05_28_drive_' || lpad((s_suppkey % 20)::VARCHAR, 4, '0') || '_sync' AS sequence, '2013_05_28_drive_' || lpad((s_suppkey % 20)::VARCHAR, 4, '0') || '_sync_' || s_suppkey || '_clean.ply' AS file FROM supplier""")
def sequence_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", g.sequence_name((F.col("s_suppkey") % 20).cast("string")).alias("sequence"))
    return s.select("s_suppkey", "sequence", F.concat_ws("_", "sequence", "s_suppkey", F.lit("clean.ply")).alias("file"))


@query("SELECT p_partkey, CASE WHEN b < 1024 THEN printf('%.1fB', b) WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576) ELSE printf('%.1fGB', b / 1073741824) END AS size FROM (SELECT p_partkey, power(2, p_partkey % 36)::DOUBLE AS b FROM part)")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", g.human_size(F.pow(F.lit(2.0), F.col("p_partkey") % 36)).alias("size"))


@query(f"{GRID}, {_SLICE}, {_PAIRS} SELECT sx_i, sy_i, gx_i, gy_i, round(abs(sx_i - gx_i) + abs(sy_i - gy_i) + (sqrt(2) - 2) * least(abs(sx_i - gx_i), abs(sy_i - gy_i)), 6) AS octile FROM pairs")
def octile_heuristic(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return rounded(p.select("sx_i", "sy_i", "gx_i", "gy_i", g.octile((F.col("sx_i") - F.col("gx_i")).cast("double"), (F.col("sy_i") - F.col("gy_i")).cast("double")).alias("octile")))


@query("""WITH RECURSIVE t AS (SELECT event_id AS node, event_id // 3 AS parent FROM events), w AS (SELECT node AS start, node, 0 AS depth FROM t UNION ALL SELECT w.start, t.parent, w.depth + 1 FROM w JOIN t ON t.node = w.node WHERE w.node > 0) SELECT start, max(depth)::INTEGER AS depth, count(*) AS nodes FROM w GROUP BY start""")
def parent_chain(spark, sf_dir):
    """Walks from every node to the root of a tree of parents, by checkpointed joins: recursive queries have a limit of
    rows."""
    checkpoint_folder(spark)
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.expr("event_id div 3").alias("parent"))
    w = t.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).checkpoint()
    all_rows = w
    while not w.isEmpty():
        w = w.filter("node > 0").join(t, "node").select("start", F.col("parent").alias("node"), (F.col("depth") + 1).alias("depth")).checkpoint()
        all_rows = all_rows.unionByName(w)
    return all_rows.groupBy("start").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("nodes"))


@query("SELECT s.scene, p.planner, t.trial FROM (SELECT DISTINCT (o_custkey % 10)::INTEGER AS scene FROM orders) s, (SELECT DISTINCT o_orderpriority AS planner FROM orders) p, (SELECT i AS trial FROM range(20) r(i)) t")
def work_matrix(spark, sf_dir):
    t = trials(spark, sf_dir)
    return t.select("scene").distinct().crossJoin(F.broadcast(t.select("planner").distinct())).select("scene", "planner", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("trial"))
