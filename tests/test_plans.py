from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark import cli
from gridlark.operators.mixture import GmmParams
from gridlark.operators.stages import prefix_stats, staged
from gridlark.plans import maps
from gridlark.sources import scans
from gridlark.streaming.reveal import reveal


def cloud(spark, n=400):
    rng = np.random.default_rng(0)
    rows = [(s, i, *map(float, rng.normal(size=3) + k)) for k, s in enumerate(("a", "b")) for i in range(n)]
    return spark.createDataFrame(rows, "scene string, pid long, x double, y double, z double")


def test_training_stores_and_reports(spark, tmp_path):
    from gridlark.session import ship

    ship(spark)
    bad = spark.createDataFrame([("c", 1, float("nan"), 0.0, 0.0)], "scene string, pid long, x double, y double, z double")
    out = maps.train(cloud(spark).unionByName(bad), str(tmp_path), GmmParams(3, max_iter=4), 6, 20.0, 1.0, 300, 0.35, narrow=True)
    got = {r["scene"]: r for r in out.collect()}
    assert got["a"]["ok"] and got["b"]["ok"] and 0 <= got["a"]["free_share"] <= 1
    grid = spark.read.parquet(f"{tmp_path}/grid")
    assert grid.filter("scene = 'a'").count() == 216 and dict(grid.dtypes)["p"] == "float"
    p = maps.query_map(spark, str(tmp_path), "a", cloud(spark).filter("scene = 'a'").select("x", "y", "z"), 20.0, 1.0)
    assert p.filter("p >= 0 AND p <= 1").count() == 400
    todo = maps.untrained(cloud(spark).select("scene").distinct(), spark.read.parquet(f"{tmp_path}/gmm").filter("scene = 'a'"))
    assert [r["scene"] for r in todo.collect()] == ["b"]


def test_clouds_are_thinned_and_scaled(spark, tmp_path):
    scans.register(spark)
    df = spark.range(100).select(*[(F.col("id") % 10).cast("float").alias(c) for c in "xyz"], F.lit(255).cast("short").alias("red"))
    df.coalesce(1).write.format("ply").mode("append").save(f"{tmp_path}/a")
    few, every = maps.load_cloud(spark, f"{tmp_path}/a", 0.5, 4, 0)
    assert few.count() == 4 and every.count() == 100 and every.first()["red"] == 1.0 and dict(every.dtypes)["x"] == "double"
    assert maps.load_cloud(spark, f"{tmp_path}/a", None, 1000, 0)[0].count() == 100


def test_scene_table(spark):
    from gridlark.plans.experiments import scene_table

    assert scene_table(spark, [("0a", "f", "train")]).first()["split"] == "train"


def test_stages_are_cumulative(spark):
    df = spark.range(1000).select(F.col("id").alias("pid"), F.lit(1.0).alias("v"))
    s = staged(df, "pid", 42, (0.0, 0.1, 0.5, 1.0))
    got = prefix_stats(s, "v", (0.0, 0.1, 0.5, 1.0)).orderBy("stage").collect()
    assert [r["n_obs"] for r in got] == [1, 100, 500, 1000] and [r["total"] for r in got] == [1, 100, 500, 1000]


def test_stream_refits_at_each_stage(spark, tmp_path):
    from gridlark.session import ship

    ship(spark)
    p = cloud(spark, 150).filter("scene = 'a'").select("pid", "x", "y", "z")
    for i in range(3):
        p.filter(F.col("pid") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: reveal(spark, f"{tmp_path}/in", p.schema, f"{tmp_path}/seen", f"{tmp_path}/out", f"{tmp_path}/state", GmmParams(2, max_iter=3))
    run().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("stage").collect()
    assert [r["n_obs"] for r in got] == [50, 100, 150] and all(r["components"] == 2 for r in got)
    run().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


@pytest.fixture
def dataset(spark, tmp_path):
    """A tree of the dataset with one window, two scans, poses and a calibration."""
    scans.register(spark)
    seq = "2013_05_28_drive_0000_sync"
    folder = tmp_path / "data_3d_semantics/train" / seq / "static"
    os.makedirs(folder)
    p = spark.range(200).select((F.col("id") % 10).cast("float").alias("x"), (F.col("id") / 50).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), (F.col("id") % 4).cast("int").alias("semantic"), (F.col("id") % 2).cast("short").alias("visible"))
    p.coalesce(1).write.format("ply").mode("append").save(str(tmp_path / "w"))
    os.rename(next((tmp_path / "w").glob("*.ply")), folder / "0000000002_0000000385.ply")
    raw = tmp_path / "data_3d_raw" / seq / "velodyne_points/data"
    os.makedirs(raw)
    for f in (1, 2):
        np.array([[3, 0, 0, 1], [50, 0, 0, 1], [np.nan, 0, 0, 1]], "<f4").tofile(raw / f"{f:010d}.bin")
    os.makedirs(tmp_path / "data_poses" / seq)
    (tmp_path / "data_poses" / seq / "cam0_to_world.txt").write_text("1 1 0 0 100 0 1 0 0 0 0 1 0\n")
    os.makedirs(tmp_path / "calibration")
    (tmp_path / "calibration/calib_cam_to_velo.txt").write_text("1 0 0 0 0 1 0 0 0 0 1 0")
    return tmp_path


def test_command_line(spark, dataset, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *a: spark)
    root = str(dataset)
    cli.main(["list-windows", "--root", root, "--sequence", "0"])
    assert capsys.readouterr().out.strip() == "0000000002_0000000385"
    cli.main(["prepare-fused", "--root", root, "--sequence", "0", "--window", "0000000002_0000000385.ply", "--out", root + "/clean", "--crop", "0,4,0,9,-1,1", "--visible-only", "--keep-semantic-ids", "1,3", "--voxel-size", "0.5", "--xyz-only"])
    got = spark.read.format("ply").load(root + "/clean")
    assert got.columns == ["x", "y", "z", "pid"] and got.agg(F.max("x")).first()[0] <= 4 and got.filter("x % 2 = 0").count() == 0
    cli.main(["build-from-raw", "--root", root, "--sequence", "0", "--out", root + "/raw", "--min-range", "1", "--max-range", "20", "--add-frame-field"])
    raw = spark.read.format("ply").load(root + "/raw").collect()
    assert sorted((r["x"], r["frame"]) for r in raw) == [(103.0, 1), (103.0, 2)]
    (dataset / "m.json").write_text('[{"sequence": "0", "window": "0000000002_0000000385", "voxel_size": 1.0}, {"sequence": "0"}, {"sequence": "0", "window": "none"}]')
    cli.main(["batch-export", "--manifest", root + "/m.json", "--root", root, "--out-dir", root + "/batch"])
    said = capsys.readouterr().out
    assert "3 entries" in said and said.count("skipped") == 2 and len(os.listdir(root + "/batch")) == 1
    cli.main(["build-map", "--ply", root + "/clean", "--out", root + "/map", "--components", "2", "--max-iter", "3", "--cells", "4", "--fit-voxel", "0"])
    assert spark.read.parquet(root + "/map/grid").count() == 64


def test_training_and_evaluation_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *a: spark)
    scans.register(spark)
    p = cloud(spark, 300)
    os.makedirs(tmp_path / "in")
    for s in "ab":
        p.filter(F.col("scene") == s).select("x", "y", "z").coalesce(1).write.format("ply").mode("append").save(f"{tmp_path}/{s}")
        os.rename(next((tmp_path / s).glob("*.ply")), tmp_path / "in" / f"{s}.ply")
    cli.main(["train", "--ply", f"{tmp_path}/in", "--out", f"{tmp_path}/maps", "--components", "2", "--max-iter", "5", "--cells", "8"])
    assert "|   2|  2|" in capsys.readouterr().out
    cli.main(["evaluate", "--maps", f"{tmp_path}/maps", "--out", f"{tmp_path}/eval", "--scenes", "A:a:train,B:b:test", "--trials", "2", "--iterations", "40", "--min-dist", "0.5", "--max-dist", "4", "--step", "0.5", "--goal-radius", "0.6", "--neighbor-radius", "1.5", "--threshold", "0.9"])
    assert "advantage" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/eval/trials").count() == 16


@pytest.mark.parametrize("text", ["1,2,3", "2,1,0,1,0,1"])
def test_bad_crops(text):
    with pytest.raises(ValueError):
        cli.crop(text)


def test_growing_maps_have_all_stages_and_pairs(spark, monkeypatch):
    from gridlark import catalog
    from gridlark.plans import experiments

    class Seen(Exception):
        pass

    def seen(*args):
        raise Seen(*args)

    monkeypatch.setattr(experiments, "incremental", seen)
    for name in ("incremental_mapping", "incremental_planning"):
        with pytest.raises(Seen) as e:
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        _, fractions, components, rounds, cells, held, *rest = e.value.args
        assert fractions == (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
        assert (components, rounds, cells, held) == (32, 60, 64, 3000)
        if name == "incremental_planning":
            assert rest[4].count() == 30


def test_unfitted_models_are_not_stored(spark, tmp_path):
    from gridlark.operators.mixture import fit_each

    bad = spark.createDataFrame([("c", 1, float("inf"), 0.0, 0.0)], "scene string, pid long, x double, y double, z double")
    with pytest.raises(ValueError, match="not fitted: c"):
        maps.save_models(fit_each(bad, GmmParams(2)), str(tmp_path))


def test_training_options(spark, tmp_path):
    """Elapsed times in order, the count of trained scenes, sharpened components, and grids over all points."""
    from gridlark.operators.points import bounds

    points = cloud(spark)
    a = maps.train(points, f"{tmp_path}/a", GmmParams(2, max_iter=5), 4, 20.0, 1.0, 50, 0.35)
    rows = a.collect()
    assert [r["elapsed_s"] for r in rows] == sorted(r["elapsed_s"] for r in rows) and maps.trained(a).first()["n_ok"] == 2
    maps.train(points, f"{tmp_path}/b", GmmParams(2, max_iter=5), 4, 20.0, 1.0, 50, 0.35, sharpen=0.5, whole_bounds=True)
    v = [{(r["scene"], r["comp"]): r["vx"] for r in spark.read.parquet(f"{tmp_path}/{d}/gmm").collect()} for d in "ab"]
    assert all(v[1][k] == pytest.approx(x / 4) for k, x in v[0].items())
    refs = [sorted(r["density_ref"] for r in spark.read.parquet(f"{tmp_path}/{d}/reference").collect()) for d in "ab"]
    assert refs[0] == pytest.approx(refs[1])
    most = spark.read.parquet(f"{tmp_path}/b/grid").groupBy("scene").agg(F.max("x").alias("x"))
    want = bounds(points, 0.1, "scene").select("scene", "hi_x")
    assert all(r["x"] == pytest.approx(r["hi_x"]) for r in most.join(want, "scene").collect())


def test_fits_in_tasks_equal_the_distributed_fit(spark):
    """From the same start both go the same way: with one component to the same model."""
    from gridlark.operators.mixture import fit, fit_each, reference_density

    p = cloud(spark)
    one = {r["scene"]: r for r in fit_each(p, GmmParams(1)).collect()}
    for r in fit(p, GmmParams(1))[0].collect():
        assert all(one[r["scene"]][c] == pytest.approx(r[c]) for c in ("w", "mx", "my", "mz", "vx", "vy", "vz"))
    own = p.filter("scene = 'a'")
    ref = reference_density(own, fit_each(own, GmmParams(1)), "pid").first()[0]
    assert one["a"]["density_ref"] == pytest.approx(ref)


def test_evaluation_of_scenes_equals_scene_by_scene(spark):
    from gridlark import catalog
    from gridlark.operators import planners as pl
    from gridlark.plans import experiments as ex

    sf = "/root/testdata/sf0.001"
    models, references, grids = catalog._scene_maps(spark, sf)
    rows = [("a", "scene-0", "train"), ("b", "scene-1", "train"), ("c", "scene-3", "test")]
    rrt = pl.RrtConfig(0.06, 60, 0.06, 0.15, 0.05, 0.35, 0.02)
    run = lambda rs: ex.evaluate_scenes(ex.scene_table(spark, rs), models, references, grids, rrt, 42, 4, 0.25, 0.8, 10.0, 1.0, 0.02, ("astar_grid", "rrt_mixture"))
    whole = run(rows)
    got = {(r["scene"], r["planner"]): r for r in whole.scenes.collect()}
    assert len(got) == 6 and {r["split"] for r in whole.splits.collect()} == {"train", "test"} and whole.top.count() == 2
    for row in rows[:2]:
        for r in run([row]).scenes.collect():
            assert all(r[c] == got[r["scene"], r["planner"]][c] for c in ("n", "rate", "raw_length", "raw_turns", "max_occ", "free_pct", "model_free_pct"))
    assert whole.trials.filter("success").count() > 0


def test_stages_with_trials(spark):
    from gridlark.operators import planners as pl
    from gridlark.plans.experiments import incremental

    p = cloud(spark, 300).filter("scene = 'a'").select("pid", "x", "y", "z")
    pairs = spark.createDataFrame([(i, -2.5, -2.5, 2.5, float(i)) for i in range(3)], "trial long, sx double, sy double, gx double, gy double")
    rrt = pl.RrtConfig(0.5, 150, 0.6, 1.5, 0.1, 0.9, 0.2)
    out = incremental(p, (0.2, 1.0), 2, 10, 8, 200, 10.0, 1.0, 1, 0.2, pairs, rrt, 0.0, cap=100).collect()
    assert [r["n_obs"] for r in out] == [60, 300] and all(0 <= r["gmm_success"] <= 1 and 0 <= r["grid_success"] <= 1 for r in out)
    assert all(0 < r["update_s_gmm"] < r["update_s_grid"] and 0 <= r["gmm_mae"] <= 1 for r in out)


def test_cleaned_windows_keep_the_order_of_records(spark, tmp_path):
    scans.register(spark)
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), 0.0) for a, b in rng.integers(0, 30, (500, 2))]
    spark.createDataFrame(rows, "x float, y float, z float").coalesce(1).write.format("ply").mode("append").save(f"{tmp_path}/a")
    maps.prepare_fused(spark, f"{tmp_path}/a", f"{tmp_path}/b", voxel_size=1.0)
    files = sorted(f for f in os.listdir(tmp_path / "b") if f.endswith(".ply"))
    got = [tuple(r)[:2] for f in files for r in spark.read.format("ply").load(f"{tmp_path}/b/{f}").orderBy("pid").collect()]
    assert got == list(dict.fromkeys(r[:2] for r in rows))
