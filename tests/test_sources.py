from __future__ import annotations

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.sources import scans
from gridlark.sources.ply import TYPES, PlyError, read_header


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    scans.register(spark)


LIMITS = {"char": (-128, 127), "uchar": (0, 255), "short": (-(2**15), 2**15 - 1), "ushort": (0, 2**16 - 1), "int": (-(2**31), 2**31 - 1), "uint": (0, 2**32 - 1), "float": (-1.5, 3.25), "double": (-1e300, 2e-300)}


def test_all_types_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField(f"c_{t}", TYPES[t][1], True, {"ply": t}) for t in TYPES])
    rows = [tuple(LIMITS[t][i] for t in TYPES) for i in (0, 1)] * 3
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.format("ply").mode("append").option("comments", "first\nsecond").save(f"{tmp_path}/a")
    files = [f for f in os.listdir(tmp_path / "a")]
    assert len(files) == 1 and read_header(f"{tmp_path}/a/{files[0]}").comments == ["first", "second"]
    back = spark.read.format("ply").load(f"{tmp_path}/a")
    assert [f.dataType for f in back.schema][:-1] == [f.dataType for f in schema] and back.columns[-1] == "pid"
    assert [tuple(r)[:-1] for r in back.orderBy("pid").collect()] == rows
    back.drop("pid").coalesce(1).write.format("ply").mode("append").save(f"{tmp_path}/b")
    assert [t for _, t in read_header(f"{tmp_path}/b/{os.listdir(tmp_path / 'b')[0]}").fields] == list(TYPES)


def test_large_files_are_cut(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("float").alias("x"), F.col("id").cast("double").alias("y")).coalesce(1).write.format("ply").mode("append").save(f"{tmp_path}/a")
    df = spark.read.format("ply").option("rows_per_partition", 300).load(f"{tmp_path}/a")
    assert df.rdd.getNumPartitions() == 4 and df.filter("x = pid AND y = pid").count() == 1000


def test_many_tasks_write_many_files(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("float").alias("x")).repartition(3).write.format("ply").mode("append").save(f"{tmp_path}/a")
    assert len(os.listdir(tmp_path / "a")) == 3 and spark.read.format("ply").load(f"{tmp_path}/a").count() == 100


def test_empty_table(spark, tmp_path):
    spark.range(0).select(F.col("id").cast("float").alias("x")).coalesce(1).write.format("ply").mode("append").save(f"{tmp_path}/a")
    (name,) = os.listdir(tmp_path / "a") or [None]
    assert read_header(f"{tmp_path}/a/{name}").count == 0 and spark.read.format("ply").load(f"{tmp_path}/a").count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar red\nelement face 0\nend_header\n1.5 255\n-2 0\n")
    assert [tuple(r) for r in spark.read.format("ply").load(f"{tmp_path}/a.ply").orderBy("pid").collect()] == [(1.5, 255, 0), (-2.0, 0, 1)]


@pytest.mark.parametrize("text", ["version https://git-lfs.github.com/spec/v1\n", "ply\nformat ascii 1.0\n", "ply\nformat binary_big_endian 1.0\nelement vertex 0\nproperty float x\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty float32 x\nend_header\n1\n", "ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nend_header\nabcd", "ply\nformat ascii 1.0\nelement face 1\nelement vertex 1\nproperty float x\nend_header\n"])
def test_bad_files_fail(tmp_path, text):
    (tmp_path / "a.ply").write_text(text)
    with pytest.raises(PlyError):
        read_header(f"{tmp_path}/a.ply")


def test_bad_rows_and_types_fail(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nend_header\n1\n")
    with pytest.raises(Exception, match="has 1 values"):
        spark.read.format("ply").load(f"{tmp_path}/a.ply").collect()
    with pytest.raises(Exception, match="no PLY type"):
        spark.createDataFrame([("a",)], "s string").write.format("ply").mode("append").save(f"{tmp_path}/s")
    bad = spark.createDataFrame([(300,)], T.StructType([T.StructField("r", T.ShortType(), True, {"ply": "uchar"})]))
    with pytest.raises(Exception, match="outside uchar"):
        bad.write.format("ply").mode("append").save(f"{tmp_path}/u")


def test_scans(spark, tmp_path):
    a = np.arange(24, dtype="<f4")
    for f in (3, 7, 12):
        (a + f).tofile(tmp_path / f"{f:010d}.bin")
    df = spark.read.format("velodyne").load(str(tmp_path))
    assert df.count() == 18 and sorted({r["frame"] for r in df.collect()}) == [3, 7, 12]
    assert df.filter("frame = 7 AND pid = 1").first()["intensity"] == 14
    three = spark.read.format("velodyne").option("point_dim", 3).load(str(tmp_path))
    assert three.count() == 24 and three.agg(F.max("intensity")).first()[0] == 0
    a[:7].tofile(tmp_path / "0000000099.bin")
    with pytest.raises(Exception, match="no whole points"):
        spark.read.format("velodyne").load(str(tmp_path)).count()
    assert spark.read.format("velodyne").load(str(tmp_path)).filter("frame BETWEEN 4 AND 12").count() == 12


def test_poses_and_calibration(spark, tmp_path):
    twelve = " ".join(map(str, range(12)))
    (tmp_path / "p.txt").write_text(f"4  {twelve}\n\n7 {twelve} 0 0 0 1\n")
    got = scans.read_poses(spark, f"{tmp_path}/p.txt").orderBy("frame").collect()
    assert [r["frame"] for r in got] == [4, 7] and got[0]["m"] == got[1]["m"] == [*map(float, range(12)), 0, 0, 0, 1]
    (tmp_path / "bad.txt").write_text("1 2 3\n")
    with pytest.raises(Exception, match="12 or 16"):
        scans.read_poses(spark, f"{tmp_path}/bad.txt").collect()
    (tmp_path / "c.txt").write_text("1e0 0 0 -2.5\n0 1 0 .5\n0 0 1 3 99")
    assert scans.read_calibration(spark, f"{tmp_path}/c.txt")[:, 3].tolist() == [-2.5, 0.5, 3, 1]
    (tmp_path / "r.txt").write_text("S_rect_00: 1 2\nR_rect_00: 1 0 0 0 1 0 0 0 1\n")
    assert (scans.read_rectification(spark, f"{tmp_path}/r.txt") == np.eye(4)).all()


def test_manifests(spark, tmp_path):
    for i, m in enumerate(({"a.zip": "http://h/x"}, {"archives": {"poses": "file:///d/b.zip?x=1"}})):
        (tmp_path / f"m{i}.json").write_text(json.dumps(m))
    assert tuple(scans.archive_manifest(spark, f"{tmp_path}/m0.json").first()) == ("a.zip", "http://h/x")
    assert scans.archive_manifest(spark, f"{tmp_path}/m1.json").first()["archive"] == "b.zip"
    (tmp_path / "m2.json").write_text('{"a": "b"}')
    with pytest.raises(Exception, match="no archive name"):
        scans.archive_manifest(spark, f"{tmp_path}/m2.json").collect()
    (tmp_path / "b.json").write_text(json.dumps([{"sequence": "0", "window": "w1.ply", "voxel_size": 0.2}, {"sequence": "0"}, {"sequence": "1", "window": "w9"}]))
    m = scans.batch_manifest(spark, f"{tmp_path}/b.json")
    ok, left = scans.matched_windows(m, spark.createDataFrame([("0", "w1")], "sequence string, window string"))
    assert [r["entry"] for r in ok.collect()] == [0] and {(r["entry"], r["reason"]) for r in left.collect()} == {(1, "no sequence or window"), (2, "no such window")}


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/x.txt", "new")
        z.writestr("other/y.txt", "y")
    assert scans.extract(f"{tmp_path}/a.zip", f"{tmp_path}/out", ["data/"]) == 1
    (tmp_path / "out/data/x.txt").write_text("old")
    scans.extract(f"{tmp_path}/a.zip", f"{tmp_path}/out")
    assert (tmp_path / "out/data/x.txt").read_text() == "old"
    scans.extract(f"{tmp_path}/a.zip", f"{tmp_path}/out", force=True)
    assert (tmp_path / "out/data/x.txt").read_text() == "new"
    with pytest.raises(FileNotFoundError):
        scans.extract(f"{tmp_path}/a.zip", f"{tmp_path}/out", ["none/"])
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        scans.extract(f"{tmp_path}/bad.zip", f"{tmp_path}/out")
    assert scans.fetch(f"file://{tmp_path}/a.zip", f"{tmp_path}/copy/a.zip") and not scans.fetch(f"{tmp_path}/a.zip", f"{tmp_path}/copy/a.zip")


def test_folders(tmp_path):
    for split in ("train", "test"):
        os.makedirs(tmp_path / "data_3d_semantics" / split / "s" / "static")
    (tmp_path / "data_3d_semantics/train/s/static/b.ply").write_text("")
    (tmp_path / "data_3d_semantics/train/s/static/a.ply").write_text("")
    assert scans.list_windows(str(tmp_path), "s") == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        scans.windows_folder(str(tmp_path), "s", dynamic=True)
    assert scans.first_existing([str(tmp_path / "no"), str(tmp_path)], ["x", "data_3d_semantics"]) == str(tmp_path / "data_3d_semantics")
    with zipfile.ZipFile(tmp_path / "data_poses.zip", "w") as z:
        z.writestr("data_poses/s/cam0_to_world.txt", "0")
    assert os.listdir(scans.ensure_component(str(tmp_path), "poses", "s")) == ["cam0_to_world.txt"]
    for name, kind in (("calibration", FileNotFoundError), ("poses", ValueError), ("other", ValueError)):
        with pytest.raises(kind):
            scans.ensure_component(str(tmp_path), name)
    with zipfile.ZipFile(tmp_path / "data_3d_semantics.zip", "w") as z:
        z.writestr("data_3d_semantics/test/t/static/w.ply", "x")
        z.writestr("data_3d_semantics/test/u/static/w.ply", "x")
    assert scans.ensure_component(str(tmp_path), "semantics", "t").endswith("test/t")
    assert not os.path.exists(tmp_path / "data_3d_semantics/test/u")
