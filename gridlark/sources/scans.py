"""Raw scans, poses, calibrations and manifests."""

from __future__ import annotations

import os
import shutil
import urllib.parse
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .ply import BATCH, files_of

SCAN = T.StructType([T.StructField("frame", T.LongType()), T.StructField("pid", T.LongType()), *[T.StructField(c, T.FloatType()) for c in ("x", "y", "z", "intensity")]])


@dataclass
class ScanFile(InputPartition):
    path: str
    frame: int


class VelodyneReader(DataSourceReader):
    """One partition a file; frames are told from file names, so predicates on `frame` skip files unread."""

    def __init__(self, options: dict):
        self.width = int(options.get("point_dim", 4))
        if self.width not in (3, 4):
            raise ValueError("point_dim is 3 or 4")
        self.files = [ScanFile(p, int(os.path.splitext(os.path.basename(p))[0])) for p in files_of(options["path"], ".bin")]

    def pushFilters(self, filters):
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            test = tests.get(type(f))
            if test is not None and f.attribute == ("frame",) and f.value is not None:
                self.files = [x for x in self.files if test(x.frame, f.value)]
            else:
                yield f

    def partitions(self) -> list[ScanFile]:
        return self.files or [ScanFile("", 0)]

    def read(self, part: ScanFile) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        size = os.path.getsize(part.path)
        if size % 4 or size // 4 % self.width:
            raise ValueError(f"{part.path}: {size} bytes are no whole points of {self.width} floats")
        with open(part.path, "rb") as f:
            first = 0
            while block := f.read(BATCH * self.width * 4):
                a = np.frombuffer(block, "<f4").reshape(-1, self.width)
                n = len(a)
                intensity = a[:, 3] if self.width == 4 else np.zeros(n, np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.frame)), pa.array(np.arange(first, first + n)), *[pa.array(np.ascontiguousarray(a[:, i])) for i in range(3)], pa.array(np.ascontiguousarray(intensity))], names=SCAN.names)
                first += n


class VelodyneDataSource(DataSource):
    """format("velodyne"): flat little-endian floats, point_dim (4, or 3 without intensity) for each point."""

    @classmethod
    def name(cls) -> str:
        return "velodyne"

    def schema(self) -> T.StructType:
        return SCAN

    def reader(self, schema: T.StructType) -> VelodyneReader:
        return VelodyneReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats ply and velodyne known to the session, and lets Python sources see predicates."""
    from ..session import ship
    from .ply import PlyDataSource

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlyDataSource)
    spark.dataSource.register(VelodyneDataSource)


def read_poses(spark: SparkSession, path: str, rows: int = 4) -> DataFrame:
    """frame, m (16 doubles) from lines of a frame and a 3 by 4 or 4 by 4 matrix."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    n = F.transform(parts, lambda x: x.cast("double"))
    d = spark.read.text(path).filter(F.trim("value") != "").select(n.alias("v"))
    m = F.slice("v", 2, 4 * rows)
    whole = F.when(F.size(m) == 12, F.concat(m, F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))).when(F.size(m) == 16, m)
    return d.select(F.col("v")[0].cast("long").alias("frame"), F.coalesce(whole, F.raise_error(F.lit("a pose needs 12 or 16 numbers")).cast("array<double>")).alias("m"))


FLOAT = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def read_calibration(spark: SparkSession, path: str) -> np.ndarray:
    """The first twelve numbers of the file as a 4 by 4 matrix."""
    found = spark.read.text(path, wholetext=True).select(F.slice(F.regexp_extract_all("value", F.lit(f"({FLOAT})"), F.lit(1)), 1, 12).alias("v")).first()["v"]
    if len(found) < 12:
        raise ValueError(f"{path} has {len(found)} numbers, twelve are needed")
    return np.vstack([np.array(found, float).reshape(3, 4), [0, 0, 0, 1]])


def read_rectification(spark: SparkSession, path: str) -> np.ndarray:
    """The R_rect_00 line as a 4 by 4 matrix."""
    line = spark.read.text(path).filter(F.col("value").startswith("R_rect_00:")).first()
    if line is None:
        raise ValueError(f"{path} has no R_rect_00")
    out = np.eye(4)
    out[:3, :3] = np.array(line["value"].split(":", 1)[1].split(), float).reshape(3, 3)
    return out


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """archive, source from a JSON object, plain or below `archives`; the archive's name is told by the key, or else by
    the source's last part. Entries that name no .zip are an error."""
    raw = spark.read.text(path, wholetext=True)
    own = F.from_json("value", "map<string,string>")
    inner = F.from_json(F.get_json_object("value", "$.archives"), "map<string,string>")
    e = raw.select(F.explode(F.coalesce(inner, own)).alias("k", "source"))
    base = F.element_at(F.split(F.regexp_replace("source", r"[?#].*$", ""), "/"), -1)
    name = F.when(F.lower("k").endswith(".zip"), F.col("k")).when(F.lower(base).endswith(".zip"), base)
    return e.select(F.coalesce(name, F.raise_error(F.concat(F.lit("no archive name for "), F.col("k")))).alias("archive"), "source")


BATCH_SCHEMA = "sequence string, window string, crop string, voxel_size double, keep_semantic_ids string, drop_semantic_ids string"


def batch_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry of the JSON array, with its place; entries without sequence or window are flagged."""
    e = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in BATCH_SCHEMA.split(', '))}>>", {"mode": "FAILFAST"}).alias("a"))
    return e.select(F.posexplode("a").alias("entry", "e")).select("entry", "e.*").withColumn("valid", F.col("sequence").isNotNull() & F.col("window").isNotNull())


def matched_windows(manifest: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries whose window exists (window names with or without .ply), and the ones that are left out, with a reason."""
    stem = F.regexp_replace("window", r"\.ply$", "")
    m = manifest.withColumn("window", stem)
    ok = m.filter("valid").join(windows.withColumn("window", stem), ["sequence", "window"], "inner")
    missing = m.filter("valid").join(windows.withColumn("window", stem), ["sequence", "window"], "left_anti").withColumn("reason", F.lit("no such window"))
    bad = m.filter("NOT valid").withColumn("reason", F.lit("no sequence or window"))
    return ok, missing.unionByName(bad)


# --- Files (driver side) ----------------------------------------------------------------------------------------------


def sequence_folder(name: str | int) -> str:
    """A drive number, or a full name, as the sequence's folder name."""
    text = str(name)
    return text if text.startswith("2013_05_28_drive_") and text.endswith("_sync") else f"2013_05_28_drive_{int(text):04d}_sync"


def fetch(source: str, target: str, force: bool = False) -> bool:
    """Copies a local path, a file:// or an http(s):// address to `target`; False if it is there already."""
    if os.path.exists(target) and not force:
        return False
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part = target + ".part"
    kind = urllib.parse.urlparse(source)
    if kind.scheme in ("http", "https"):
        with urllib.request.urlopen(source) as r, open(part, "wb") as f:  # noqa: S310
            shutil.copyfileobj(r, f, 1 << 20)
    else:
        shutil.copyfile(urllib.request.url2pathname(kind.path) if kind.scheme == "file" else source, part)
    os.replace(part, target)
    return True


def extract(archive: str, target: str, prefixes: Sequence[str] | None = None, force: bool = False) -> int:
    """Extracts members that begin with one of `prefixes` (all, without any); files that exist are kept unless force.
    Members that would leave the target are refused; no match is an error. Returns the number of matching files."""
    root, n = os.path.realpath(target), 0
    with zipfile.ZipFile(archive) as z:
        for m in z.infolist():
            if m.is_dir() or prefixes and not m.filename.startswith(tuple(prefixes)):
                continue
            to = os.path.realpath(os.path.join(root, m.filename))
            if os.path.commonpath([root, to]) != root:
                raise ValueError(f"{m.filename} leaves the target folder")
            n += 1
            if os.path.exists(to) and not force:
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with z.open(m) as src, open(to, "wb") as f:
                shutil.copyfileobj(src, f, 1 << 20)
    if not n:
        raise FileNotFoundError(f"no member of {archive} begins with {prefixes}")
    return n


def first_existing(roots: Sequence[str], names: Sequence[str]) -> str | None:
    """The first file that exists, roots before names."""
    return next((p for r in roots for n in names if os.path.exists(p := os.path.join(r, n))), None)


@dataclass(frozen=True)
class Component:
    """A part of the dataset: archives that may hold it (in order of preference), the folders whose presence says that
    it is there, and the members to extract (all, without any)."""

    archives: tuple[str, ...]
    folders: tuple[str, ...]
    members: tuple[str, ...] = ()


#: Names within the dataset; {seq} stands for the sequence.
COMPONENTS = {
    "calibration": Component(("calibration.zip",), ("calibration",)),
    "poses": Component(("data_poses.zip",), ("data_poses/{seq}",), ("data_poses/{seq}/",)),
    "semantics": Component(("data_3d_semantics.zip", "data_3d_semantics_train.zip"), ("data_3d_semantics/train/{seq}", "data_3d_semantics/test/{seq}"), ("data_3d_semantics/train/{seq}/", "data_3d_semantics/test/{seq}/")),
    "raw_velodyne": Component(("{seq}_velodyne.zip",), ("data_3d_raw/{seq}/velodyne_points/data",)),
}


def ensure_component(root: str, component: str, sequence: str | None = None, force: bool = False) -> str:
    """The component's folder, extracted from an archive in root/archives, root or here, if it is not there yet. A
    folder that exists is returned as it is, even with force."""
    if component not in COMPONENTS:
        raise ValueError(f"unknown component {component}")
    c = COMPONENTS[component]
    if sequence is None and "{seq}" in c.folders[0]:
        raise ValueError(f"{component} needs a sequence")
    named = lambda texts: [t.format(seq=sequence) for t in texts]
    found = first_existing([root], named(c.folders))
    if found is None:
        archive = first_existing([os.path.join(root, "archives"), root, "."], named(c.archives))
        if archive is None:
            raise FileNotFoundError(f"no {' or '.join(named(c.archives))} in {root}/archives or {root}")
        extract(archive, root, named(c.members) or None, force)
        found = first_existing([root], named(c.folders))
    return found or os.path.join(root, named(c.folders)[0])


def windows_folder(root: str, sequence: str, dynamic: bool = False) -> str:
    """The folder of a sequence's fused windows: the train split before the test split."""
    for split in ("train", "test"):
        p = os.path.join(root, "data_3d_semantics", split, sequence, "dynamic" if dynamic else "static")
        if os.path.isdir(p):
            return p
    raise FileNotFoundError(f"no {'dynamic' if dynamic else 'static'} windows of {sequence}")


def list_windows(root: str, sequence: str, dynamic: bool = False) -> list[str]:
    """Names of the windows, sorted."""
    return [os.path.splitext(os.path.basename(p))[0] for p in files_of(windows_folder(root, sequence, dynamic))]


def list_frames(folder: str) -> list[tuple[int, str]]:
    return [(int(os.path.splitext(os.path.basename(p))[0]), p) for p in files_of(folder, ".bin")]


def write_scans(df: DataFrame, path: str) -> None:
    """Writes scans (frame, pid, x, y, z, intensity) as one file a frame, flat little-endian floats in the order of pid;
    each frame is written by a task, under a name of its own that it gets when it is whole."""
    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pid")
        frame = int(t["frame"].iloc[0])
        part = os.path.join(folder, f".{frame:010d}-{uuid.uuid4().hex}")
        t[["x", "y", "z", "intensity"]].to_numpy("<f4").tofile(part)
        os.replace(part, os.path.join(folder, f"{frame:010d}.bin"))
        return pd.DataFrame({"frame": [frame], "rows": [len(t)]})

    df.select("frame", "pid", "x", "y", "z", "intensity").groupBy("frame").applyInPandas(one, "frame long, rows long").write.format("noop").mode("overwrite").save()
