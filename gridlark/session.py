"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: set[str] = set()


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridlark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def own_folder(prefix: str) -> str:
    """A new folder of this process, which goes with it."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the folder the context already has. Only a session
    whose executors run in this process may be without one: it gets a folder of this process, elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: the master is {sc.master}")
        sc.setCheckpointDir("file://" + own_folder("gridlark-"))
    return sc.getCheckpointDir().rstrip("/")


def tables_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables go, below the shared folder; it goes with the process."""
    path = f"{checkpoint_folder(spark)}/tables/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(remove_tables, spark)
    return path


def remove_tables(spark: SparkSession) -> None:
    """Removes this application's intermediate tables; frames that read them cannot be used any more."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/tables/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, batches: Callable, schema) -> DataFrame:
    """df.mapInArrow() of a function that imports this package: its sources are sent first."""
    ship(df.sparkSession)
    return df.mapInArrow(batches, schema)


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application, so that their Python workers can
    import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    files = sorted(p for p in root.rglob("*.py"))
    digest = hashlib.md5(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    path = os.path.join(own_folder("gridlark-py-"), f"gridlark-{digest}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
