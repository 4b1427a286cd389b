"""The session module: where intermediate tables go, and sending the package to Python workers."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from gridlark.session import checkpoint_folder, remove_tables, tables_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def pretend(master: str, **conf: str) -> SimpleNamespace:
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, other=None: conf.get(k.replace(".", "_"), other)), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(pretend(master))
    assert checkpoint_folder(pretend(master, spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"


def test_tables_go_with_the_application(spark):
    path = tables_folder(spark) + "/some"
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    remove_tables(spark)
    assert not os.path.exists(path.removeprefix("file://"))


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from gridlark.session import session
spark = session(2, 2, "1g")
from gridlark.operators.mixture import with_density_bulk
p = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
m = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "comp int, w double, mx double, my double, mz double, vx double, vy double, vz double")
print("density", round(with_density_bulk(p, m).first()["density"], 6))
"""


def test_operators_run_from_another_folder(tmp_path):
    """Python workers get the package, whatever the working folder and without a path of theirs."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "density 0.063494" in out.stdout, out.stderr[-2000:]
