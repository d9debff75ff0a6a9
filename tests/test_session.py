"""A plain local session needs no Spark configuration; other masters must name a shared folder."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tidegauge.session import scratch_dir

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
from tidegauge.operators import splits
from tidegauge.session import cut_lineage, local_session
spark = local_session(cpus="2")
assert spark.conf.get("spark.checkpoint.dir", None) is None
lines = spark.range(40).selectExpr("id AS k", "id % 7 AS v")
parts = splits.chronological_split(cut_lineage(lines), ["k"])
print("rows", parts.filter("part = 'train'").count(), cut_lineage(parts).count())
"""


def test_local_session_without_configuration(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=300)
    assert "rows 32 40" in done.stdout, done.stderr[-2000:]


def test_cluster_without_a_shared_folder_is_refused():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(cluster, "stage")
