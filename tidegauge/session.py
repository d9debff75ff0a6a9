"""Session settings and scratch folders."""

from __future__ import annotations

import re
import tempfile
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without spark.checkpoint.dir, by application; the setting itself cannot change in a running session.
_own_folders: dict[str, str] = {}


def local_session(app: str = "tidegauge", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared folder named in spark.checkpoint.dir.

    Only a session whose driver and tasks are one process may do without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own_folders:
            _own_folders[application] = tempfile.mkdtemp(prefix="tidegauge-")
        root = _own_folders[application]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and read it back.

    The written copy survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, steps, threads: int = 4) -> list:
    """Results of independent functions, in order, run from a few driver threads so that their short jobs share the cluster."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda step: step()), list(steps), chunksize=1)
