"""Session defaults and the few settings every query relies on."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
from functools import cache

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(cores: int | str = "*", app: str = "litgrid", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ready_workers(spark: SparkSession) -> None:
    """Python workers started by this session find the package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, by spark.checkpoint.dir; a temporary one of this machine where none is set and it runs all tasks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="litgrid-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def ready_checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver forget what nothing refers to, so that Spark deletes its shuffle files; it does not do so before its memory is short, by when many small rounds fill the disk."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
