"""What operators need of a session."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. A temporary folder takes its place only
    where all run on one machine; elsewhere it is an error that none is named."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lakewatch-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of the application's in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lakewatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Python workers import this package from PYTHONPATH; where it isn't on it, they get a zip of it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lakewatch_shipped", False):
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lakewatch"), "zip", root, "lakewatch"))
    sc._lakewatch_shipped = True
