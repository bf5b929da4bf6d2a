"""Session factory and the settings the engine relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that decide results (time zone, ANSI) or that every plan here counts on (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def get_session(app: str = "lakeloom", cores: str | int = "*", shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session for local use and tests; on a cluster pass your own session to the operators."""
    b = SparkSession.builder.appName(app).master(os.environ.get("LAKELOOM_MASTER", f"local[{cores}]"))
    b = b.config(map=SETTINGS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | extra)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever folder they start in; returns the session.

    Workers of the same machine get the package's folder on their path. Those of a cluster
    get the package as a zip, which Spark serves to executors, also to ones that join later.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    path = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in path:
        return spark
    if not sc.master.startswith("local"):
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lakeloom"), "zip", root, "lakeloom"))
    sc.environment["PYTHONPATH"] = os.pathsep.join([root, *path])
    return spark
