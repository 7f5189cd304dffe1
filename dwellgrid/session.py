"""Session defaults for usage analytics."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness (time zone) or for plans that hold at scale (adaptive execution).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.cache.maxEntries": "2000",  # a catalogue of queries outgrows the default of 100 classes
    "spark.sql.codegen.hugeMethodLimit": "8000",  # HotSpot leaves larger methods uncompiled
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call-site capture per expression
    "spark.ui.enabled": "false",
}


def build_session(app: str = "dwellgrid", **overrides: str) -> SparkSession:
    """Create (or fetch) a session; ``overrides`` uses ``spark_sql_x`` style keys with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cores: int | str = "*", app: str = "dwellgrid-local") -> SparkSession:
    """A single-JVM session for tests and benchmarks; shuffle width follows the cores."""
    width = os.cpu_count() if cores == "*" else int(cores)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(width))
        .config("spark.driver.memory", os.environ.get("DWELLGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without the setting, as in a test, gets a folder of its own; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="dwellgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
