"""Sessions, and making this package importable on the executors."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CODEFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_code(spark)


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers started from now on import this package from where the driver has it.

    On a cluster without a shared file system ship a zip of the package with ``addPyFile`` instead.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        # rows here are whole texts: a batch of 10,000 would be tens of MB on both sides of every worker
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)) == str(2**31 - 1):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
