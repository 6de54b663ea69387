"""Session settings that every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike; sizes are left to the caller's cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("annotide")
    conf = {**SETTINGS, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus), **extra}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> str:
    """Sends this package to the executors of a running cluster, as a zip file; returns its path on the driver.

    Needed where the executors have not installed it: functions over Arrow batches are imported there by name.
    """
    import shutil
    import tempfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="annotide-package-")
    path = shutil.make_archive(f"{folder}/annotide", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(path)
    return path
