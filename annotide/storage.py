"""Tables written between the rounds of an iterative job.

They lie in the folder that the cluster names in ``spark.checkpoint.dir``, which all executors share, so that a lost
executor costs a re-read and not the job. Only a local session without the setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="annotide-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return f"file://{_OWN[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one operator call. They stay as long as the session: the returned plan may read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/annotide/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Writes the rows and returns a scan of them, without any lineage."""
        path = f"{self.root}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_parts(self, df: DataFrame, label: str, part: str) -> DataFrame:
        """Writes the rows of each value of ``part`` to a folder of its own, without a shuffle."""
        df.write.mode("overwrite").partitionBy(part).parquet(f"{self.root}/{label}")
        return self.read(label, df.schema)

    def read(self, label: str, schema) -> DataFrame:
        """A scan of what was written under ``label``, its parts included."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{label}")

    def write_counted(self, df: DataFrame, label: str, *columns: str) -> tuple[DataFrame, tuple[int, int]]:
        """Writes the rows and returns their scan, their number and an order-free hash of ``columns``, all in one job."""
        seen = Observation()
        total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
        table = self.write(df.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("h")), label)
        return table, (seen.get["n"], int(seen.get["h"] or 0))

    def drop(self, label: str) -> None:
        """Deletes a table that no returned plan reads any more."""
        _delete(self.spark, f"{self.root}/{label}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
