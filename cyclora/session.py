"""Sessions, tables, and cutting lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def session(name: str = "cyclora", cores: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested under. On a cluster, pass your own session instead."""
    n = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


class Tables:
    """The Parquet tables of a folder, by name: Tables(spark, folder).events."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def ship(module: str) -> None:
    """Sends the module's functions to executors by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session (as in tests)
    gets one, which goes at the end; a cluster, whose executors could not see it, raises ValueError."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Written tables of an iteration, in a folder of its own in the shared one. Unlike a checkpoint a table that is read back has the
    size of its files to the planner: estimates carried over multiply at each join, over many rounds beyond all bounds. `done`
    makes a result durable and deletes the folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.folder}/{self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def done(self, df: DataFrame) -> DataFrame:
        out, path = durable(df), self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out
