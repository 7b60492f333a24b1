"""Written intermediate tables: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of rows in one Arrow batch between the JVM and Python; a longer row is a batch of its own.
BATCH_BYTES = 4_000_000
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30, "t": 2**40, "tb": 2**40}


def byte_size(setting: str) -> int:
    """The bytes of a setting such as ``4m``; -1 (no bound) where it is no such size."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", setting.lower())
    return int(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else -1


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, so that tasks with long texts hold few of them at once.

    Results are lazy, so the setting must hold until they are read and stays; a smaller one of the caller is kept.
    """
    if not 0 < byte_size(spark.conf.get(BATCH_LIMIT)) <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. On a cluster it must be set; a local session gets a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="matchgrain-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
