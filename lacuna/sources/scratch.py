"""A place for intermediate tables that driver and executors share, and small tables for every task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local master gets a new one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; an application's paths lie in one folder, to be removed with it."""
    return f"{shared_dir(spark)}/lacuna/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """The same rows, written to the shared folder (in at most `parts` tasks, where given) and read again.

    Cuts the lineage, and outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that may be sent to every task.
SMALL = 100_000


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The frame (stored, so that counting it is cheap), to be broadcast if it has at most `most` rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
