"""Where intermediate results go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where the
    setting is missing, a temporary one for a local master only: on a cluster
    the executors wouldn't share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="retrolens-")
        spark.sparkContext.setCheckpointDir(held)
    return held


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared folder (an executor may go). Unlike a
    checkpoint, the table doesn't carry over the constraints that the optimiser
    inferred, which grow exponentially with the rounds of a loop."""
    place = scratch(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def scratch(spark: SparkSession) -> str:
    """A new folder name within the shared one."""
    return f"{shared_dir(spark)}/retrolens-{uuid.uuid4().hex}"
