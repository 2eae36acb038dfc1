"""Where intermediate tables go that must outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: On one machine only, where no folder is set.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the context's, or the one that spark.checkpoint.dir names. A cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder; the driver deletes the folder when it ends."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
