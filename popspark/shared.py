"""The folder that the driver and the executors share, for checkpoints and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: what the session has, or what ``spark.checkpoint.dir`` names.

    Only where Spark runs inside one process may a temporary folder stand in for it; on a cluster a missing setting is an
    error, since executors would not see the driver's own folder.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="popspark-")
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: as ``cut``, but packed by column, which takes a fraction of the room."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
