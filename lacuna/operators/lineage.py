"""Cutting lineage so that lost executors cost no more than one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Used only where the session names no checkpoint folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/lacuna-checkpoints"


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder of this application, which all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As a Parquet table in the shared folder: smaller than a checkpoint and read by column."""
    path = f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
