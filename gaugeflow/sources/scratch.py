"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the folder in ``spark.checkpoint.dir`` and read back, which cuts its lineage and outlives executors.

    Where that is unset, a folder of its own is taken if Spark runs in one process, and an error raised otherwise.
    """
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gaugeflow-")
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/gaugeflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
