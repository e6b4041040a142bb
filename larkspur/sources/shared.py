"""Tables and folders that driver and executors share, for what a job needs more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder under spark.checkpoint.dir. Only a local session may do without that setting."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="larkspur-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, computed once: written as a table in the shared folder and read back. It stays there as long as the folder."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
