"""Where queries land files that they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder where the cluster's checkpoints go; a temporary one only in a local session where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{named.rstrip('/')}/landed-{uuid.uuid4().hex}" if named else f"{tempfile.mkdtemp(prefix='tidemark-landed-')}/data-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows from files, so that what they were made from can go."""
    path = f"{new_folder(rows.sparkSession)}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)
