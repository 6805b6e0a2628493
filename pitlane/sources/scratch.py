"""Folders for what is written on the way, in the one that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own, in the one that the cluster shares; a temporary one where none is named and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return f"{(shared or tempfile.mkdtemp(prefix='pitlane-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once and read back, for what is read many times: learners and searches. ``by``: columns whose values get a folder each."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
