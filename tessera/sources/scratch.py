"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a local folder only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return f"{named or 'file://' + tempfile.gettempdir() + '/checkpoints'}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, so that what is built on it several times is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
