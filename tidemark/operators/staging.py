"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: dict[str, str] = {}


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read back: it is worked out once, and a lost executor costs a re-read. Only local masters may leave the setting out."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    path = f"{base}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
