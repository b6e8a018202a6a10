"""Written intermediate tables: read many times, computed once, safe when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``; where the session names none, kept by Spark itself."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; in local mode without one, in a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{root.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"
