"""Where tables between jobs are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str = "stream") -> str:
    """A folder of its own under ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = at or tempfile.gettempdir()
    return f"{at.rstrip('/')}/placerec-{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` worked out once, in a folder of its own: for small results that several steps read. The table goes with the shared folder."""
    return saved(df, shared_dir(df.sparkSession, what))


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
