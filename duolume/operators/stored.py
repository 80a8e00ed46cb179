"""Intermediate tables in the shared folder, for results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path below spark.checkpoint.dir that nothing uses yet.

    Where the setting is missing, local mode takes a temporary folder and a cluster gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='duolume-core-')}")
        root = _own[0]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, **options: str | int) -> DataFrame:
    """Writes a table to a new folder (`options`: of the writer) and reads it back: computed once, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
