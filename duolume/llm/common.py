"""What the operators share: table reads, the shared folder, word counts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(f"file://{tempfile.mkdtemp(prefix='duolume-')}")
    return _own_folder[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Of intermediate tables; a task holds one in memory.
ROW_GROUP_BYTES = 32 << 20


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**{"compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES)}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name that isn't taken for a path."""
    return f"`{name.replace('`', '``')}`"


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names."""
    return [F.col(quoted(x)) for x in df.columns]


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: What operators keep in a Python worker between tasks, by operator.
worker_caches: dict[str, dict] = {}


#: Rows of text in one Arrow batch at most.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS: texts are long, and a batch stands in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def trim_memory() -> None:
    """Gives freed memory of this Python worker back: workers live on from task to task beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of text. Frees what other operators kept in this worker, and what this task did."""
    for name in [x for x in worker_caches if x != keeps]:
        del worker_caches[name]
    trim_memory()
    for batch in batches:
        at, size = 0, 0
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= most:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)
        batch = None
    trim_memory()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
