"""A keyed store of computed rows: what is stored is read, only what is missing is computed."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "cache_key"


def cache_key(*parts: Column | str) -> Column:
    """Hash of all that a result depends on: versions, fingerprints, names, modification times. Null parts count as such, and parts can't run into each other."""
    columns = [F.lit(x) if isinstance(x, str) else x for x in parts]
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]), 256)


def fingerprint(function: Callable) -> str:
    """Changes with a function's module, name and source."""
    try:
        source = inspect.getsource(function)
    except (OSError, TypeError):
        source = ""
    name = getattr(function, "__qualname__", type(function).__qualname__)
    return hashlib.sha256(f"{getattr(function, '__module__', '')}|{name}|{source}".encode()).hexdigest()


class KeyedStore:
    """Parquet batches under a folder, with a table of commits.

    A batch counts once its commit row is written, which is after all of its rows:
    a crash in between leaves a folder that no reader looks at, and the next run
    computes those rows again. A batch may replace others (`compact`); replaced
    ones aren't read any more. The commit table has a row for each append, so it is
    small; its batches' folders are read as one table. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{KEY} string, {schema}"

    def batches(self) -> list[str]:
        """Committed batches that no other one replaces, the oldest first."""
        try:
            found = self.spark.read.schema("batch string, place int, replaces array<string>").parquet(f"{self.path}/commits").orderBy("place", "batch").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        gone = {x for row in found for x in row["replaces"]}
        return [row["batch"] for row in found if row["batch"] not in gone]

    def rows(self, batch: bool = False) -> DataFrame:
        """All stored rows; with `batch` (1, 2, ... by age) as well, if asked for."""
        names = self.batches()
        if not names:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn("batch", F.lit(0)) if batch else empty
        found = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/batches/{x}" for x in names])
        if not batch:
            return found
        place = F.create_map(*[x for k, name in enumerate(names, 1) for x in (F.lit(name), F.lit(k))])
        return found.withColumn("batch", F.element_at(place, F.regexp_extract(F.col("_metadata.file_path"), r"/batches/([^/]+)/", 1)))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Wanted rows of which the key isn't stored; only the keys of the store are read."""
        return wanted.join(self.rows().select(KEY), KEY, "left_anti")

    def append(self, new: DataFrame, replaces: list[str] | None = None) -> None:
        """Writes a batch, then its commit."""
        name = uuid.uuid4().hex
        columns = [f.name for f in self.rows().schema]
        new.select(*columns).write.parquet(f"{self.path}/batches/{name}")
        self._commit(name, replaces or [])

    def _commit(self, name: str, replaces: list[str]) -> None:
        row = [(name, len(self.batches()) + len(replaces), replaces)]
        self.spark.createDataFrame(row, "batch string, place int, replaces array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def compact(self, parts: int) -> None:
        """All batches as one of so many files; readers see either the old batches or the new one."""
        names = self.batches()
        if len(names) > 1:
            self.append(self.rows().repartition(parts, KEY).sortWithinPartitions(KEY), names)

    def complete(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Stored rows of all wanted keys, after those that were missing are computed (`compute`: missing wanted rows -> rows with their key)."""
        todo = self.missing(wanted)
        if not todo.isEmpty():
            self.append(compute(todo))
        return self.rows().join(wanted.select(KEY).distinct(), KEY, "left_semi")
