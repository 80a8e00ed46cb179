"""Exact nearest neighbours of all rows: cells around sampled centres, and bounds by the triangle inequality. Stated queries against all rows, by blocks or as a stream."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .ranks import global_rank
from .stored import stored

#: Centres that go to all tasks; with 64 dimensions about 2 MB.
MOST_CENTRES = 4_096
#: Cells of a chunk of vectors that are compared at once.
_CHUNK = 2_048
#: Rows of a packed block, and rows that are compared at once with a query.
_PACKED, _COMPARED = 512, 8_192
#: Bytes of distances that a task holds; one query's at least. Bytes of an Arrow batch, which stands in the JVM and in Python at once.
HELD, BATCH = 1 << 27, 1 << 24
#: For rounding: bounds are widened by it.
_SLACK = 1e-9


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dims)


def nearest_neighbours(vectors: DataFrame, id_col: str, column: str, k: int, centres: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(q, c, r): the k nearest rows c of every row q with their rank by distance, then id; and the pairs looked at (v, w: equal vectors are one).

    Vectors (arrays of doubles, all of one length; rows without one are left out) that
    are equal are looked at once, with their k least ids. Each goes to the cell of its
    nearest centre; centres are a sample of about the root of the rows. The kth
    distance within the own cell bounds the search: by the triangle inequality a cell
    with radius R around c has no nearer row if d(q, c) - R is above the bound, nor is
    any row x of it nearer if |d(q, c) - d(x, c)| is. Cells and rows that are left are
    joined by cell, a join that Spark splits where a cell is large.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("vec")).filter("vec is not null")
    least = Window.partitionBy("vec").orderBy("id")
    copies = rows.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k).select(F.xxhash64("vec").alias("hash"), "vec", "id")
    distinct = stored(rows.groupBy("vec").agg(F.min("id").alias("v")), "vectors")
    n = distinct.count()
    if not n:
        empty = rows.select(F.col("id").alias("q"), F.col("id").alias("c"), F.lit(0).alias("r"))
        return empty, rows.select(F.col("id").alias("v"), F.col("id").alias("w"))
    m = min(MOST_CENTRES, centres or max(1, math.isqrt(n)))
    middle = np.array([x["vec"] for x in distinct.orderBy(F.xxhash64("v"), "v").limit(m).collect()], dtype=float)
    dims = middle.shape[1]
    shared = spark.sparkContext.broadcast(middle)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(at, _CHUNK)
                d = _distances(_matrix(batch.column("vec"), dims), shared.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("vec"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["v", "vec", "cell", "away"])

    own = stored(distinct.select("v", "vec").mapInArrow(assign, f"v {dict(distinct.dtypes)['v']}, vec array<double>, cell int, away double"), "cells")
    # a row for each centre at most
    radius = np.full(m, -np.inf)
    for x in own.groupBy("cell").agg(F.max("away").alias("away")).collect():
        radius[x["cell"]] = x["away"]
    other = own.select(F.col("v").alias("w"), F.col("vec").alias("other"), "cell", F.col("away").alias("other_away"))

    # the kth distance in the own cell; a cell of fewer rows gives no bound
    inside = own.join(other, "cell").select("v", squared_distance(F.col("vec"), F.col("other")).alias("d"), "w")
    kth = inside.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "w"))).filter(F.col("r") <= k).groupBy("v").agg(F.when(F.count("*") == k, F.sqrt(F.max("d"))).alias("bound"))
    bounded = stored(own.join(kth, "v", "left").select("v", "vec", "bound"), "bounds")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(at, _CHUNK)
                d = _distances(_matrix(batch.column("vec"), dims), shared.value)
                bound = batch.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False) * (1 + _SLACK) + _SLACK
                i, cell = np.nonzero((d - radius <= bound[:, None]) & np.isfinite(radius))
                yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(i)), batch.column("vec").take(pa.array(i)), pa.array(bound[i]), pa.array(cell.astype(np.int32)), pa.array(d[i, cell])], ["v", "vec", "bound", "cell", "away"])

    asked = bounded.mapInArrow(visits, f"v {dict(distinct.dtypes)['v']}, vec array<double>, bound double, cell int, away double")
    pairs = asked.join(other, "cell").filter(F.abs(F.col("away") - F.col("other_away")) <= F.col("bound"))
    near = pairs.select("v", "w", squared_distance(F.col("vec"), F.col("other")).alias("d"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "w"))).filter(F.col("r") <= k).select("v", "w", "d")
    # k nearest vectors hold the k nearest rows: each has its k least ids
    members = stored(copies.join(distinct.select(F.xxhash64("vec").alias("hash"), "vec", "v"), ["hash", "vec"]).select(F.col("v").alias("w"), F.col("id").alias("c")), "members")
    ranked = near.join(members, "w").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "c"))).filter(F.col("r") <= k).select("v", "c", "r")
    every = rows.join(distinct, "vec").select(F.col("id").alias("q"), "v")
    return every.join(ranked, "v").select("q", "c", "r"), pairs.select("v", "w")


def neighbours_kept(vectors: DataFrame, id_col: str, full: str, part: str, k: int = 10) -> DataFrame:
    """Share of every row's k nearest neighbours (by the full vectors, itself included) that the reduced vectors keep."""
    a, b = (nearest_neighbours(vectors, id_col, x, k)[0].select("q", "c") for x in (full, part))
    return a.join(b.withColumn("kept", F.lit(1)), ["q", "c"], "left").groupBy("q").agg((F.coalesce(F.sum("kept"), F.lit(0)) / k).alias("kept"))


def _blocks(vectors: DataFrame, id_col: str, columns: list[str], size: int, out: str, copies: str, n_copies: int) -> DataFrame:
    """Rows in blocks of `size` in the order of ids (`out`), once for each block of the other side (`copies`)."""
    ranked = global_rank(vectors.select(F.col(id_col).alias("id"), *columns), [], ["id"], "place")
    return ranked.withColumn(out, F.floor((F.col("place") - 1) / size)).withColumn(copies, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_copies - 1).cast("long"))))


def blockwise(vectors: DataFrame, queries: Column, id_col: str, columns: list[str], rows: int, asked: int, run: Callable, schema: str) -> DataFrame:
    """Stated queries against all rows, by pairs of blocks: `run` gets a query's id, the ids of a block of rows in ascending order, and for each column the squared distances; it gives tuples of `schema`.

    Ids are whole numbers; rows without a vector are left out. A task has `rows` rows and `asked` queries at a time. Squares are summed from the first dimension on, so equal vectors have equal distances.
    """
    vectors = vectors.dropna(subset=columns)
    ask = vectors.filter(queries)
    n, m = (max(1, -(-x.count() // size)) for x, size in ((vectors, rows), (ask, asked)))
    left, right = _blocks(vectors, id_col, columns, rows, "chunk", "block", m), _blocks(ask, id_col, columns, asked, "block", "chunk", n)
    names = [x.split()[0] for x in schema.split(", ")]

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("place"), b.sort_by("place")
        if not a.num_rows or not b.num_rows:
            return pa.table({c: [] for c in names}, schema=arrow)
        ids = a["id"].to_numpy()
        planes = {c: (_matrix(a[c].combine_chunks(), len(a[c][0])).T.copy(), _matrix(b[c].combine_chunks(), len(b[c][0]))) for c in columns}
        found = []
        for i, q in enumerate(b["id"].to_pylist()):
            distances = []
            for own, other in planes.values():
                d = np.zeros(len(ids))
                for x, y in zip(own, other[i], strict=True):
                    step = x - y
                    step *= step
                    d += step
                distances.append(d)
            found.append(run(q, ids, *distances))
        return pa.table({c: pa.concat_arrays([x[k] for x in found]) for k, c in enumerate(names)}, schema=arrow)

    empty = vectors.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(pairs, schema)


def _squared(planes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances to the columns of `planes`, summed from the first dimension on, so that equal vectors have equal distances."""
    d = np.zeros(planes.shape[1])
    for x, y in zip(planes, query, strict=True):
        step = x - y
        step *= step
        d += step
    return d


def _packed(df: DataFrame, columns: list[str], size: int | None) -> DataFrame:
    """Rows of `size` ids and vectors (None: all of a partition) each, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ([pa.Table.from_batches(list(batches), arrow)] if size is None else (pa.Table.from_batches([b]) for b in batches))
        for table in parts:
            for at in range(0, table.num_rows, size or max(1, table.num_rows)):
                t = table.slice(at, size).combine_chunks()
                dims = [len(t[c][0]) for c in columns]
                found = [t["id"].to_numpy().astype(np.int64).tobytes(), *[np.ascontiguousarray(_matrix(t[c].combine_chunks(), k)).tobytes() for c, k in zip(columns, dims, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found], ["ids", *columns])

    arrow = to_arrow_schema(df.schema)
    return df.mapInArrow(pack, ", ".join(f"{c} binary" for c in ["ids", *columns]))


def against_all(vectors: DataFrame, queries: Column, id_col: str, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """Stated queries against all rows: `run` gets a query's id, the ids of all rows in ascending order, and for each column the squared distances; it gives tuples of `schema`.

    Pairs are neither shuffled nor written. Rows are packed into blocks, which are written once; queries are dealt into
    groups, a partition each. The task of a group reads all blocks as a stream, and has the distances of its queries
    (HELD bytes) and ids of all rows. The session's Arrow batches are held to BATCH bytes from here on. Ids are whole numbers; rows without an id or a vector are left out, and the vectors
    of queries with one id are one query.
    """
    spark = vectors.sparkSession
    rows = vectors.dropna(subset=[id_col, *columns])
    ask = rows.filter(queries).select(F.col(id_col).alias("id"), *columns)
    rows = rows.select(F.col(id_col).alias("id"), *columns)
    names = [x.split()[0] for x in schema.split(", ")]
    empty = spark.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)
    n, different = rows.count(), ask.select("id").distinct()
    m = different.count()
    if not m:
        return empty
    size = max(1, min(HELD // (8 * len(columns) * n), -(-m // (2 * spark.sparkContext.defaultParallelism))))
    groups = -(-m // size)
    dealt = ask.join(global_rank(different, [], ["id"], "place"), "id").withColumn("group", F.floor((F.col("place") - 1) / size).cast("int"))
    asked = _packed(dealt.repartitionById(groups, F.col("group")).select("id", *columns), columns, None)
    # small row groups: a reader has one in memory
    blocks = stored(_packed(rows, columns, _PACKED), "blocks", **{"parquet.block.size": 16 << 20})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, found = 0, np.empty(n, np.int64), None
        number = lambda data, dtype=float: np.frombuffer(data, dtype)
        for batch in batches:
            for k in range(0, batch.num_rows, _COMPARED // _PACKED):
                part = batch.slice(k, _COMPARED // _PACKED).to_pydict()
                if found is None:
                    anchors = number(part["asked_ids"][0], np.int64)
                    query = [number(part[f"asked_{c}"][0]).reshape(len(anchors), -1) for c in columns]
                    found = [np.empty((len(anchors), n)) for _ in columns]
                own = number(b"".join(part["ids"]), np.int64)
                ids[at : at + len(own)] = own
                for c, q, d in zip(columns, query, found, strict=True):
                    planes = number(b"".join(part[c])).reshape(len(own), -1).T.copy()
                    for i, x in enumerate(q):
                        d[i, at : at + len(own)] = _squared(planes, x)
                at += len(own)
        if found is None:
            return
        if at != n:
            raise ValueError(f"{at} of {n} rows met a group of queries")
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        for q in np.unique(anchors):
            mine = np.flatnonzero(anchors == q)
            own, distances = ids, [d[mine[0]][order] for d in found]
            if len(mine) > 1:
                again = np.argsort(np.tile(ids, len(mine)), kind="stable")
                own, distances = np.tile(ids, len(mine))[again], [d[mine][:, order].ravel()[again] for d in found]
            yield pa.RecordBatch.from_arrays(list(run(int(q), own, *distances)), schema=arrow)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    asked = asked.toDF("asked_ids", *[f"asked_{c}" for c in columns])
    # one partition of blocks, which each task reads for itself, beside one of queries
    return blocks.coalesce(1).hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(meet, schema)
