"""Operator 4: sharding by vector bin packing.

A group (equal texts, or any key) is a vector of bytes, tokens and rows. Vectors
are placed in falling order of their weighted size, each into the shard where
the dot product with the residual capacity is highest, so that all three
measures stay balanced.

There are as many groups as texts, so placement works on a bounded table: groups
with over 1 / GRAIN of a shard's capacity in any measure are placed singly (at
most 3 * shards * GRAIN of them can exist), all others are first hashed into
LIGHT_BINS bins, whose vectors are summed by Spark. A group larger than a shard
is cut into a piece for each shard by document id, as no shard could hold it.
Bytes weigh most in the dot product (WEIGHTS): they come out near equal even where
groups of many short texts make all three measures impossible to level together.

Null texts count as empty ones: size 1. Repeated rows are documents of their
own, equal or null ids as well; their slots are in any order. Ties go to the lower shard. Empty tables give an empty result. The result has the named columns only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_columns, word_count

GRAIN = 64
LIGHT_BINS = 4096
#: Of bytes, tokens, rows.
WEIGHTS = np.array([8.0, 1.0, 1.0])
#: Rows of a shard that are numbered in one task.
ROWS_A_CHUNK = 2_000


def place_vectors(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (rows: items; columns: measures, summing to 1)."""
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    placed = np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -(vectors * WEIGHTS).sum(axis=1))):
        best = int(np.argmax(residual @ (WEIGHTS * vectors[i])))
        placed[i], residual[best] = best, residual[best] - vectors[i]
    return placed


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, shard, slot for every document, and its whole row as a struct (`row`), if asked for.

    Slots are gapless in each shard, in an order that mixes the documents: a
    chunk is made of a hash, rows are numbered in it, and chunk totals (a few
    rows) give its first slot.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), word_count(text).alias("n_tokens"), F.xxhash64(text).alias("group_key"), *([F.struct(*own_columns(docs)).alias("row")] if carry else [])), "shard-rows")
    measures = ("size", "n_tokens", "n_rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    total = rows.agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).first()
    total = [max(1, x or 0) for x in total]
    heavy = reduce(Column.__or__, [F.col(c) * (shards * GRAIN) > n for c, n in zip(measures, total, strict=True)])
    too_large = reduce(Column.__or__, [F.col(c) * shards > n for c, n in zip(measures, total, strict=True)])
    # at most 3 * shards * GRAIN rows, whatever the input
    cuts = F.broadcast(spark.createDataFrame(groups.filter(heavy).select("group_key", F.when(too_large, shards).otherwise(1)).collect(), "group_key long, n_pieces int"))
    rows = rows.join(cuts, "group_key", "left").withColumn("heavy", F.col("n_pieces").isNotNull())
    rows = rows.withColumn("item", F.when(F.col("heavy"), F.col("group_key")).otherwise(F.pmod("group_key", F.lit(LIGHT_BINS)))).withColumn("piece", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.col("n_pieces"))).otherwise(0).cast("int")).drop("n_pieces")
    # at most shards pieces for each of 3 * shards groups, besides those and LIGHT_BINS bins
    items = sorted(tuple(x) for x in rows.groupBy("heavy", "item", "piece").agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).collect())
    vectors = np.array([x[3:] for x in items], dtype=float).reshape(-1, 3) / total
    placed = place_vectors(vectors, shards)
    places = spark.createDataFrame([(*x[:3], int(s)) for x, s in zip(items, placed, strict=True)], "heavy boolean, item long, piece int, shard int")
    rows = rows.join(F.broadcast(places), ["heavy", "item", "piece"])

    chunks = 1 + total[2] // (shards * ROWS_A_CHUNK)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    first = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_slot"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")) - 1)
    return numbered.join(first, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("first_slot") + F.col("k")).alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents into a folder for each shard (`shard=0`, ...), in the order of `slot` within files.

    Rows go along as they are, so equal and null ids lose and repeat nothing. Input columns named `shard` or `slot` would clash: an error.
    """
    clash = {"shard", "slot"} & {x.lower() for x in docs.columns}
    if clash:
        raise ValueError(f"columns that shards have themselves: {', '.join(sorted(clash))}")
    rows = shard_documents(docs, shards, id_col, text_col, carry=True).select("row.*", "shard", "slot")
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
