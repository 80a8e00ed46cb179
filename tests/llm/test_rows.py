"""Rows of odd names and ids pass the writers and the pipeline whole; many languages are all learned."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from duolume.llm.common import new_path


def test_shards_hold_every_row_once(spark):
    from duolume.llm.sharding import write_shards

    rows = [(1, "a b", 1), (1, "c d e", 2), (None, "f", 3), (2, None, 4), (2, None, 4), (None, "f", 5), (3, "", 6)] + [(k, f"text {k % 30}", k) for k in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnRenamed("n", "a.b")
    path = new_path(spark, "shards")
    write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert sorted(str((x["doc_id"], x["text"], x["a.b"])) for x in back.collect()) == sorted(map(str, rows))
    assert {x["shard"] for x in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    for x in back.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("own")).collect():
        assert (x["low"], x["high"], x["own"]) == (0, x["n"] - 1, x["n"])
    with pytest.raises(ValueError, match="shard"):
        write_shards(docs.withColumn("Shard", F.lit(1)), new_path(spark, "shards"), 4)
    none = new_path(spark, "shards")
    write_shards(docs.limit(0), none, 4)
    assert spark.read.schema(docs.schema).parquet(none).count() == 0


def test_three_hundred_languages(spark):
    from duolume.llm.language_id import predict, train

    rng = random.Random(3)
    alphabets = [[chr(0x4E00 + 40 * k + i) for i in range(40)] for k in range(300)]
    text = lambda k: " ".join("".join(rng.choice(alphabets[k]) for _ in range(4)) for _ in range(12))
    docs = spark.createDataFrame([(3 * k + i, text(k), f"l{k:03}") for k in range(300) for i in range(3)], "doc_id long, text string, lang string")
    model = train(docs)
    assert len(model[0]) == 300
    got = predict(docs, model).select("lang", "lang_pred").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) == len(got)
    with pytest.raises(ValueError, match="languages"):
        train(docs, most_langs=299)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumns({"a.b": F.col("doc_id") * 2, "x`y": F.lit("z"), "row": F.lit(1), "lang_pred": F.lit("q")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.filter(F.col("`a.b`") != F.col("doc_id") * 2).count() == 0 and out.count() > 0
