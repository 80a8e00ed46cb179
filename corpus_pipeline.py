"""A corpus pipeline: each stage is an operator of duolume.llm, written as Parquet and read again by the next.

Documents are known by id and text, so repeated or null ids drop only the rows that are meant; rows equal
in both are one document to near_duplicates, which keeps one of them. Null texts have no language and go in the
first stage. Columns are those of the input, whatever their names. Empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolume.llm.common import materialize, new_path, own_columns, table

#: Ids that are broadcast to drop documents; beyond, the join is a shuffled one.
MOST_BROADCAST = 2_000_000
#: Least posterior probability of a language.
LEAST_SCORE = 0.4


def _same(docs: DataFrame, found: DataFrame):
    """Whether a row of `found` (doc_id, key: hash of the text) names a document."""
    return docs["doc_id"].eqNullSafe(found["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(found["key"])


def _small(found: DataFrame) -> DataFrame:
    """A table to be joined to documents; they are only shuffled if it is large."""
    found = materialize(found, "dropped")
    return F.broadcast(found) if found.count() <= MOST_BROADCAST else found


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = _small(found.select("doc_id", "key").distinct())
    return docs.join(found, _same(docs, found), "left_anti").select(*own_columns(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or no language that is likely enough."""
    from duolume.llm.language_id import UNKNOWN, predict, train

    lang, score = (next(x for x in (f"{name}{'_' * k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("lang_pred", "lang_score"))
    known = predict(docs, train(docs), lang=lang, score=score)
    return known.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*own_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, similarity 0.8)."""
    from duolume.llm.jaccard_join import repeated_documents

    found = materialize(repeated_documents(docs, n_words=5, p=80, q=100), "repeated")
    kept = _without(docs, found)
    twice = found.filter("kept")
    if twice.isEmpty():
        return kept
    # rows that are equal in id and text
    twice = _small(twice)
    return kept.unionByName(docs.join(twice, _same(docs, twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    from duolume.llm.decontaminate import benchmark_matches

    return _without(docs, benchmark_matches(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights."""
    from duolume.llm.mixing import mixed_documents

    return mixed_documents(docs, weights=[3, 1, 2], share=1.5, cap=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files; a row for each document in them."""
    import public_tokenizers

    from duolume.llm.token_output import token_digest, write_token_files

    path = new_path(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_digest(spark, path)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Naive Bayes, SimHash and tokenizers can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
