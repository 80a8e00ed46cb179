"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import token_digest, write_token_files

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_digest(spark, path)


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pareto_mix

    mixed = pareto_mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    rows = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fold, predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold() != 2))
    rows = predict(docs.select("doc_id", "text"), model, returned=["doc_id"])
    return rows.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_site_lines

    return drop_site_lines(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_matches

    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op8_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n_words=4, p=85, q=100)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damage, repair, report

    return report(repair(damage(table(spark, sf_dir, "conversations"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import collapse_runs, periodize, report

    return report(collapse_runs(table(spark, sf_dir, "documents"), periodize))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import report, scan_licenses

    return report(scan_licenses(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    found = (
        op1_token_output, op2_pareto_mix, op3_html_text, op4_vector_packing, op5_language_id, op6_site_lines,
        op7_decontaminate, op8_prefix_fingerprints, op9_repeats, op10_jaccard_join, op11_conversation_repair,
        op12_periodic_runs, op13_license_scan,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .line_dedup import ORACLE

    return {"op6_site_lines": ORACLE}
