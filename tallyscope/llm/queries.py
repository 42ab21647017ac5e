"""Registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import decontamination, fingerprints, html_text, language_id, licenses, ngram_join, packing, periodic_runs, personal_data, ranked_search, substring_dedup, suffix_tree_lm, token_counts
from tallyscope.llm.tables import crc_remainder
from tallyscope.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = crc_remainder("doc_id", 5)
    found = language_id.identify(docs, f"{remainder} <> 0")
    return found.select("doc_id", F.expr(f"{remainder} = 0").alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(spark, table(spark, sf_dir, "documents"), f"{crc_remainder('doc_id', 7)} = 2")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(spark, table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(spark, table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digests(personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.find_runs(planted))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_license_scan, op4_html_text, op5_suffix_tree_lm,
        op6_packing, op7_ngram_join, op8_token_counts, op9_substring_dedup, op10_fingerprints,
        op11_personal_data, op12_periodic_runs, op13_ranked_search,
    )
}
ORACLES: dict[str, str] = {"op2_decontamination": decontamination.ORACLE, "op7_ngram_join": ngram_join.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
