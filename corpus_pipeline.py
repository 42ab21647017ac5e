"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all its predecessor
kept. All but the last return the columns of their input:

1. language ID - fitted on labelled documents whose crc32(doc_id) modulo 5 is not 0; rejects
   documents without a letter, and those that no learned language fits (more unknown 3-grams
   than labelled documents have among each other, see language_id; texts of a few words have
   too few to tell). A null text is rejected. Without any labelled document only texts
   without a letter go.
2. n-gram Jaccard join - of each group of linked documents the one with the smallest id stays.
   Rows with equal ids stay together; rows with a null id are judged by no one and stay.
3. substring dedup - windows of 13 words that start in an earlier document are cut out of the
   later ones; n_chars follows the text. Documents that lose all their words go.
4. benchmark decontamination - documents that contain an item go.
5. best-fit packing - the remaining documents in sequences of 1024 tokens; one row per piece.

Clean documents pass every stage unchanged. Further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import decontamination, language_id, ngram_join, packing, substring_dedup
from tallyscope.llm.tables import crc_remainder, stage
from tallyscope.session import ship_package

#: Strangeness above which no learned language fits.
MAX_STRANGENESS = 1.0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    texts, labels = language_id.sample(docs, f"{crc_remainder('doc_id', 5)} <> 0", "lang", "text", "doc_id")
    if not texts:
        return docs.filter(r"text rlike '\\p{L}'")
    judged = language_id.predict(docs, language_id.fit(texts, labels), prefix="judged__")
    return judged.filter((F.col("judged__lang_pred") != "und") & (F.col("judged__strangeness") <= MAX_STRANGENESS)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = ngram_join.link_components(spark, docs)
    drop = stage(spark, found.filter("component_id is not null and component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    small = drop.count() <= ngram_join.IDS_BROADCAST
    return docs.join(F.broadcast(drop) if small else drop, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = substring_dedup.remove_repeats(spark, docs, prefix="cut__")
    kept = found.filter("cut__n_removed = 0 or cut__n_removed < cut__n_words")
    changed = {"text": F.when(F.col("cut__n_removed") > 0, F.col("cut__kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cut__n_removed") > 0, F.length("cut__kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(changed).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drop = stage(spark, decontamination.find_contained(spark, docs, items).select("doc_id").distinct(), "contaminated")
    small = drop.count() <= decontamination.IDS_BROADCAST
    return docs.join(F.broadcast(drop) if small else drop, "doc_id", "left_anti").select(*docs.columns)


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_rest),
]

#: SQL cannot express the kernel classifier or the packing; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
