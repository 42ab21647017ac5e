"""Shared preparation for registered queries: fixture -> validated returns."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import Ingestion, canonical_columns, ingest
from ..schema import fixture_schema
from ..sources import fixtures

ROUND = 6


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Round every DOUBLE column (float sums depend on partitioning in the last bits)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def raw_ingestion(spark: SparkSession, sf_dir: str) -> Ingestion:
    ing = ingest(fixtures.returns_raw(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK), fixture_schema())
    ing.validated = ing.validated.persist(StorageLevel.MEMORY_AND_DISK)
    return ing


def typed_ingestion(spark: SparkSession, sf_dir: str, by_type: bool = False) -> Ingestion:
    source = fixtures.returns(spark, sf_dir, by_type=by_type).persist(StorageLevel.MEMORY_AND_DISK)
    return ingest(source, fixture_schema(vote_type=by_type))


def analysis_frame(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Accepted canonical returns: the input of every analysis method (persisted,
    since each method runs a few small aggregations over it)."""
    ing = typed_ingestion(spark, sf_dir, by_type)
    return ing.accepted.select(*canonical_columns(ing)).persist(StorageLevel.MEMORY_AND_DISK)
