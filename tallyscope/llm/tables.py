"""Lineage cuts: intermediate tables written to the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyscope.session import ensure_checkpoint_dir


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a re-read instead of a recomputation. The files stay
    until whoever owns the checkpoint folder clears it, as results may still read them.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wider(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` and the fields of ``ddl``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def crc_remainder(column: str, modulus: int) -> str:
    """SQL text: crc32 of the id's text modulo ``modulus`` (a null id counts as empty text)."""
    return f"pmod(crc32(cast(coalesce(cast({column} as string), '') as binary)), {modulus})"
