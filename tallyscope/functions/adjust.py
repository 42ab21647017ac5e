"""Multiple-testing adjustment as DataFrame operators.

Both adjustments depend only on the distinct p-values: tied p-values always get
the same adjusted value. Work therefore runs on the distinct-value table of each
family (at most P+1 rows for permutation p-values), joined back afterwards.

The cumulative scans (counts below a value, running max / suffix min) are done
as a distributed segmented prefix scan, never as one global window: the distinct
table is range-partitioned on (family, p) and checkpointed so partitions are
stable; each partition scans its own rows; the per-(partition, family) totals -
a table with at most (partitions + families) rows - supply the offsets carried
in from earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import join_dimension

_PID = "_pid"


def check_p_values(df: DataFrame, p_col: str) -> None:
    """Every p-value must be finite and in [0, 1]."""
    p = F.col(p_col)
    bad = df.agg(F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad")).first()["bad"]
    if bad:
        raise ValueError("p-values must be finite values in [0, 1]")


def _distinct(df: DataFrame, p_col: str, family: list[str]) -> DataFrame:
    """Distinct (family, p) with multiplicity, range-partitioned on (family, p) and checkpointed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    d = df.groupBy(*family, F.col(p_col).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    parts = max(1, spark.sparkContext.defaultParallelism)
    d = d.repartitionByRange(parts, *family, "_p").withColumn(_PID, F.spark_partition_id())
    return d.checkpoint()


def _carry(d: DataFrame, family: list[str], local: Column, agg, name: str, reverse: bool = False) -> DataFrame:
    """Combine ``local`` (a per-partition scan) with the totals of earlier (or later) partitions.

    ``agg`` is sum / max / min. Returns d with column ``name`` = carried value from
    strictly earlier partitions of the same family (NULL if none).
    """
    totals = d.groupBy(_PID, *family).agg(agg(local).alias("_t"))
    order = F.col(_PID).desc() if reverse else F.col(_PID).asc()
    w = Window.partitionBy(*family).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(_PID, *family, agg("_t").over(w).alias(name))
    return join_dimension(d, carried, [_PID, *family], "left")


def _with_family_total(d: DataFrame, family: list[str]) -> DataFrame:
    """m: number of p-values in the family (grouped total joined back, or one scalar)."""
    if family:
        return join_dimension(d, d.groupBy(*family).agg(F.sum("_c").alias("_m")), family, "left")
    return d.withColumn("_m", F.lit(int(d.agg(F.sum("_c")).first()[0])))


def _scan_window(family: list[str], asc: bool = True, inclusive: bool = True):
    order = F.col("_p").asc() if asc else F.col("_p").desc()
    w = Window.partitionBy(_PID, *family).orderBy(order)
    return w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def holm(df: DataFrame, p_col: str, out_col: str, family: list[str] | None = None, check: bool = True) -> DataFrame:
    """Holm step-down adjustment: running max of min(1, p_(j) * (m - j + 1))."""
    family = family or []
    if check:
        check_p_values(df, p_col)
    d = _distinct(df, p_col, family)
    # L(p): number of p-values strictly below p in the family (offset + local prefix).
    d = d.withColumn("_lc", F.coalesce(F.sum("_c").over(_scan_window(family, inclusive=False)), F.lit(0)))
    d = _carry(d, family, F.col("_c"), F.sum, "_off")
    d = _with_family_total(d, family)
    d = d.withColumn("_v", F.least(F.lit(1.0), F.col("_p") * (F.col("_m") - F.coalesce(F.col("_off"), F.lit(0)) - F.col("_lc"))))
    d = d.withColumn("_run", F.max("_v").over(_scan_window(family)))
    d = _carry(d, family, F.col("_v"), F.max, "_prev")
    d = d.select(*family, F.col("_p").alias(p_col), F.greatest("_run", F.coalesce("_prev", "_run")).alias(out_col))
    return join_dimension(df, d, [*family, p_col], "left")


def benjamini_hochberg(df: DataFrame, p_col: str, out_col: str, family: list[str] | None = None, check: bool = True) -> DataFrame:
    """BH adjustment: suffix min (from the largest p) of p_(j) * m / j, capped at 1."""
    family = family or []
    if check:
        check_p_values(df, p_col)
    d = _distinct(df, p_col, family)
    # C(p): number of p-values <= p in the family.
    d = d.withColumn("_lc", F.sum("_c").over(_scan_window(family)))
    d = _carry(d, family, F.col("_c"), F.sum, "_off")
    d = _with_family_total(d, family)
    d = d.withColumn("_v", F.col("_p") * F.col("_m") / (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_lc")))
    d = d.withColumn("_run", F.min("_v").over(_scan_window(family, asc=False)))
    d = _carry(d, family, F.col("_v"), F.min, "_next", reverse=True)
    d = d.select(*family, F.col("_p").alias(p_col),
                 F.least(F.lit(1.0), F.least("_run", F.coalesce("_next", "_run"))).alias(out_col))
    return join_dimension(df, d, [*family, p_col], "left")


def holm_values(p_values: list[float]) -> list[float]:
    """Driver-side Holm for a handful of dataset-level tests (e.g. digit tests)."""
    if any(not (0.0 <= p <= 1.0) for p in p_values):
        raise ValueError("p-values must be finite values in [0, 1]")
    order = sorted(range(len(p_values)), key=lambda i: p_values[i])
    m = len(p_values)
    out = [0.0] * m
    running = 0.0
    for rank, i in enumerate(order):
        running = max(running, min(1.0, p_values[i] * (m - rank)))
        out[i] = running
    return out
