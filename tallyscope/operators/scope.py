"""Analysis scope filters, flagged records, previews.

All filters are plain predicates so Catalyst pushes them into the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FLAG_COLUMNS
from .ingest import Ingestion


def filter_records(
    df: DataFrame,
    *,
    jurisdictions: Iterable[str] | None = None,
    turnout_range: tuple[float, float] | None = None,
    minimum_ballots: float | None = None,
    vote_types: Iterable[str] | None = None,
) -> DataFrame:
    """AND of the optional scope predicates (an empty selection selects nothing)."""
    preds = []
    if jurisdictions is not None:
        values = list(jurisdictions)
        preds.append(F.col("Jurisdiction").isin(values) if values else F.lit(False))
    if turnout_range is not None:
        tcol = next((c for c in ("Calculated_Turnout_Percent", "Reported_Turnout_Percent") if c in df.columns), None)
        if tcol is not None:
            lo, hi = turnout_range
            preds.append(F.col(tcol).try_cast("double").between(float(lo), float(hi)))
    if minimum_ballots is not None and "Ballots_Cast" in df.columns:
        preds.append(F.col("Ballots_Cast").try_cast("double") >= float(minimum_ballots))
    if vote_types is not None and "Vote_Type" in df.columns:
        values = [str(v) for v in vote_types]
        preds.append(F.col("Vote_Type").cast("string").isin(values) if values else F.lit(False))
    if not preds:
        return df
    return df.filter(F.coalesce(reduce(lambda a, b: a & b, preds), F.lit(False)))


def turnout_bounds(df: DataFrame) -> DataFrame:
    """min and max of finite turnout (calculated, else reported); NULLs if none."""
    tcol = next((c for c in ("Calculated_Turnout_Percent", "Reported_Turnout_Percent") if c in df.columns), None)
    if tcol is None:
        return df.agg(F.lit(None).cast("double").alias("turnout_min"), F.lit(None).cast("double").alias("turnout_max"))
    t = F.col(tcol).try_cast("double")
    finite = F.when(~F.isnan(t) & (F.abs(t) != float("inf")), t)
    return df.agg(F.min(finite).alias("turnout_min"), F.max(finite).alias("turnout_max"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """sorted distinct non-NULL values of an identifier column."""
    return df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct().orderBy(column)


def flagged_records(df: DataFrame) -> DataFrame:
    """rows flagged by at least one precinct-level method (NULL counts as not flagged)."""
    flags = [c for c in FLAG_COLUMNS if c in df.columns]
    if not flags:
        return df.limit(0)
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in flags]))


def preview(df: DataFrame, limit: int, key: str = "Precinct_ID", maximum: int = 500) -> DataFrame:
    """The first ``limit`` records by key (a bounded preview; limit is the feature)."""
    if not 0 <= int(limit) <= maximum:
        raise ValueError(f"limit must be in [0, {maximum}]")
    return df.orderBy(key).limit(int(limit))


def issue_preview(ing: Ingestion, limit: int, maximum: int = 500) -> DataFrame:
    """The first ``limit`` issues with row, key and column, by key, rule and column (the limit is the feature)."""
    if not 0 <= int(limit) <= maximum:
        raise ValueError(f"limit must be in [0, {maximum}]")
    return ing.issues.orderBy(F.col("Precinct_ID").asc_nulls_first(), "code", F.col("column").asc_nulls_first(), "row").limit(int(limit))


def validation_payload(ing: Ingestion, limit: int = 10) -> dict:
    """P16: 'valid' when no error was recorded, else 'valid_with_exclusions', with the first issues and previews.

    A file-level failure (DataValidationError) is reported by the caller as 'invalid'.
    """
    report = ing.report()
    return {
        "status": "valid" if report["is_valid"] else "valid_with_exclusions",
        "schema": ing.schema.name,
        "candidate_choices": [{"key": c.key, "label": c.label, "share_column": c.share_column} for c in ing.schema.candidates],
        "validation": report,
        "issues": issue_preview(ing, 10 * limit, maximum=1000),
        "provenance": ing.provenance,
        "accepted_preview": preview(ing.accepted, limit, maximum=100),
        "excluded_preview": preview(ing.excluded, limit, maximum=100),
    }
