"""Dataset summary and validation counts as one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import Ingestion


def data_summary(ing: Ingestion) -> DataFrame:
    """One row: accepted precincts, jurisdictions, totals, issue and row counts."""
    errs = F.filter(F.col("_issues"), lambda x: x["severity"] == "error")
    ok = F.size(errs) == 0
    file_err = sum(1 for d in ing.file_issues if d["severity"] == "error")
    file_warn = len(ing.file_issues) - file_err
    cols = set(ing.validated.columns)
    lat = F.col("Latitude") if "Latitude" in cols else F.lit(None)
    lon = F.col("Longitude") if "Longitude" in cols else F.lit(None)
    ballots = F.col("Ballots_Cast") if "Ballots_Cast" in cols else F.lit(None).cast("double")
    return ing.validated.agg(
        F.count_if(ok).alias("total_precincts"),
        F.count_distinct(F.when(ok, F.col("Jurisdiction"))).alias("total_jurisdictions"),
        F.sum(F.when(ok, ballots)).alias("ballots_cast"),
        F.sum(F.when(ok, F.col("Valid_Contest_Votes"))).alias("valid_contest_votes"),
        (F.coalesce(F.sum(F.size(errs)), F.lit(0)) + F.lit(file_err)).cast("bigint").alias("errors"),
        (F.coalesce(F.sum(F.size("_issues") - F.size(errs)), F.lit(0)) + F.lit(file_warn)).cast("bigint").alias("warnings"),
        F.count_if(~ok).alias("excluded_rows"),
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(ok & (lat.isNull() | lon.isNull())).alias("missing_coordinates"),
    )
