"""Shared method plumbing: the 'unavailable' precondition error and result records."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..schema import SHARE_PREFIX


class AnalysisUnavailable(ValueError):
    """A documented precondition of a method is not met (status 'unavailable'); ``found`` is what was measured."""

    def __init__(self, message: str, found: dict[str, Any] | None = None):
        super().__init__(message)
        self.found = found or {}


@dataclass
class MethodResult:
    """Row-level output (input columns + method columns) and dataset-level diagnostics."""

    data: DataFrame
    diagnostics: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


def turnout_column(df: DataFrame) -> str:
    """M2: calculated turnout if present, else reported, else unavailable."""
    if "Calculated_Turnout_Percent" in df.columns:
        return "Calculated_Turnout_Percent"
    if "Reported_Turnout_Percent" in df.columns:
        return "Reported_Turnout_Percent"
    raise AnalysisUnavailable("no turnout column: map ballots and registration, or a reported turnout")


def share_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(SHARE_PREFIX)]


def require_share(df: DataFrame, share: str, allowed: list[str] | None = None) -> None:
    allowed = allowed or share_columns(df)
    if share not in allowed:
        raise AnalysisUnavailable(f"{share} is not the share of a candidate of this contest")
