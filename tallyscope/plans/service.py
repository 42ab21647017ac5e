"""Library entry points that replace the reference's service tools (no server is started).

* ``process_file`` (P14): read + validate + summary, as a (frame, summary) pair.
* ``validate_returns`` (P16): status, report and bounded previews.
* ``analyze_returns`` (entry 3): validate, run the workflow, bounded record preview.
* ``explain_predictions`` (M18) and ``seeded_sample`` (W8).
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import join_one_to_one
from ..operators import dbscan as m12
from ..operators import features as m9
from ..operators import iforest as m11
from ..operators.common import AnalysisUnavailable
from ..operators.ingest import DataValidationError, Ingestion, ingest
from ..operators.scope import preview, validation_payload
from ..operators.summary import data_summary
from ..schema import ContestSchema, Settings
from ..sources.csv import provenance, read_returns_csv, stored_text
from .workflow import ALL_METHODS, SUCCESS, AnalysisRun, run_workflow

log = logging.getLogger(__name__)

CAUTION = "A flag says that a row is unusual under one stated model. It does not say why, and proves nothing about the count."


def load(spark: SparkSession, source, schema: ContestSchema | None = None, settings: Settings | None = None) -> Ingestion:
    """Path(s) to CSV files, the bytes or an open file of one, or an existing DataFrame (typed input such as parquet)."""
    if isinstance(source, DataFrame):
        return ingest(source, schema, settings)
    if isinstance(source, bytes) or hasattr(source, "read"):
        source = stored_text(spark, source)
    df, encodings = read_returns_csv(spark, source)
    ing = ingest(df, schema, settings)
    ing.provenance = provenance(spark, source, encodings)
    return ing


def process_file(spark: SparkSession, source, schema: ContestSchema | None = None) -> tuple[DataFrame, dict]:
    """Accepted rows and the dataset summary (A1 + V20) as a dict."""
    ing = load(spark, source, schema)
    row = data_summary(ing).first().asDict()
    summary = {
        "total_precincts": row["total_precincts"],
        "total_jurisdictions": row["total_jurisdictions"],
        "ballots_cast": row["ballots_cast"],
        "valid_contest_votes": row["valid_contest_votes"],
        "data_quality": {k: row[k] for k in ("errors", "warnings", "excluded_rows", "missing_coordinates")},
    }
    return ing.accepted, summary


def validate_returns(spark: SparkSession, source, preview_rows: int = 10, schema: ContestSchema | None = None) -> dict[str, Any]:
    """P16: 'valid' / 'valid_with_exclusions' with report and previews, or 'invalid'."""
    if not 0 <= preview_rows <= 100:
        raise ValueError(f"preview_rows is {preview_rows}; 0 to 100 are possible")
    try:
        ing = load(spark, source, schema)
    except DataValidationError as exc:
        return {"status": "invalid", "message": str(exc), "issues": exc.issues, "caution": CAUTION}
    payload = validation_payload(ing, preview_rows)
    payload["caution"] = CAUTION
    return payload


def analyze_returns(
    spark: SparkSession,
    source,
    candidate_key: str,
    methods=tuple(m for m in ALL_METHODS if m != "dbscan"),
    max_records: int = 100,
    settings: Settings | None = None,
    schema: ContestSchema | None = None,
) -> dict[str, Any]:
    """Entry 3: validate, run the selected methods, return statuses and a bounded preview."""
    if not 0 <= max_records <= 500:
        raise ValueError(f"max_records is {max_records}; 0 to 500 are possible")
    try:
        ing = load(spark, source, schema, settings)
    except DataValidationError as exc:
        return {"status": "invalid", "message": str(exc), "issues": exc.issues, "caution": CAUTION}
    run = run_workflow(ing, candidate_key=candidate_key, methods=methods, settings=settings)
    states = {v.state for v in run.statuses.values()}
    return {
        "status": "successful" if states == {SUCCESS} else "partial" if SUCCESS in states else "unsuccessful",
        "records_total": run.metadata["analysis_rows"],
        "statuses": {k: {"state": v.state, "message": v.message} for k, v in run.statuses.items()},
        "metadata": {k: v for k, v in run.metadata.items() if not k.startswith("_")},
        "diagnostics": run.diagnostics,
        "records": preview(run.data, max_records),
        "caution": CAUTION,
    }


def explain_predictions(run: AnalysisRun, settings: Settings | None = None) -> dict[str, Any]:
    """Isolation-forest importance (or why not) and the SHAP status."""
    settings = settings or Settings()
    forest = run.metadata.get("_forest")
    out: dict[str, Any] = {}
    if forest is None:
        out["isolation_forest_status"] = "unavailable: this run has no fitted forest"
    else:
        scaled = run.tables["features_scaled"]
        out["isolation_forest_importance"] = m11.feature_importance(scaled, forest, seed=settings.ml_random_state).orderBy(
            F.col("importance").desc(), "feature")
        out["isolation_forest_status"] = "successful"
    out["shap_status"] = "skipped: not offered"
    return out


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "Precinct_ID") -> DataFrame:
    """A reproducible sample of ``n`` rows (hash order on the key; the limit is the feature)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(int(n))


def predict_anomalies(frame: DataFrame, feature_model: m9.FeatureModel, forest: m11.Forest | None,
                      settings: Settings | None = None) -> DataFrame:
    """Score new rows with the fitted scaler and forest; DBSCAN (if enabled) is re-fit on them.

    Jurisdiction statistics are recomputed from the scored frame; only the medians
    and the robust scaler come from the fit.
    """
    settings = settings or Settings()
    feats, _names = m9.create_features(frame)
    scaled = m9.transform(feats, feature_model, keep=["Precinct_ID"]).select("Precinct_ID", "features")
    out = frame
    if forest is not None:
        out = join_one_to_one(out, m11.score(scaled, forest).select("Precinct_ID", "IF_Anomaly_Flag", "IF_Anomaly_Score"), "Precinct_ID")
    if settings.dbscan.enabled:
        try:
            out = join_one_to_one(out, m12.dbscan(scaled, settings.dbscan).data, "Precinct_ID")
        except AnalysisUnavailable as why:
            # the columns stay, without a judgement
            log.warning("dbscan: %s", why)
            out = out.withColumns({"DBSCAN_Cluster": F.lit(None).cast("bigint"), "DBSCAN_Noise_Flag": F.lit(None).cast("boolean")})
    return out
