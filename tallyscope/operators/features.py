"""Leakage-aware feature table, median fill and robust scaling.

Jurisdiction statistics (centroid, mean and sample std of every feature) come
from one ``groupBy(Jurisdiction)`` - partially aggregated map-side, so a hot
jurisdiction collapses before the shuffle - and are joined back (broadcast only
after the table's row count is checked). A window partitioned by jurisdiction
would put a hot jurisdiction into one task; the grouped form does not.

Fitting (M10) needs per-feature min/max/count (one aggregation) and exact
quartiles (``functions.quantile``; the fill is counted in, so one search finds
medians and quartiles); the fitted parameters are plain numbers that become literals of a single projection.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_dimension
from ..functions.quantile import interpolated, order_statistics, ranks_of
from ..schema import SHARE_PREFIX
from .common import AnalysisUnavailable

_LOG_COUNTS = ("Registered_Voters", "Active_Registered_Voters", "Ballots_Cast", "Valid_Contest_Votes")
_RATES = ("Undervotes", "Overvotes", "Write_In_Votes")
DISTANCE = "distance_from_jurisdiction_centroid"
KEY = "_fkey"
#: Quantiles of a feature after the fill: centre and scale.
FILLED = (0.25, 0.5, 0.75)


def _num(c: str):
    return F.col(f"`{c}`").try_cast("double")


def _finite(x):
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def base_features(df: DataFrame) -> dict[str, object]:
    """Row-local features in their fixed order (name -> Column)."""
    cols = set(df.columns)
    feats: dict[str, object] = {}
    if "Calculated_Turnout_Percent" in cols:
        feats["turnout_fraction"] = _num("Calculated_Turnout_Percent") / 100
    elif "Reported_Turnout_Percent" in cols:
        feats["turnout_fraction"] = _num("Reported_Turnout_Percent") / 100
    for c in df.columns:
        if c.startswith(SHARE_PREFIX):
            feats[c] = _num(c)
    for c in _LOG_COUNTS:
        if c in cols:
            v = _num(c)
            feats[f"log1p__{c}"] = F.log1p(F.when(v >= 0, v))
    if {"Valid_Contest_Votes", "Ballots_Cast"} <= cols:
        b = _num("Ballots_Cast")
        feats["contest_vote_rate"] = _num("Valid_Contest_Votes") / F.when(b > 0, b)
    for c in _RATES:
        if c in cols and "Ballots_Cast" in cols:
            b = _num("Ballots_Cast")
            feats[f"rate__{c}"] = _num(c) / F.when(b > 0, b)
    return feats


def create_features(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """M9: returns (frame with ``keep`` columns + feature columns, ordered feature names)."""
    keep = list(keep or [c for c in ("Precinct_ID",) if c in df.columns])
    cols = set(df.columns)
    feats = base_features(df)
    names = list(feats)
    out = df.select(*[F.col(f"`{c}`") for c in keep],
                    *([F.col("Jurisdiction").alias("_j")] if "Jurisdiction" in cols else []),
                    *([_num("Latitude").alias("_lat"), _num("Longitude").alias("_lon")] if {"Latitude", "Longitude"} <= cols else []),
                    *[_finite(v).alias(k) for k, v in feats.items()])
    if "Jurisdiction" not in cols:
        return out, names
    has_geo = {"Latitude", "Longitude"} <= cols
    aggs = []
    if has_geo:
        aggs += [F.avg("_lat").alias("_mlat"), F.avg("_lon").alias("_mlon")]
    for i, k in enumerate(names):
        aggs += [F.avg(F.col(f"`{k}`")).alias(f"_m{i}"), F.stddev_samp(F.col(f"`{k}`")).alias(f"_s{i}")]
    stats = out.filter(F.col("_j").isNotNull()).groupBy("_j").agg(*aggs)
    joined = join_dimension(out, stats, "_j", "left")
    new = {}
    if has_geo:
        d = F.sqrt(F.pow(F.col("_lat") - F.col("_mlat"), 2) + F.pow(F.col("_lon") - F.col("_mlon"), 2))
        new[DISTANCE] = _finite(d)
    for i, k in enumerate(names):
        s = F.col(f"_s{i}")
        new[f"jurisdiction_z__{k}"] = _finite((F.col(f"`{k}`") - F.col(f"_m{i}")) / F.when(s > 0, s))
    final_names = names + ([DISTANCE] if has_geo else []) + [f"jurisdiction_z__{k}" for k in names]
    result = joined.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{k}`") for k in names],
                           *[v.alias(k) for k, v in new.items()])
    return result.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{k}`") for k in final_names]), final_names


@dataclass
class FeatureModel:
    """M10 fitted parameters: usable features, medians, robust centre and scale."""

    features: list[str]
    medians: dict[str, float]
    centers: dict[str, float]
    scales: dict[str, float]
    meta: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "medians": self.medians, "centers": self.centers, "scales": self.scales})

    @classmethod
    def from_json(cls, text: str) -> FeatureModel:
        d = json.loads(text)
        return cls(d["features"], d["medians"], d["centers"], d["scales"])


def fit(feature_frame: DataFrame, names: list[str]) -> FeatureModel:
    """Drop all-NULL and constant features; median of each; robust quartiles after the fill."""
    st = feature_frame.agg(
        *[F.count(F.col(f"`{k}`")).alias(f"n{i}") for i, k in enumerate(names)],
        *[F.min(F.col(f"`{k}`")).alias(f"lo{i}") for i, k in enumerate(names)],
        *[F.max(F.col(f"`{k}`")).alias(f"hi{i}") for i, k in enumerate(names)],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    usable = [k for i, k in enumerate(names) if st[f"n{i}"] > 0 and st[f"lo{i}"] != st[f"hi{i}"]]
    if not usable:
        raise AnalysisUnavailable("no feature varies")
    counts = {k: int(st[f"n{names.index(k)}"]) for k in usable}
    rows = int(st["rows"])
    # in the filled column the median stands between the two halves, once per empty row
    half = {k: (counts[k] - 1) // 2 for k in usable}
    rank = lambda k, r: r if r <= half[k] else max(half[k], r - (rows - counts[k]))
    asked = {k: sorted({*ranks_of(counts[k], 0.5), *(rank(k, r) for q in FILLED for r in ranks_of(rows, q))}) for k in usable}
    values = order_statistics(feature_frame, asked, counts)
    medians, centers, scales = {}, {}, {}
    for k in usable:
        medians[k] = m = float(interpolated(counts[k], 0.5, lambda r: values[(k, r)]))
        filled = lambda r: m if half[k] < r <= half[k] + rows - counts[k] else values[(k, rank(k, r))]
        low, centers[k], high = (float(interpolated(rows, q, filled)) for q in FILLED)
        scales[k] = high - low if high != low else 1.0
    return FeatureModel(usable, medians, centers, scales, {"training_rows": rows})


def transform(feature_frame: DataFrame, model: FeatureModel, keep: list[str] | None = None) -> DataFrame:
    """Fill, scale and assemble ``features`` (ARRAY<DOUBLE>) in the fitted order."""
    missing = sorted(set(model.features) - set(feature_frame.columns))
    if missing:
        raise ValueError(f"features of the fit that the input lacks: {', '.join(missing)}")
    keep = keep if keep is not None else [c for c in feature_frame.columns if c not in model.features]
    scaled = {
        k: (F.coalesce(F.col(f"`{k}`"), F.lit(model.medians[k])) - F.lit(model.centers[k])) / F.lit(model.scales[k])
        for k in model.features
    }
    return feature_frame.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in scaled.items()],
                                F.array(*[v for v in scaled.values()]).alias("features"))
