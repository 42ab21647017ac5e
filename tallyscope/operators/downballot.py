"""M5 / A2: presidential versus same-party down-ballot differences.

Row columns are one projection; the per-pair summary is one aggregation plus
the exact medians (bracketed quantiles, no single-reducer percentile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantile import exact_quantiles
from ..schema import DownBallotPair
from .common import AnalysisUnavailable, MethodResult


def _valid(pres, down):
    return F.coalesce((pres > 0) & down.isNotNull() & (down >= 0), F.lit(False))


def down_ballot_difference(df: DataFrame, presidential: str, pairs: tuple[DownBallotPair, ...] | list[DownBallotPair]) -> MethodResult:
    selected = [p for p in pairs if p.column in df.columns]
    if not selected:
        raise AnalysisUnavailable("no down-ballot pair has its column in the table")
    if presidential not in df.columns:
        raise AnalysisUnavailable(f"the table lacks the vote column {presidential}")
    pres = F.col(presidential).cast("double")
    new_cols, aggs = {}, []
    for i, p in enumerate(selected):
        down = F.col(p.column).cast("double")
        ok = _valid(pres, down)
        new_cols[f"Down_Ballot_Difference_Votes__{p.key}"] = F.when(ok, pres - down)
        new_cols[f"Down_Ballot_Difference_Percent__{p.key}"] = F.when(ok, 100 * (pres - down) / pres)
        aggs += [
            F.count_if(ok).alias(f"n{i}"),
            F.sum(F.when(ok, pres)).alias(f"p{i}"),
            F.sum(F.when(ok, down)).alias(f"d{i}"),
            F.count_if(ok & (100 * (pres - down) / pres < 0)).alias(f"neg{i}"),
        ]
    out = df.withColumns(new_cols)
    st = df.agg(*aggs).first()
    medians = exact_quantiles(
        out, {f"Down_Ballot_Difference_Percent__{p.key}": [0.5] for p in selected},
        {f"Down_Ballot_Difference_Percent__{p.key}": int(st[f"n{i}"]) for i, p in enumerate(selected)},
    )
    summaries = []
    for i, p in enumerate(selected):
        n = int(st[f"n{i}"])
        if n == 0:
            summaries.append({"key": p.key, "label": p.label, "status": "unavailable"})
            continue
        tp, td = float(st[f"p{i}"]), float(st[f"d{i}"])
        summaries.append({
            "key": p.key,
            "label": p.label,
            "status": "successful",
            "presidential_vote_column": presidential,
            "down_ballot_vote_column": p.column,
            "valid_observations": n,
            "aggregate_difference_votes": tp - td,
            "aggregate_difference_percent_of_presidential": 100 * (tp - td) / tp,
            "median_precinct_difference_percent": medians[(f"Down_Ballot_Difference_Percent__{p.key}", 0.5)],
            "negative_difference_precincts": int(st[f"neg{i}"]),
            "difference_vote_column": f"Down_Ballot_Difference_Votes__{p.key}",
            "difference_percent_column": f"Down_Ballot_Difference_Percent__{p.key}",
        })
    if not any(s["status"] == "successful" for s in summaries):
        raise AnalysisUnavailable(f"{presidential} is positive in no row that has a down-ballot count")
    meta = {
        "definition": "share of the votes that the down-ballot column lacks, in percent",
        "comparisons": summaries,
        "scope": "describes a difference; flags nothing",
    }
    return MethodResult(out, meta)


def summary_frame(result: MethodResult) -> DataFrame:
    """A2 as a DataFrame: one row per comparison, aggregated from the row columns."""
    comps = [c for c in result.diagnostics["comparisons"] if c["status"] == "successful"]
    parts = []
    for c in comps:
        key = c["key"]
        v = F.col(f"Down_Ballot_Difference_Votes__{key}")
        pct = F.col(f"Down_Ballot_Difference_Percent__{key}")
        parts.append(
            result.data.agg(
                F.lit(key).alias("key"),
                F.count(pct).alias("valid_observations"),
                F.sum(v).alias("aggregate_difference_votes"),
                (100 * F.sum(v) / F.sum(F.when(pct.isNotNull(), F.col(c["presidential_vote_column"])))).alias("aggregate_difference_percent_of_presidential"),
                F.lit(c["median_precinct_difference_percent"]).cast("double").alias("median_precinct_difference_percent"),
                F.count_if(pct < 0).alias("negative_difference_precincts"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
