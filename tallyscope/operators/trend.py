"""M3: candidate share against candidate vote count (descriptive OLS line).

One aggregation (Spark's regr_* family plus the moments for the slope test)
and one projection; the p-value is a driver scalar from the t distribution.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_two_sided_p
from ..schema import SHARE_PREFIX
from .common import AnalysisUnavailable, MethodResult


def vote_share_trend(df: DataFrame, share: str, votes: str) -> MethodResult:
    missing = [c for c in ("Precinct_ID", share, votes) if c not in df.columns]
    if missing:
        raise AnalysisUnavailable(f"the trend needs the columns {', '.join(missing)}")
    y, x = F.col(share).cast("double"), F.col(votes).cast("double")
    ok = F.col("Precinct_ID").isNotNull() & y.isNotNull() & x.isNotNull()
    st = df.filter(ok).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("xmin"), F.max(x).alias("xmax"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"),
    ).first()
    n = int(st["n"])
    if n < 3:
        raise AnalysisUnavailable(f"{n} rows with votes and share, 3 needed")
    if st["xmin"] == st["xmax"]:
        raise AnalysisUnavailable(f"{votes} does not vary")
    vx, vy, cxy = float(st["vx"]), float(st["vy"]), float(st["cxy"])
    slope = cxy / vx
    intercept = float(st["my"]) - slope * float(st["mx"])
    r = cxy / math.sqrt(vx * vy) if vx > 0 and vy > 0 else 0.0
    r = max(-1.0, min(1.0, r))
    dof = n - 2
    if abs(r) == 1.0:
        p = 0.0
    else:
        t = r * math.sqrt(dof / ((1.0 - r) * (1.0 + r)))
        p = t_two_sided_p(t, dof)
    key = share[len(SHARE_PREFIX):] if share.startswith(SHARE_PREFIX) else share
    exp_col, res_col = f"Vote_Count_Trend_Expected_Share__{key}", f"Vote_Count_Trend_Residual__{key}"
    expected = F.lit(intercept) + F.lit(slope) * x
    out = df.withColumns({exp_col: F.when(ok, expected), res_col: F.when(ok, y - expected)})
    meta = {
        "model": "least-squares line of share on votes",
        "candidate_vote_column": votes,
        "candidate_share_column": share,
        "valid_observations": n,
        "slope_share_per_100_votes": slope * 100,
        "intercept": intercept,
        "r_squared": r * r,
        "slope_p_value": p,
        "expected_share_column": exp_col,
        "residual_column": res_col,
        "scope": "describes a relation; flags nothing",
    }
    return MethodResult(out, meta)
