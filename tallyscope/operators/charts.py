"""The data behind the charts (no drawing).

Point series (G1, G2, G4-G6) are projections; for millions of rows use
``binned_points`` (2-D bin counts) rather than collecting points. Histograms
are one min/max aggregation plus one grouped count over a computed bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SHARE_PREFIX
from .common import turnout_column


def _bin_index(x, lo: float, width: float, bins: int):
    """Right-closed equal-width bins over [lo, lo + bins*width], lowest edge included."""
    raw = F.ceil((x - F.lit(lo)) / F.lit(width)) - 1
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def turnout_histogram(df: DataFrame, vote_columns: list[str], bins: int = 25) -> DataFrame:
    """A3: candidate votes summed into equal-width turnout bins; empty bins present (sum 0)."""
    tcol = turnout_column(df)
    cols = [c for c in vote_columns if c in df.columns]
    if not cols or bins < 2:
        raise ValueError("a histogram needs a vote column and two bins")
    t = F.col(tcol).try_cast("double")
    st = df.filter(t.isNotNull()).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if st["lo"] is None or st["lo"] == st["hi"]:
        raise ValueError("turnout does not vary")
    lo, hi = float(st["lo"]), float(st["hi"])
    width = (hi - lo) / bins
    sums = (
        df.filter(t.isNotNull())
        .groupBy(_bin_index(t, lo, width, bins).alias("bin"))
        .agg(*[F.sum(F.col(c).try_cast("double")).alias(c) for c in cols])
    )
    spark: SparkSession = df.sparkSession
    # The bin axis is bounded by ``bins`` rows, so broadcasting it is safe.
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(axis).join(sums, "bin", "left")
    lower = F.lit(lo) + F.col("bin") * F.lit(width)
    upper = F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width))
    return out.select(
        "bin",
        lower.alias("bin_lower"),
        upper.alias("bin_upper"),
        ((lower + upper) / 2).alias("bin_center"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols],
    )


_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def distribution_bins(df: DataFrame, columns: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Per numeric column (default: the first six), equal-width bin counts of non-NULL values."""
    if columns is None:
        columns = [c for c, t in df.dtypes if t in _NUMERIC][:6]
    cols = [c for c, t in df.dtypes if c in columns and t in _NUMERIC]
    if not cols:
        raise ValueError("no numeric column given")
    st = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    parts = []
    for i, c in enumerate(cols):
        lo, hi = st[f"lo{i}"], st[f"hi{i}"]
        if lo is None:
            continue
        lo, hi = float(lo), float(hi)
        width = (hi - lo) / bins if hi > lo else 1.0
        x = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), _bin_index(x, lo, width, bins).alias("bin"),
                              F.lit(lo).alias("lo"), F.lit(width).alias("width"), x.alias("x")))
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter(F.col("x").isNotNull())
    counted = long.groupBy("column", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "column", "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_upper"),
        "n",
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form (one aggregation)."""
    cols = [c for c, t in df.dtypes if c in columns and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if len(cols) < 2:
        raise ValueError("a correlation needs two columns")
    aggs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs.append(F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))).alias(f"c{i}_{j}"))
    wide = df.agg(*aggs)
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            key = f"c{min(i, j)}_{max(i, j)}"
            pairs.append(f"'{a}', '{b}', `{key}`")
    return wide.selectExpr(f"stack({len(pairs)}, {', '.join(pairs)}) AS (column_a, column_b, correlation)")


def flag_counts(df: DataFrame, flag_columns: list[str]) -> DataFrame:
    """Number of flagged records per flag column (NULL counts as not flagged)."""
    cols = [c for c in flag_columns if c in df.columns]
    if not cols:
        raise ValueError("no flag column given")
    wide = df.agg(*[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (flag_column, flagged)")


def turnout_scatter(df: DataFrame, share: str, flag_column: str | None = None) -> DataFrame:
    """G1: turnout, share, identifiers, flag and expected share for non-NULL points."""
    tcol = turnout_column(df)
    if share not in df.columns:
        raise ValueError(f"the frame lacks {share}")
    flag = F.coalesce(F.col(flag_column), F.lit(False)) if flag_column and flag_column in df.columns else F.lit(False)
    exp = F.col("Turnout_Baseline_Expected_Share") if "Turnout_Baseline_Expected_Share" in df.columns else F.lit(None).cast("double")
    return df.filter(F.col(tcol).isNotNull() & F.col(share).isNotNull()).select(
        F.col(tcol).alias("turnout"), F.col(share).alias("share"), "Jurisdiction", "Precinct",
        flag.alias("flagged"), exp.alias("expected_share"),
    )


def residual_series(df: DataFrame) -> DataFrame:
    """Residual and prediction band (relative to the expected share) by turnout."""
    tcol = turnout_column(df)
    req = ["Turnout_Share_Residual", "Turnout_Share_Prediction_Lower", "Turnout_Share_Prediction_Upper", "Turnout_Baseline_Expected_Share"]
    missing = [c for c in req if c not in df.columns]
    if missing:
        raise ValueError(f"the frame lacks {', '.join(missing)}")
    ok = F.col(tcol).isNotNull()
    for c in req:
        ok = ok & F.col(c).isNotNull()
    return df.filter(ok).select(
        F.col(tcol).alias("turnout"),
        F.col("Turnout_Share_Residual").alias("residual"),
        (F.col("Turnout_Share_Prediction_Upper") - F.col("Turnout_Baseline_Expected_Share")).alias("upper_band"),
        (F.col("Turnout_Share_Prediction_Lower") - F.col("Turnout_Baseline_Expected_Share")).alias("lower_band"),
    ).orderBy("turnout", "residual")


def trend_series(df: DataFrame, share: str, votes: str) -> DataFrame:
    """Share against vote count with the descriptive trend when present."""
    key = share[len(SHARE_PREFIX):]
    exp_col = f"Vote_Count_Trend_Expected_Share__{key}"
    exp = F.col(exp_col) if exp_col in df.columns else F.lit(None).cast("double")
    return df.filter(F.col(share).isNotNull() & F.col(votes).isNotNull()).select(
        F.col(votes).alias("votes"), F.col(share).alias("share"), exp.alias("trend_share")
    ).orderBy("votes", "share")


def down_ballot_series(df: DataFrame, presidential: str, percent_column: str) -> DataFrame:
    """Presidential votes against the down-ballot difference percent."""
    if presidential not in df.columns or percent_column not in df.columns:
        raise ValueError("the frame lacks the columns of this pair")
    return df.filter(F.col(presidential).isNotNull() & F.col(percent_column).isNotNull()).select(
        F.col(presidential).alias("presidential_votes"), F.col(percent_column).alias("difference_percent")
    )


def map_points(df: DataFrame, value_column: str | None = None, share: str | None = None) -> DataFrame:
    """Marker rows (value = IF score when present, else the share) and marker class."""
    value_column = value_column or next((c for c in ("IF_Anomaly_Score", share) if c and c in df.columns), None)
    if value_column is None or not {"Latitude", "Longitude"} <= set(df.columns):
        raise ValueError("the frame lacks coordinates")
    v = F.col(value_column).cast("double")
    rows = df.filter(F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull() & v.isNotNull())
    return rows.select(
        "Latitude", "Longitude", v.alias("value"),
        F.concat_ws(" - ", F.col("Jurisdiction").cast("string"), F.col("Precinct").cast("string")).alias("label"),
        F.when(v >= 0.8, F.lit("highlighted")).otherwise(F.lit("normal")).alias("marker_class"),
    )


def map_center(points: DataFrame) -> DataFrame:
    """A10: mean latitude / longitude of the mapped rows."""
    return points.agg(F.avg("Latitude").alias("center_latitude"), F.avg("Longitude").alias("center_longitude"), F.count(F.lit(1)).alias("points"))


def binned_points(df: DataFrame, x: str, y: str, x_bins: int = 200, y_bins: int = 200) -> DataFrame:
    """Bounded scatter for very large inputs: counts on an x_bins * y_bins grid."""
    st = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    x0, x1, y0, y1 = (float(v) if v is not None else 0.0 for v in st)
    wx = (x1 - x0) / x_bins if x1 > x0 else 1.0
    wy = (y1 - y0) / y_bins if y1 > y0 else 1.0
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(_bin_index(F.col(x), x0, wx, x_bins).alias("x_bin"), _bin_index(F.col(y), y0, wy, y_bins).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
