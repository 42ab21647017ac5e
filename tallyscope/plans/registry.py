"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (through the fixture views) over the whole
input; names and output columns match ``oracle_sql`` one to one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.adjust import benjamini_hochberg, holm
from ..operators import charts
from ..operators import digits as m4
from ..operators import features as m9
from ..operators import downballot as m5
from ..operators import dbscan as m12
from ..operators import iforest as m11
from ..operators import scope
from ..operators import spatial as m6
from ..schema import DbscanParams, Settings, SpatialParams
from ..session import ensure_checkpoint_dir
from ..sources import fixtures
from ..sources.csv import read_returns_csv
from ..operators import trend as m3
from ..operators import turnout as m1
from ..schema import fixture_schema
from ..operators.ingest import canonical_columns, ingest
from ..operators.summary import data_summary
from . import oracle_ml
from . import oracle_sql as osql
from .prepare import analysis_frame, raw_ingestion, rounded

Query = Callable[[SparkSession, str], DataFrame]
SHARE_A = "Candidate_Share__candidate_a"


def q_returns_canonical(spark: SparkSession, d: str) -> DataFrame:
    ing = raw_ingestion(spark, d)
    return rounded(ing.validated.select(*canonical_columns(ing)))


def q_returns_issues(spark: SparkSession, d: str) -> DataFrame:
    return raw_ingestion(spark, d).issues.select("Precinct_ID", "code", "severity", "column")


def q_returns_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return raw_ingestion(spark, d).issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_returns_accepted(spark: SparkSession, d: str) -> DataFrame:
    ing = raw_ingestion(spark, d)
    return rounded(ing.accepted.select(*canonical_columns(ing)))


def q_returns_excluded(spark: SparkSession, d: str) -> DataFrame:
    ing = raw_ingestion(spark, d)
    return rounded(ing.excluded.select(*canonical_columns(ing), "Exclusion_Reasons"))


def q_returns_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(data_summary(raw_ingestion(spark, d)))


def _m1(spark: SparkSession, d: str):
    return m1.turnout_share(analysis_frame(spark, d), SHARE_A)


def q_turnout_share(spark: SparkSession, d: str) -> DataFrame:
    res = _m1(spark, d)
    return rounded(res.data.select("Precinct_ID", *m1.OUTPUT_COLUMNS))


def q_turnout_share_model(spark: SparkSession, d: str) -> DataFrame:
    res = _m1(spark, d)
    meta = res.diagnostics
    data = res.data
    return rounded(
        data.agg(
            F.lit(meta["baseline_turnout_upper_limit"]).alias("baseline_turnout_upper_limit"),
            F.lit(meta["baseline_observations"]).cast("bigint").alias("baseline_observations"),
            F.count(F.col("Turnout_Share_Flag")).alias("valid_observations"),
            F.lit(meta["residual_degrees_of_freedom"]).cast("bigint").alias("residual_degrees_of_freedom"),
            F.lit(meta["coefficients"][0]).alias("intercept"),
            F.lit(meta["coefficients"][1]).alias("slope"),
            F.count_if(F.col("Turnout_Share_Flag")).alias("flagged_observations"),
            F.count_if(F.col("Turnout_Share_High_Leverage")).alias("high_leverage_observations"),
            F.sum(F.pow("Turnout_Share_Residual", 2)).alias("sum_loo_squared"),
            F.max(F.abs("Turnout_Share_Studentized_Residual")).alias("max_abs_studentized"),
        )
    )


VOTES_A = "Votes_Candidate_A"
DIGIT_COLS = ["Votes_Candidate_A", "Votes_Candidate_B", "Votes_Candidate_C"]
BENFORD_COLS = ["Registered_Voters", "Ballots_Cast", "Votes_Candidate_A"]


def _m3(spark: SparkSession, d: str):
    return m3.vote_share_trend(analysis_frame(spark, d), SHARE_A, VOTES_A)


def q_vote_share_trend(spark: SparkSession, d: str) -> DataFrame:
    res = _m3(spark, d)
    return rounded(res.data.select("Precinct_ID", res.diagnostics["expected_share_column"], res.diagnostics["residual_column"]))


def q_vote_share_trend_fit(spark: SparkSession, d: str) -> DataFrame:
    res = _m3(spark, d)
    meta = res.diagnostics
    exp = F.col(meta["expected_share_column"])
    return rounded(res.data.agg(
        F.count(exp).alias("valid_observations"),
        F.lit(meta["slope_share_per_100_votes"]).alias("slope_share_per_100_votes"),
        F.lit(meta["intercept"]).alias("intercept"),
        F.lit(meta["r_squared"]).alias("r_squared"),
    ))


def _m5(spark: SparkSession, d: str):
    """Down-ballot comparison for candidate A's pair, then candidate B's pair on its output."""
    schema = fixture_schema()
    data, out = analysis_frame(spark, d), []
    for cand in ("candidate_a", "candidate_b"):
        pairs = [p for p in schema.pairs if p.candidate == cand]
        res = m5.down_ballot_difference(data, schema.candidate(cand).column, pairs)
        data = res.data
        out.append(res)
    return out


def q_down_ballot_rows(spark: SparkSession, d: str) -> DataFrame:
    _ra, rb = _m5(spark, d)
    return rounded(rb.data.select("Precinct_ID", *[c for c in rb.data.columns if c.startswith("Down_Ballot_Difference_")]))


def q_down_ballot_summary(spark: SparkSession, d: str) -> DataFrame:
    ra, rb = _m5(spark, d)
    return rounded(m5.summary_frame(ra).unionByName(m5.summary_frame(rb)))


def q_last_digit_counts(spark: SparkSession, d: str) -> DataFrame:
    return m4.last_digit_table(analysis_frame(spark, d), DIGIT_COLS)


def q_last_digit_chi2(spark: SparkSession, d: str) -> DataFrame:
    t = m4.last_digit_table(analysis_frame(spark, d), DIGIT_COLS)
    g = t.groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    return rounded(g.select("column", "n", (10.0 * F.col("s2") / F.col("n") - F.col("n")).alias("statistic")))


def q_benford_counts(spark: SparkSession, d: str) -> DataFrame:
    return m4.first_digit_table(analysis_frame(spark, d), BENFORD_COLS)


def q_benford_chi2(spark: SparkSession, d: str) -> DataFrame:
    df = analysis_frame(spark, d)
    counts = m4.first_digit_table(df, BENFORD_COLS)
    parts = []
    for c in BENFORD_COLS:
        v = m4.integer_value(c)
        pos = F.when(v > 0, v)
        parts.append(df.agg(F.lit(c).alias("column"), F.count(pos).alias("n_positive"),
                            (F.log10(F.max(pos)) - F.log10(F.min(pos))).alias("orders_of_magnitude")))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p)
    e = F.col("n_positive") * F.log10(1 + 1.0 / F.col("digit"))
    chi = counts.join(stats, "column").groupBy("column", "n_positive", "orders_of_magnitude").agg(
        F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("statistic"))
    return rounded(chi.select("column", "n_positive", "orders_of_magnitude", "statistic",
                              ((F.col("n_positive") >= 100) & (F.col("orders_of_magnitude") >= 2)).alias("meets_preconditions")))


def q_round_number(spark: SparkSession, d: str) -> DataFrame:
    res = m4.digit_diagnostics(analysis_frame(spark, d), DIGIT_COLS)
    return res.data.select("Precinct_ID", *[f"Round_Number_Multiple_10__{c}" for c in DIGIT_COLS])


def _p_table(spark: SparkSession, d: str) -> DataFrame:
    df = analysis_frame(spark, d)
    return df.select("Precinct_ID", "Jurisdiction", F.col(SHARE_A).alias("p")).filter(F.col("p").isNotNull())


def q_holm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(holm(_p_table(spark, d), "p", "holm", family=["Jurisdiction"]).select("Precinct_ID", "Jurisdiction", "p", "holm"))


def q_bh_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(benjamini_hochberg(_p_table(spark, d), "p", "bh").select("Precinct_ID", "p", "bh"))


def q_turnout_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.turnout_histogram(analysis_frame(spark, d), DIGIT_COLS, bins=25))


def q_distribution_bins(spark: SparkSession, d: str) -> DataFrame:
    cols = ["Registered_Voters", "Ballots_Cast", "Valid_Contest_Votes", "Calculated_Turnout_Percent"]
    return rounded(charts.distribution_bins(analysis_frame(spark, d), cols, bins=20))


def q_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    cols = ["Calculated_Turnout_Percent", "Candidate_Share__candidate_a", "Candidate_Share__candidate_b", "Ballots_Cast", "Registered_Voters"]
    return rounded(charts.correlation_matrix(analysis_frame(spark, d), cols))


def q_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return charts.flag_counts(_m1(spark, d).data, ["Turnout_Share_Flag", "Turnout_Share_High_Leverage"])


SCOPE_J = ["NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8", "NATION_13"]


def q_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    df = scope.filter_records(analysis_frame(spark, d), jurisdictions=SCOPE_J, turnout_range=(40, 80), minimum_ballots=100)
    return rounded(df.select("Precinct_ID", "Jurisdiction", "Calculated_Turnout_Percent", "Ballots_Cast"))


def q_scope_vote_type(spark: SparkSession, d: str) -> DataFrame:
    df = scope.filter_records(analysis_frame(spark, d, by_type=True), vote_types=["1-URGENT", "2-HIGH"])
    return rounded(df.select("Precinct_ID", "Vote_Type", "Ballots_Cast"))


def q_turnout_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scope.turnout_bounds(analysis_frame(spark, d)))


def q_jurisdiction_list(spark: SparkSession, d: str) -> DataFrame:
    return scope.distinct_values(analysis_frame(spark, d), "Jurisdiction")


def q_flagged_records(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scope.flagged_records(_m1(spark, d).data).select("Precinct_ID", "Turnout_Share_Studentized_Residual"))


def q_chart_scatter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.turnout_scatter(_m1(spark, d).data, SHARE_A, "Turnout_Share_Flag"))


def q_chart_residual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.residual_series(_m1(spark, d).data))


def q_chart_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.trend_series(_m3(spark, d).data, SHARE_A, VOTES_A))


def q_chart_down_ballot(spark: SparkSession, d: str) -> DataFrame:
    ra, _rb = _m5(spark, d)
    return rounded(charts.down_ballot_series(ra.data, VOTES_A, "Down_Ballot_Difference_Percent__candidate_a_down_ballot"))


def q_chart_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.map_points(analysis_frame(spark, d), share=SHARE_A))


def q_map_center(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.map_center(charts.map_points(analysis_frame(spark, d), share=SHARE_A)))


def _features(spark: SparkSession, d: str):
    frame, names = m9.create_features(analysis_frame(spark, d))
    return frame.persist(), names


def q_features(spark: SparkSession, d: str) -> DataFrame:
    frame, _names = _features(spark, d)
    return rounded(frame)


def q_features_scaled(spark: SparkSession, d: str) -> DataFrame:
    frame, names = _features(spark, d)
    model = m9.fit(frame, names)
    return rounded(m9.transform(frame, model, keep=["Precinct_ID"]).drop("features"))


def _knn_nodes(spark: SparkSession, d: str) -> DataFrame:
    df = analysis_frame(spark, d)
    ok = F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull() & F.col(SHARE_A).isNotNull()
    return df.filter(ok).select(F.col("Precinct_ID").alias("id"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y"))


def _knn(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    nodes = _knn_nodes(spark, d).persist()
    n = nodes.count()
    return m6.knn_edges(nodes, min(SpatialParams().knn_neighbors, n - 1))


def q_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_knn(spark, d))


def q_moran_global(spark: SparkSession, d: str) -> DataFrame:
    nodes, gi = m6.moran_statistics(analysis_frame(spark, d), SHARE_A, _knn(spark, d).select("src", "dst"))
    n = nodes.count()
    return rounded(nodes.agg(F.count(F.lit(1)).alias("valid_observations"), F.lit(gi).alias("global_moran_i"),
                             F.lit(-1.0 / (n - 1)).alias("global_expected_i")))


def q_moran_local(spark: SparkSession, d: str) -> DataFrame:
    nodes, _gi = m6.moran_statistics(analysis_frame(spark, d), SHARE_A, _knn(spark, d).select("src", "dst"))
    return rounded(nodes.select("Precinct_ID", "Local_Moran_I", "Spatial_Pattern"))


def _polygon(spark: SparkSession, d: str, kind: str) -> DataFrame:
    edges = m6.polygon_edges(fixtures.polygons(spark, d), kind)
    return rounded(m6.row_standardise(edges))


def q_polygon_queen(spark: SparkSession, d: str) -> DataFrame:
    return _polygon(spark, d, "queen")


def q_polygon_rook(spark: SparkSession, d: str) -> DataFrame:
    return _polygon(spark, d, "rook")


def q_moran_permutation(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    res = m6.moran(analysis_frame(spark, d), SHARE_A)
    meta = res.diagnostics
    return rounded(res.tables["local"].select(
        "Precinct_ID", "Local_Moran_I", "Local_Moran_Raw_P", "Local_Moran_Adjusted_P", "Spatial_Significant",
        F.lit(meta["global_moran_i"]).alias("global_moran_i"), F.lit(meta["global_permutation_p"]).alias("global_permutation_p")))


def _forest(spark: SparkSession, d: str):
    frame, names = _features(spark, d)
    model = m9.fit(frame, names)
    scaled = m9.transform(frame, model, keep=["Precinct_ID"]).select("Precinct_ID", "features").persist()
    return scaled, m11.fit_forest(scaled, model.features), model


def q_isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    frame, names = _features(spark, d)
    model = m9.fit(frame, names)
    scaled = m9.transform(frame, model, keep=["Precinct_ID"]).select("Precinct_ID", "features").persist()
    _forest_model, flagged = m11.fit_and_score(scaled, model.features)
    return rounded(flagged.select("Precinct_ID", "IF_Anomaly_Flag", "IF_Anomaly_Score"))


def q_if_importance(spark: SparkSession, d: str) -> DataFrame:
    scaled, forest, _model = _forest(spark, d)
    return rounded(m11.feature_importance(scaled, forest))


def q_score_new_data(spark: SparkSession, d: str) -> DataFrame:
    """Fit on precinct returns, score the vote-type grain with the fitted scaler and forest."""
    _scaled, forest, model = _forest(spark, d)
    new_frame, _names = m9.create_features(analysis_frame(spark, d, by_type=True))
    new_scaled = m9.transform(new_frame, model, keep=["Precinct_ID"])
    return rounded(m11.score(new_scaled, forest).select("Precinct_ID", "IF_Anomaly_Flag", "IF_Anomaly_Score"))


DBSCAN_COORDS = DbscanParams(enabled=True, eps=0.1, min_samples=5)


def _dbscan_coords(spark: SparkSession, d: str):
    df = analysis_frame(spark, d)
    pts = df.filter(F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull()).select(
        "Precinct_ID", F.array("Latitude", "Longitude").alias("features")).persist()
    return pts, m12.dbscan(pts, DBSCAN_COORDS)


def q_dbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    _pts, res = _dbscan_coords(spark, d)
    return res.data


def q_dbscan_features(spark: SparkSession, d: str) -> DataFrame:
    """M12 at its defaults over the scaled feature matrix (M10), with its statistics."""
    frame, names = _features(spark, d)
    scaled = m9.transform(frame, m9.fit(frame, names), keep=["Precinct_ID"]).select("Precinct_ID", "features")
    res = m12.dbscan(scaled, DbscanParams(enabled=True))
    found = res.diagnostics
    return res.data.select("*", F.lit(found["n_clusters"]).cast("bigint").alias("n_clusters"), F.lit(found["n_noise"]).cast("bigint").alias("n_noise"),
                           F.round(F.lit(found["noise_ratio"]), 6).alias("noise_ratio"))


def q_cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    pts, res = _dbscan_coords(spark, d)
    return rounded(m12.cluster_profile(res.data, pts, ["Latitude", "Longitude"]))


def q_turnout_share_by_type(spark: SparkSession, d: str) -> DataFrame:
    """M1 at the precinct x vote-type grain (key Jurisdiction::Precinct::Vote_Type)."""
    res = m1.turnout_share(analysis_frame(spark, d, by_type=True), SHARE_A)
    return rounded(res.data.select("Precinct_ID", "Turnout_Share_Residual", "Turnout_Share_Studentized_Residual", "Turnout_Share_Flag"))


def q_polygon_moran(spark: SparkSession, d: str) -> DataFrame:
    """M6 statistics under queen contiguity of the precinct polygons (M8)."""
    edges = m6.polygon_edges(fixtures.polygons(spark, d), "queen")
    nodes, _gi = m6.moran_statistics(analysis_frame(spark, d), SHARE_A, edges)
    return rounded(nodes.select("Precinct_ID", "Local_Moran_I", "Spatial_Pattern"))


def q_binned_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Bounded turnout/share scatter: 50 x 50 bin counts instead of points."""
    return charts.binned_points(analysis_frame(spark, d), "Calculated_Turnout_Percent", SHARE_A, 50, 50)


def q_returns_preview(spark: SparkSession, d: str) -> DataFrame:
    """First 25 accepted records by key (the limit is the feature)."""
    ing = raw_ingestion(spark, d)
    return rounded(scope.preview(ing.accepted.select(*canonical_columns(ing)), 25))


def q_validation_status(spark: SparkSession, d: str) -> DataFrame:
    """P16 status line from the validated table (one aggregation)."""
    summary = data_summary(raw_ingestion(spark, d))
    return summary.select(
        F.when(F.col("errors") == 0, F.lit("valid")).otherwise(F.lit("valid_with_exclusions")).alias("status"),
        "original_rows", F.col("total_precincts").alias("accepted_rows"), "excluded_rows")


def q_digit_tests(spark: SparkSession, d: str) -> DataFrame:
    """M4 dataset-level tests with Holm-adjusted p-values (p-values need the chi-square tail)."""
    res = m4.digit_diagnostics(analysis_frame(spark, d), DIGIT_COLS + BENFORD_COLS[:2], m4.DigitParams(benford_enabled=True))
    rows = [(t["column"], t["test"], t["status"], t.get("statistic"), t.get("p_value"), t.get("adjusted_p_value"), t.get("significant"))
            for t in res.diagnostics["tests"]]
    return rounded(spark.createDataFrame(rows, "column string, test string, status string, statistic double, p_value double, adjusted_p_value double, significant boolean"))


def q_alternate_layout(spark: SparkSession, d: str) -> DataFrame:
    """Returns in the two-party layout, recognised by its columns; a column of a generated name collides."""
    r = fixtures.returns(spark, d)
    part = F.floor(F.col("Registered_Voters") / 3).cast("bigint")
    source = r.select(
        F.col("Jurisdiction").alias("County"), "Precinct", F.col("Latitude").alias("Lat"), F.col("Longitude").alias("Lon"),
        part.alias("Registered_Dem"), (F.col("Registered_Voters") - part).alias("Registered_Rep"),
        F.col("Votes_Candidate_A").alias("Votes_Harris"), F.col("Votes_Candidate_B").alias("Votes_Trump"),
        F.col("Valid_Contest_Votes").alias("Total_Votes"),
        (F.col("Valid_Contest_Votes") / F.col("Registered_Voters") * 100).alias("Turnout_Percent"), F.lit("old").alias("Jurisdiction"))
    ing = ingest(source)
    return rounded(ing.accepted.select(
        "Precinct_ID", "Jurisdiction", "Source_Original__Jurisdiction", "Registered_Voters", "Ballots_Cast", "Valid_Contest_Votes",
        "Latitude", "Longitude", "Reported_Turnout_Percent", "Calculated_Turnout_Percent", "Candidate_Share__harris", "Candidate_Share__trump",
        F.lit(ing.schema.name).alias("layout"), F.lit(len(ing.file_issues)).alias("file_issues")))


CSV_COLS = ["Jurisdiction", "Precinct", "Valid_Contest_Votes", "Votes_Candidate_A", "Votes_Candidate_B", "note"]


def q_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Returns written to CSV in two column orders, with quotes and line breaks, and read back."""
    note = F.concat(F.lit('say "'), F.col("Precinct"), F.lit('",\nthen a line'))
    r = fixtures.returns(spark, d).withColumn("note", note).select(*CSV_COLS)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    for i, cols in enumerate((CSV_COLS, CSV_COLS[::-1])):
        part = r.filter(F.pmod(F.col("Valid_Contest_Votes").cast("bigint"), F.lit(2)) == i)
        part.select(*cols).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{i}")
    df, encodings = read_returns_csv(spark, [f"{path}/0", f"{path}/1"])
    numbers = [F.col(c).cast("double").alias(c) for c in CSV_COLS[2:5]]
    return rounded(df.select("Jurisdiction", "Precinct", *numbers, "note", F.lit(",".join(sorted(set(encodings.values())))).alias("encodings")))


def q_method_status(spark: SparkSession, d: str) -> DataFrame:
    """The full workflow over the validated returns; one status row per method."""
    from .prepare import typed_ingestion
    from .workflow import ALL_METHODS, run_workflow

    ensure_checkpoint_dir(spark)
    settings = Settings(dbscan=DbscanParams(enabled=True))
    run = run_workflow(typed_ingestion(spark, d), candidate_key="candidate_a", methods=ALL_METHODS, settings=settings)
    return run.status_frame(spark).select("method", "state", "message")


def q_bundle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A run's bundle written, read back by type: every analysed row, and the rows of its other tables."""
    from ..sources.export import read_bundle, write_bundle
    from .prepare import typed_ingestion
    from .workflow import run_workflow

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    ing = typed_ingestion(spark, d)
    write_bundle(ing, run_workflow(ing, candidate_key="candidate_a", methods=["turnout_share"]), path)
    tables = read_bundle(spark, path)
    rows = {name: tables[name].count() for name in ("validated_input", "excluded_records", "flagged_diagnostics")}
    return rounded(tables["analysis_results"].select(
        "Precinct_ID", "Turnout_Share_Residual", "Turnout_Share_Studentized_Residual", "Turnout_Share_High_Leverage", "Turnout_Share_Flag",
        *[F.lit(n).cast("bigint").alias(name) for name, n in rows.items()]))


def q_forest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A fitted forest written, read back, and the rows scored by what was read."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    scaled, forest, model = _forest(spark, d)
    m11.save_forest(forest, path, model.to_json())
    loaded, _text = m11.load_forest(path)
    return rounded(m11.score(scaled, loaded).select("Precinct_ID", "IF_Anomaly_Flag", "IF_Anomaly_Score"))


FILE_COLS = ["Jurisdiction", "Precinct", "Valid_Contest_Votes", "Votes_Candidate_A"]


def q_csv_file_issues(spark: SparkSession, d: str) -> DataFrame:
    """A folder per jurisdiction, some spoiled by number; one row per bad folder, rule and message."""
    from ..sources.csv import file_issues

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    r = fixtures.returns(spark, d).select(*FILE_COLS, F.regexp_extract("Jurisdiction", r"(\d+)$", 1).cast("int").alias("no")).persist()
    text = F.concat_ws(",", *FILE_COLS)
    # how the file of a jurisdiction looks: its header, its rows
    spoiled = F.pmod(F.col("no"), F.lit(5))
    head = F.when(spoiled == 1, F.lit("Jurisdiction,Precinct,Precinct,Votes_Candidate_A")).when(spoiled == 2, F.lit("Jurisdiction,Precinct,Total,Votes_Candidate_A")).otherwise(F.lit(",".join(FILE_COLS)))
    body = F.when(spoiled == 3, F.concat(text, F.lit(",one more"))).otherwise(text)
    grouped = r.groupBy("no").agg(F.array_sort(F.collect_list(body)).alias("lines"), F.first(head).alias("head"))
    lines = grouped.select("no", F.when(F.pmod(F.col("no"), F.lit(5)) == 4, F.col("head")).otherwise(F.concat(F.col("head"), F.lit("\n"), F.array_join("lines", "\n"))).alias("value"))
    lines.repartition("no").write.partitionBy("no").text(path)
    found = file_issues(spark, f"{path}/*", required=FILE_COLS)
    return found.select(F.regexp_extract("path", r"no=(\d+)", 1).cast("int").alias("no"), "code", "message")


def q_file_digests(spark: SparkSession, d: str) -> DataFrame:
    """A file per jurisdiction, its lines in order; length and SHA-256 of each, read range by range."""
    from ..sources.ranges import file_digests

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}"
    lines = fixtures.returns(spark, d).select(F.regexp_extract("Jurisdiction", r"(\d+)$", 1).cast("int").alias("no"), F.concat_ws(",", *FILE_COLS).alias("value"))
    lines.repartition("no").sortWithinPartitions("no", "value").write.partitionBy("no").text(path)
    found = file_digests(spark, f"{path}/*", cell_bytes=0)
    return found.select(F.regexp_extract("path", r"no=(\d+)", 1).cast("int").alias("no"), "length", "sha256")


def q_issue_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 issues by key, rule and column (the limit is the feature)."""
    return scope.issue_preview(raw_ingestion(spark, d), 50).select("Precinct_ID", "code", "severity", "column")


QUERIES: dict[str, Query] = {
    "returns_canonical": q_returns_canonical,
    "returns_issues": q_returns_issues,
    "returns_issue_counts": q_returns_issue_counts,
    "returns_accepted": q_returns_accepted,
    "returns_excluded": q_returns_excluded,
    "returns_summary": q_returns_summary,
    "turnout_share": q_turnout_share,
    "turnout_share_model": q_turnout_share_model,
    "vote_share_trend": q_vote_share_trend,
    "vote_share_trend_fit": q_vote_share_trend_fit,
    "down_ballot_rows": q_down_ballot_rows,
    "down_ballot_summary": q_down_ballot_summary,
    "last_digit_counts": q_last_digit_counts,
    "last_digit_chi2": q_last_digit_chi2,
    "benford_counts": q_benford_counts,
    "benford_chi2": q_benford_chi2,
    "round_number": q_round_number,
    "holm_adjusted": q_holm_adjusted,
    "bh_adjusted": q_bh_adjusted,
    "turnout_histogram": q_turnout_histogram,
    "distribution_bins": q_distribution_bins,
    "correlation_matrix": q_correlation_matrix,
    "flag_counts": q_flag_counts,
    "scope_filter": q_scope_filter,
    "scope_vote_type": q_scope_vote_type,
    "turnout_bounds": q_turnout_bounds,
    "jurisdiction_list": q_jurisdiction_list,
    "flagged_records": q_flagged_records,
    "chart_scatter": q_chart_scatter,
    "chart_residual": q_chart_residual,
    "chart_trend": q_chart_trend,
    "chart_down_ballot": q_chart_down_ballot,
    "chart_map": q_chart_map,
    "map_center": q_map_center,
    "features": q_features,
    "features_scaled": q_features_scaled,
    "knn_edges": q_knn_edges,
    "moran_global": q_moran_global,
    "moran_local": q_moran_local,
    "polygon_queen": q_polygon_queen,
    "polygon_rook": q_polygon_rook,
    "moran_permutation": q_moran_permutation,
    "isolation_forest": q_isolation_forest,
    "if_importance": q_if_importance,
    "score_new_data": q_score_new_data,
    "dbscan_labels": q_dbscan_labels,
    "dbscan_features": q_dbscan_features,
    "bundle_round_trip": q_bundle_round_trip,
    "forest_round_trip": q_forest_round_trip,
    "csv_file_issues": q_csv_file_issues,
    "file_digests": q_file_digests,
    "issue_preview": q_issue_preview,
    "cluster_profile": q_cluster_profile,
    "turnout_share_by_type": q_turnout_share_by_type,
    "polygon_moran": q_polygon_moran,
    "binned_scatter": q_binned_scatter,
    "returns_preview": q_returns_preview,
    "validation_status": q_validation_status,
    "digit_tests": q_digit_tests,
    "method_status": q_method_status,
    "alternate_layout": q_alternate_layout,
    "csv_round_trip": q_csv_round_trip,
}

ORACLES: dict[str, Callable[[], str]] = {
    "returns_canonical": osql.returns_canonical,
    "returns_issues": osql.returns_issues,
    "returns_issue_counts": osql.returns_issue_counts,
    "returns_accepted": osql.returns_accepted,
    "returns_excluded": osql.returns_excluded,
    "returns_summary": osql.returns_summary,
    "turnout_share": osql.turnout_share,
    "turnout_share_model": osql.turnout_share_model,
    **{name: getattr(osql, name) for name in (
        "vote_share_trend", "vote_share_trend_fit", "down_ballot_rows", "down_ballot_summary",
        "last_digit_counts", "last_digit_chi2", "benford_counts", "benford_chi2", "round_number",
        "holm_adjusted", "bh_adjusted", "turnout_histogram", "distribution_bins", "correlation_matrix",
        "flag_counts", "scope_filter", "scope_vote_type", "turnout_bounds", "jurisdiction_list",
        "flagged_records", "chart_scatter", "chart_residual", "chart_trend", "chart_down_ballot",
        "chart_map", "map_center", "features", "features_scaled",
        "knn_edges", "moran_global", "moran_local", "moran_permutation", "polygon_queen", "polygon_rook",
        "dbscan_labels", "cluster_profile", "turnout_share_by_type", "polygon_moran", "binned_scatter",
        "returns_preview", "validation_status", "digit_tests", "alternate_layout", "csv_round_trip",
    )},
    **{name: getattr(oracle_ml, name) for name in ("dbscan_features", "isolation_forest", "if_importance", "score_new_data", "method_status", "forest_round_trip")},
    **{name: getattr(osql, name) for name in ("bundle_round_trip", "csv_file_issues", "file_digests", "issue_preview")},
}
