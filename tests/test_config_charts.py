"""Parameter guards (ValueError at construction) and chart-data operators."""

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import charts
from tallyscope.schema import (
    Candidate, ContestSchema, DbscanParams, DigitParams, DownBallotPair, ForestParams, Settings, SpatialParams,
    TurnoutShareParams, default_schema,
)


@pytest.mark.parametrize("build", [
    lambda: TurnoutShareParams(confidence_level=1.0),
    lambda: TurnoutShareParams(polynomial_degree=0),
    lambda: TurnoutShareParams(studentized_residual_threshold=0),
    lambda: DigitParams(alpha=1.0),
    lambda: SpatialParams(weights_type="hex"),
    lambda: SpatialParams(knn_neighbors=0),
    lambda: SpatialParams(permutations=True),
    lambda: ForestParams(contamination=0.7),
    lambda: ForestParams(n_estimators=0),
    lambda: DbscanParams(metric="chebyshev"),
    lambda: DbscanParams(eps=0),
    lambda: Settings(turnout_tolerance=-1),
    lambda: ContestSchema({"jurisdiction": "J", "precinct": "P"}, ()),
    lambda: ContestSchema({"jurisdiction": "J", "precinct": "P"}, (Candidate("a", "A", "k"), Candidate("b", "B", "k"))),
    lambda: ContestSchema({"jurisdiction": "J", "precinct": "P"}, (Candidate("a", "A", "k"),), pairs=(DownBallotPair("zz", "d", "D", "p"),)),
])
def test_parameter_guards(build):
    with pytest.raises(ValueError):
        build()


def test_valid_defaults_build():
    s = Settings()
    assert s.spatial.permutations == 999 and s.forest.contamination == "auto" and not s.dbscan.enabled
    assert default_schema().share_columns == ("Candidate_Share__candidate_a", "Candidate_Share__candidate_b")


def test_chart_operators(frame_0001):
    hist = charts.turnout_histogram(frame_0001, ["Votes_Candidate_A", "Votes_Candidate_B"], bins=25)
    rows = hist.collect()
    assert len(rows) == 25
    total = frame_0001.agg(F.sum("Votes_Candidate_A")).first()[0]
    assert abs(sum(r["Votes_Candidate_A"] for r in rows) - total) < 1e-6
    with pytest.raises(ValueError):
        charts.turnout_histogram(frame_0001, ["Votes_Candidate_A"], bins=1)
    with pytest.raises(ValueError, match="lacks"):
        charts.residual_series(frame_0001)
    with pytest.raises(ValueError):
        charts.down_ballot_series(frame_0001, "Votes_Candidate_A", "nope")
    pts = charts.map_points(frame_0001, share="Candidate_Share__candidate_a")
    assert pts.count() == frame_0001.count()
    assert set(r[0] for r in pts.select("marker_class").distinct().collect()) <= {"highlighted", "normal"}
    dist = charts.distribution_bins(frame_0001)
    assert dist.select("column").distinct().count() == 6
    corr = {(r[0], r[1]): r[2] for r in charts.correlation_matrix(frame_0001, ["Ballots_Cast", "Registered_Voters"]).collect()}
    assert corr[("Ballots_Cast", "Ballots_Cast")] == pytest.approx(1.0)
    assert corr[("Ballots_Cast", "Registered_Voters")] == corr[("Registered_Voters", "Ballots_Cast")]
    binned = charts.binned_points(frame_0001, "Calculated_Turnout_Percent", "Candidate_Share__candidate_a", 10, 10)
    assert binned.agg(F.sum("n")).first()[0] == frame_0001.count()
