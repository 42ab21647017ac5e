"""Validation rules, canonicalisation and schema selection."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tallyscope.operators.ingest import DataValidationError, ingest
from tallyscope.plans.prepare import raw_ingestion
from tallyscope.schema import Candidate, ContestSchema, default_schema, fixture_schema

# Expected rule counts on returns_raw at sf0.001 (FIXTURES.md section 3).
EXPECTED_0001 = {
    "missing_identifier": 2, "duplicate_precinct_id": 4, "nonnumeric_count": 2, "nonintegral_count": 2,
    "negative_count": 2, "missing_critical_count": 4, "candidate_votes_exceed_contest": 3,
    "contest_votes_exceed_ballots": 2, "ballots_exceed_registration": 2, "invalid_or_missing_coordinate": 4,
    "nonnumeric_reported_turnout": 2, "impossible_reported_turnout": 2, "turnout_mismatch": 6,
}


def test_rule_counts_match_fixture(spark):
    ing = raw_ingestion(spark, SF0001)
    got = {r["code"]: r["n"] for r in ing.issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == EXPECTED_0001
    rep = ing.report()
    assert rep["original_rows"] == 152 and rep["excluded_rows"] == 24 and rep["accepted_rows"] == 128
    assert not rep["is_valid"]


def test_exclusion_reasons_sorted_and_distinct(spark):
    ing = raw_ingestion(spark, SF0001)
    reasons = [r[0] for r in ing.excluded.select("Exclusion_Reasons").collect()]
    assert all(r == ";".join(sorted(set(r.split(";")))) for r in reasons)
    assert any("duplicate_precinct_id" in r for r in reasons)


def _df(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


BASE_COLS = ["Jurisdiction", "Precinct", "Registered_Voters", "Ballots_Cast", "Valid_Contest_Votes",
             "Votes_Candidate_A", "Votes_Candidate_B", "Reported_Turnout_Percent", "Latitude", "Longitude"]


def _row(p, a="40", b="50", valid="100", ballots="110", reg="200", rep="55.0", lat="40.0", lon="-90.0", j="J1"):
    return (j, p, reg, ballots, valid, a, b, rep, lat, lon)


def _codes(ing):
    return sorted((r["Precinct_ID"], r["code"]) for r in ing.issues.collect())


def test_numeric_parsing_rules(spark):
    rows = [_row("p1", a="1d"), _row("p2", a="inf"), _row("p3", a="0.5"), _row("p4", a=" 40 "),
            _row("p5", valid="100000.5", a="40", b="50", ballots="100001", reg="200000", rep="50.0"), _row("p6", a="-3")]
    ing = ingest(_df(spark, rows, BASE_COLS), default_schema())
    codes = _codes(ing)
    assert ("J1::p1", "nonnumeric_count") in codes  # '1d' is not a plain number
    assert ("J1::p2", "nonnumeric_count") in codes  # infinity rejected deliberately
    assert ("J1::p3", "nonintegral_count") in codes
    assert not any(p == "J1::p4" for p, _ in codes)  # surrounding blanks are fine
    assert ("J1::p5", "nonintegral_count") not in codes  # within the 1e-5 relative tolerance
    assert ("J1::p6", "negative_count") in codes


def test_identifiers_keep_leading_zeros_and_trim(spark):
    rows = [_row("0001", j="  J1 \t")]
    acc = ingest(_df(spark, rows, BASE_COLS), default_schema()).accepted.collect()
    assert acc[0]["Precinct_ID"] == "J1::0001"


def test_zero_registration_gives_null_turnout(spark):
    rows = [_row("p1", reg="0", ballots="0", valid="0", a="0", b="0", rep="0")]
    row = ingest(_df(spark, rows, BASE_COLS), default_schema()).validated.collect()[0]
    assert row["Calculated_Turnout_Percent"] is None and row["Candidate_Share__candidate_a"] is None


def test_vote_type_in_key(spark):
    cols = BASE_COLS + ["Vote_Type"]
    rows = [_row("p1") + ("Mail",), _row("p1") + ("Early",)]
    schema = default_schema().with_vote_type("Vote_Type")
    ing = ingest(_df(spark, rows, cols), schema)
    ids = sorted(r[0] for r in ing.accepted.select("Precinct_ID").collect())
    assert ids == ["J1::p1::Early", "J1::p1::Mail"]


def test_reserved_collision_preserved(spark):
    cols = ["CountyName", "Jurisdiction", "Source_Original__Jurisdiction", "PrecinctName", "ContestTotal", "Choice"]
    rows = [("C1", "old", "older", "P1", "10", "5")]
    schema = ContestSchema({"jurisdiction": "CountyName", "precinct": "PrecinctName", "valid_contest_votes": "ContestTotal"},
                           candidates=(Candidate("Choice", "Choice", "choice"),))
    ing = ingest(_df(spark, rows, cols), schema)
    row = ing.accepted.collect()[0]
    assert row["Jurisdiction"] == "C1"
    assert row["Source_Original__Jurisdiction__2"] == "old"
    assert any(d["code"] == "reserved_column_collision" for d in ing.file_issues)


def test_alternate_schema_derives_registration(spark):
    cols = ["County", "Precinct", "Lat", "Lon", "Registered_Dem", "Registered_Rep", "Votes_Harris", "Votes_Trump",
            "Total_Votes", "Turnout_Percent"]
    rows = [("C", "P1", "40", "-90", "100", "120", "50", "60", "110", "50.0"),
            ("C", "P2", "40", "-90", "x", "120", "50", "60", "110", "50.0")]
    ing = ingest(_df(spark, rows, cols))
    assert ing.schema.name == "legacy_harris_trump"
    regs = {r["Precinct"]: r["Registered_Voters"] for r in ing.validated.collect()}
    assert regs["P1"] == 220.0 and regs["P2"] is None
    assert any(d["code"] == "legacy_registration_derived" for d in ing.file_issues)


def test_missing_mapping_is_fatal(spark):
    with pytest.raises(DataValidationError, match="lacks"):
        ingest(_df(spark, [("a", "b")], ["Jurisdiction", "Precinct"]), default_schema())


def test_third_candidate_counts_in_sum(spark):
    cols = BASE_COLS + ["Votes_Candidate_C"]
    rows = [_row("p1", a="40", b="50") + ("20",)]
    ing = ingest(_df(spark, rows, cols), fixture_schema())
    assert ("J1::p1", "candidate_votes_exceed_contest") in _codes(ing)
