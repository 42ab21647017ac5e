"""Scope filters, runners, statuses, export bundle, CSV source and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tallyscope.operators import scope
from tallyscope.operators.ingest import DataValidationError, ingest
from tallyscope.plans.prepare import typed_ingestion
from tallyscope.plans.workflow import run_workflow
from tallyscope.schema import ContestSchema, DbscanParams, Settings, SpatialParams, default_schema, fixture_schema
from tallyscope.sources import csv as csvsrc
from tallyscope.sources.export import BUNDLE, write_bundle
from tallyscope.streaming.validate import validate_stream


def test_scope_filters(frame_0001):
    f = scope.filter_records(frame_0001, jurisdictions=["NATION_1"], turnout_range=(0, 100), minimum_ballots=1)
    assert f.count() > 0 and {r[0] for r in f.select("Jurisdiction").distinct().collect()} == {"NATION_1"}
    assert scope.filter_records(frame_0001, jurisdictions=[]).count() == 0
    assert scope.filter_records(frame_0001, vote_types=["x"]).count() == frame_0001.count()  # no Vote_Type column


def test_workflow_statuses_and_bundle(spark, tmp_path):
    ing = typed_ingestion(spark, SF0001)
    settings = Settings(spatial=SpatialParams(permutations=99))
    methods = ["turnout_share", "vote_share_by_count", "down_ballot_difference", "digit_diagnostics", "spatial",
               "isolation_forest", "dbscan"]
    run = run_workflow(ing, candidate_key="candidate_a", methods=methods, settings=settings)
    states = {k: v.state for k, v in run.statuses.items()}
    assert states["dbscan"] == "skipped"
    assert all(states[m] == "successful" for m in methods[:-1]), states
    assert {"Turnout_Share_Flag", "Spatial_Significant", "IF_Anomaly_Score"} <= set(run.data.columns)
    assert run.data.count() == 150
    out = str(tmp_path / "bundle")
    written = write_bundle(ing, run, out)
    assert sorted(os.path.basename(p) for p in written) == sorted(BUNDLE)
    assert all(os.path.exists(p) for p in written)
    flagged = scope.flagged_records(run.data).count()
    assert flagged == run.data.filter(F.coalesce("Turnout_Share_Flag", F.lit(False)) | F.coalesce("Spatial_Significant", F.lit(False))
                                      | F.coalesce("IF_Anomaly_Flag", F.lit(False))).count()


def test_workflow_isolates_failures_and_empty_scope(spark, frame_0001):
    ing = typed_ingestion(spark, SF0001)
    settings = Settings(dbscan=DbscanParams(enabled=True, eps=1e-9, min_samples=50))
    run = run_workflow(ing, candidate_key="candidate_a", methods=["turnout_share", "dbscan"], settings=settings)
    assert run.statuses["turnout_share"].state == "successful" and run.statuses["dbscan"].state == "unavailable"
    empty = scope.filter_records(ing.accepted, jurisdictions=[])
    run2 = run_workflow(ing, candidate_key="candidate_a", methods=["turnout_share"], scope=empty)
    assert run2.statuses["turnout_share"].state == "unavailable"
    with pytest.raises(ValueError):
        run_workflow(ing, candidate_key="candidate_a", methods=["nope"])
    with pytest.raises(ValueError):
        run_workflow(ing, candidate_key="zzz", methods=["turnout_share"])


def test_csv_source_encodings_and_errors(spark, tmp_path):
    header = "Jurisdiction,Precinct,Valid_Contest_Votes,Votes_Candidate_A,Votes_Candidate_B\n"
    body = "Åland,P1,10,4,5\nCôte,P2,12,6,6\n"
    (tmp_path / "u.csv").write_bytes(("﻿" + header + body).encode("utf-8"))
    (tmp_path / "w.csv").write_bytes((header + body.replace("P1", "P3").replace("P2", "P4") + "Euro€,P5,1,0,1\n").encode("cp1252"))
    (tmp_path / "l.csv").write_bytes((header + "X\u0081Y,P6,1,0,1\n").encode("latin-1"))
    paths = [str(tmp_path / n) for n in ("u.csv", "w.csv", "l.csv")]
    df, enc = csvsrc.read_returns_csv(spark, paths)
    got = {os.path.basename(k): v for k, v in enc.items()}
    # The line reader drops the byte-order mark, so u.csv reads (and reports) as utf-8.
    assert got == {"u.csv": "utf-8", "w.csv": "cp1252", "l.csv": "latin-1"}
    names = {r[0] for r in df.select("Jurisdiction").collect()}
    assert {"Åland", "Côte", "Euro€", "X\u0081Y"} <= names
    ing = ingest(df, ContestSchema({"jurisdiction": "Jurisdiction", "precinct": "Precinct", "valid_contest_votes": "Valid_Contest_Votes"},
                                   default_schema().candidates))
    assert ing.report()["original_rows"] == 6
    import hashlib

    prov = {os.path.basename(r["path"]): r for r in csvsrc.provenance(spark, paths, enc).collect()}
    for name in ("u.csv", "w.csv", "l.csv"):
        assert prov[name]["sha256"] == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
        assert prov[name]["length"] == (tmp_path / name).stat().st_size
    (tmp_path / "d.csv").write_text("a,a,b\n1,2,3\n")
    with pytest.raises(DataValidationError, match="more than once"):
        csvsrc.read_returns_csv(spark, str(tmp_path / "d.csv"))
    (tmp_path / "m.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(DataValidationError, match="more fields"):
        csvsrc.read_returns_csv(spark, str(tmp_path / "m.csv"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(DataValidationError, match="without content"):
        csvsrc.read_returns_csv(spark, str(tmp_path / "e.csv"))


def test_streaming_validation(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    from tallyscope.sources.fixtures import returns_raw

    returns_raw(spark, SF0001).write.mode("overwrite").parquet(str(src / "batch"))
    schema = spark.read.parquet(str(src / "batch")).schema
    stream = spark.readStream.schema(schema).parquet(str(src / "batch"))
    ing = validate_stream(stream, fixture_schema())
    q = ing.issues.writeStream.format("memory").queryName("stream_issues").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    counts = {r[0]: r[1] for r in spark.sql("SELECT code, count(*) FROM stream_issues GROUP BY code").collect()}
    assert "duplicate_precinct_id" not in counts and counts["turnout_mismatch"] == 6 and counts["missing_identifier"] == 2


def test_csv_column_order_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('J,P,A,B\n"x ""q"", y",p1,10,20\n"two\nlines",p2,1,2\n')
    (tmp_path / "b.csv").write_text("J,P,B,A\nj,p3,20,10\n")
    df, enc = csvsrc.read_returns_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    got = {r["P"]: (r["J"], r["A"], r["B"]) for r in df.collect()}
    assert got == {"p1": ('x "q", y', "10", "20"), "p2": ("two\nlines", "1", "2"), "p3": ("j", "10", "20")}
    (tmp_path / "c.csv").write_text("J,J\n1,2\n")
    with pytest.raises(DataValidationError, match="more than once"):
        csvsrc.read_returns_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")])


def test_row_digest_counts_repetitions(spark):
    digest = lambda *v: csvsrc.row_digest(spark.createDataFrame([(x,) for x in v], "a int")).first()["digest"]
    assert digest(1, 1) != digest(7, 7) and digest(1, 2) == digest(2, 1)


def test_repeated_key_fails_the_method(spark, frame_0001):
    from tallyscope.operators.spatial import moran

    with pytest.raises(ValueError, match="more than one row"):
        moran(frame_0001.union(frame_0001.limit(1)), "Candidate_Share__candidate_a")


def test_workflow_validates_rows_once(spark):
    """The analysed rows and the report read rows that were validated once."""
    ing = typed_ingestion(spark, SF0001)
    run = run_workflow(ing, candidate_key="candidate_a", methods=["turnout_share"])
    assert ing.validated.is_cached and run.metadata["input_rows"] == ing.validated.count()
