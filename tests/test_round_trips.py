"""Bundle and forest round trips, the table of file issues, payload sources, scoring with repeated keys."""

import io
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tallyscope.operators import iforest
from tallyscope.operators.ingest import DataValidationError
from tallyscope.plans import service
from tallyscope.plans.prepare import raw_ingestion
from tallyscope.plans.workflow import run_workflow
from tallyscope.schema import DbscanParams, ForestParams, Settings
from tallyscope.sources import csv as csvsrc
from tallyscope.sources.export import read_bundle, write_bundle

HEADER = "Jurisdiction,Precinct,Registered_Voters,Ballots_Cast,Valid_Contest_Votes,Votes_Candidate_A,Votes_Candidate_B\n"
ROWS = "J,P1,100,90,80,40,40\nJ,P2,100,90,80,30,50\n"


def test_bundle_tables_come_back_with_their_types(spark, tmp_path):
    ing = raw_ingestion(spark, SF0001)
    run = run_workflow(ing, candidate_key="candidate_a", methods=["turnout_share", "digit_diagnostics"])
    path = str(tmp_path / "bundle")
    write_bundle(ing, run, path)
    tables = read_bundle(spark, path)
    for name, df in (("analysis_results", run.data), ("excluded_records", ing.excluded), ("validation_issues", ing.issues)):
        assert tables[name].schema.simpleString() == df.schema.simpleString()
        assert csvsrc.row_digest(tables[name]).first() == csvsrc.row_digest(df).first()
    with pytest.raises(ValueError, match="no bundle"):
        read_bundle(spark, str(tmp_path))


def test_forest_tables_are_checked(spark, tmp_path):
    rows = [(f"p{i:03d}", [float(i % 7), float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "Precinct_ID string, features array<double>")
    forest = iforest.fit_forest(df, ["a", "b"], ForestParams(n_estimators=5))
    path = str(tmp_path / "forest")
    iforest.save_forest(forest, path, "{}")
    loaded, _ = iforest.load_forest(path)
    scores = [{r[0]: r["IF_Raw_Score"] for r in iforest.score(df, f).collect()} for f in (forest, loaded)]
    assert scores[0] == scores[1]
    spark.read.parquet(f"{path}/nodes").withColumn("kind", F.lit("other")).write.parquet(str(tmp_path / "other/nodes"))
    spark.read.json(f"{path}/meta").write.json(str(tmp_path / "other/meta"))
    with pytest.raises(ValueError, match="not the tables"):
        iforest.load_forest(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="not fitted"):
        iforest.save_forest(iforest.Forest(forest.nodes, 5, ["a", "b"], forest.params), path, "{}")


def test_every_bad_file_is_listed(spark, tmp_path):
    files = {
        "good.csv": HEADER + ROWS, "good2.csv": HEADER + '"J, two",P1,1,1,1,1,0\n', "empty.csv": "", "head.csv": HEADER, "twice.csv": "Precinct,Precinct\n1,2\n",
        "long.csv": HEADER + "J,P1,100,90,80,40,40,9\nJ,P2,100,90,80,30,50\n", "lacks.csv": "Jurisdiction,Precinct\nJ,P\n", "big.csv": HEADER + ROWS * 40,
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in files]
    required = ["Jurisdiction", "Valid_Contest_Votes"]
    frame, encodings, issues = csvsrc.read_good_files(spark, paths, max_bytes=500, required=required)
    got = sorted((os.path.basename(r["path"]), r["code"]) for r in issues.collect())
    assert got == [("big.csv", "file_too_large"), ("empty.csv", "empty_file"), ("head.csv", "empty_dataset"), ("lacks.csv", "unsupported_column_mapping"), ("long.csv", "malformed_csv"),
                   ("twice.csv", "duplicate_columns"), ("twice.csv", "unsupported_column_mapping")]
    messages = {os.path.basename(r["path"]): r["message"] for r in issues.filter("code <> 'unsupported_column_mapping'").collect()}
    assert messages["long.csv"].startswith("1 rows") and messages["twice.csv"].endswith(": Precinct")
    assert frame.count() == 3 and {os.path.basename(p) for p in encodings} == {"good.csv", "good2.csv"}
    assert csvsrc.read_good_files(spark, [str(tmp_path / "empty.csv")])[0] is None


def test_payloads_are_sources(spark):
    text = HEADER + ROWS.replace("P1", "Pé1")
    for source in (text.encode(), text.encode("cp1252"), io.StringIO(text), io.BytesIO(text.encode())):
        res = service.validate_returns(spark, source)
        assert res["status"] == "valid" and res["validation"]["accepted_rows"] == 2
        assert "J::Pé1" in {r["Precinct_ID"] for r in res["accepted_preview"].collect()}
    assert service.validate_returns(spark, b"  ")["status"] == "invalid"
    with pytest.raises(DataValidationError, match="limit"):
        csvsrc.stored_text(spark, text.encode(), max_bytes=10)


def test_validation_lists_issues_with_row_key_and_column(spark):
    res = service.validate_returns(spark, (HEADER + ROWS + "J,P3,100,90,80,x,1\n").encode())
    listed = [(r["Precinct_ID"], r["code"], r["column"], r["row"] is not None) for r in res["issues"].collect()]
    assert listed == [("J::P3", "missing_critical_count", "Votes_Candidate_A", True), ("J::P3", "nonnumeric_count", "Votes_Candidate_A", True)]
    assert res["provenance"].count() == 1


def test_scoring_neither_multiplies_rows_nor_loses_a_method(spark, frame_0001):
    from tallyscope.operators import features

    frame, names = features.create_features(frame_0001)
    model = features.fit(frame, names)
    scaled = features.transform(frame, model, keep=["Precinct_ID"]).select("Precinct_ID", "features")
    forest = iforest.fit_forest(scaled, model.features, ForestParams(n_estimators=5))
    out = service.predict_anomalies(frame_0001, model, forest, Settings(dbscan=DbscanParams(enabled=True, eps=1e-9, min_samples=50)))
    assert out.count() == frame_0001.count() and out.filter("DBSCAN_Cluster IS NULL AND DBSCAN_Noise_Flag IS NULL").count() == frame_0001.count()
    with pytest.raises(ValueError, match="not unique"):
        service.predict_anomalies(frame_0001.union(frame_0001.limit(1)), model, forest).count()


def test_importance_permutes_over_the_whole_table(spark, frame_0001):
    """Against numpy with the same images; largest first."""
    import numpy as np

    from tallyscope.functions.permute import images, key_arrays
    from tallyscope.operators import features

    frame, names = features.create_features(frame_0001)
    model = features.fit(frame, names)
    scaled = features.transform(frame, model, keep=["Precinct_ID"]).select("Precinct_ID", "features").persist()
    forest = iforest.fit_forest(scaled, model.features, ForestParams(n_estimators=10))
    x = np.array([r["features"] for r in scaled.orderBy("Precinct_ID").collect()])
    at = images(np.arange(len(x)), *key_arrays(42, 0, x.shape[1], len(x)), len(x))
    base, want = forest.raw(x), {}
    for j, name in enumerate(model.features):
        changed = x.copy()
        changed[:, j] = x[at[:, j], j]
        want[name] = np.abs(forest.raw(changed) - base).mean()
    got = [(r["feature"], r["importance"]) for r in iforest.feature_importance(scaled, forest).collect()]
    assert dict(got) == pytest.approx(want) and [v for _, v in got] == sorted((v for _, v in got), reverse=True)


def test_digests_in_ranges_equal_whole_files(spark, tmp_path, monkeypatch):
    import hashlib
    import os

    from tallyscope.sources import ranges

    contents = {"empty": b"", "one": b"x", "odd name %20 é#.bin": os.urandom(70_001), "long": os.urandom(ranges.RANGE_BYTES * 2 + 5)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in contents.items() if content}
    for cell in (0, 100, ranges.CELL_BYTES):
        got = {os.path.basename(r["path"]): (r["length"], r["sha256"]) for r in ranges.file_digests(spark, str(tmp_path), cell).collect()}
        assert got == want, cell
    assert [len(p) for p in ranges.read_ranges(f"file:{tmp_path}/long")] == [ranges.RANGE_BYTES, ranges.RANGE_BYTES, 5]
    # a file system that tasks can't open: whole cells, none beyond the largest one
    monkeypatch.setattr(ranges, "SCHEMES", {"s3": "s3"})
    monkeypatch.setattr(ranges, "MOST_CELL_BYTES", 70_000)
    got = {os.path.basename(r["path"]): (r["length"], r["sha256"]) for r in ranges.file_digests(spark, str(tmp_path), 0).collect()}
    assert got == {name: (n, sha if n <= 70_000 else None) for name, (n, sha) in want.items()}
