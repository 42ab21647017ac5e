"""Library entry points: process_file, validate/analyze, explanation, seeded sample."""

from conftest import SF0001
from tallyscope.plans import service
from tallyscope.plans.prepare import typed_ingestion
from tallyscope.plans.workflow import run_workflow
from tallyscope.schema import ForestParams, Settings

HEADER = "Jurisdiction,Precinct,Registered_Voters,Ballots_Cast,Valid_Contest_Votes,Votes_Candidate_A,Votes_Candidate_B\n"


def test_validate_and_process(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(HEADER + "J,P1,100,90,80,40,40\nJ,P2,100,90,80,30,50\n")
    res = service.validate_returns(spark, str(good), preview_rows=5)
    assert res["status"] == "valid" and res["accepted_preview"].count() == 2
    bad = tmp_path / "bad.csv"
    bad.write_text(HEADER + "J,P1,100,90,80,40,40\nJ,P1,100,90,80,30,50\n")
    assert service.validate_returns(spark, str(bad))["status"] == "valid_with_exclusions"
    dup = tmp_path / "dup.csv"
    dup.write_text("a,a\n1,2\n")
    assert service.validate_returns(spark, str(dup))["status"] == "invalid"
    accepted, summary = service.process_file(spark, str(good))
    assert accepted.count() == 2 and summary["total_precincts"] == 2 and summary["ballots_cast"] == 180.0


def test_explain_and_sample(spark):
    ing = typed_ingestion(spark, SF0001)
    run = run_workflow(ing, candidate_key="candidate_a", methods=["isolation_forest"],
                       settings=Settings(forest=ForestParams(n_estimators=30)))
    out = service.explain_predictions(run)
    assert out["isolation_forest_status"] == "successful"
    assert out["isolation_forest_importance"].count() == len(run.metadata["features"])
    s1 = [r[0] for r in service.seeded_sample(ing.accepted, 10).select("Precinct_ID").collect()]
    s2 = [r[0] for r in service.seeded_sample(ing.accepted, 10).select("Precinct_ID").collect()]
    assert s1 == s2 and len(s1) == 10


def test_missing_path_and_predict(spark, tmp_path):
    import pytest

    from tallyscope.operators import features, iforest
    from tallyscope.plans.prepare import analysis_frame

    with pytest.raises(FileNotFoundError):
        service.validate_returns(spark, str(tmp_path / "nope.csv"))
    frame = analysis_frame(spark, SF0001)
    feats, names = features.create_features(frame)
    model = features.fit(feats, names)
    scaled = features.transform(feats, model, keep=["Precinct_ID"]).select("Precinct_ID", "features")
    forest = iforest.fit_forest(scaled, model.features, ForestParams(n_estimators=20))
    new = analysis_frame(spark, SF0001, by_type=True)
    out = service.predict_anomalies(new, model, forest)
    assert out.filter("IF_Anomaly_Score IS NULL").count() == 0 and out.count() == new.count()
