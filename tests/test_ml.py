"""Features, isolation forest and DBSCAN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.functions import quantile
from tallyscope.operators import dbscan, features, iforest
from tallyscope.operators.common import AnalysisUnavailable
from tallyscope.schema import DbscanParams, ForestParams


@pytest.fixture(scope="module")
def fitted(frame_0001):
    frame, names = features.create_features(frame_0001)
    frame = frame.persist()
    model = features.fit(frame, names)
    scaled = features.transform(frame, model, keep=["Precinct_ID"]).select("Precinct_ID", "features").persist()
    forest = iforest.fit_forest(scaled, model.features, ForestParams(n_estimators=50))
    return frame, names, model, scaled, forest


def test_feature_allow_list(frame_0001):
    noisy = frame_0001.withColumn("Turnout_Share_Flag", F.lit(True)).withColumn("Source_Note", F.lit("text"))
    _frame, names = features.create_features(noisy)
    assert not any("Flag" in n or "Note" in n for n in names)
    assert names[0] == "turnout_fraction" and "distance_from_jurisdiction_centroid" in names


def test_forest_scores_in_unit_interval_and_deterministic(fitted):
    _f, _n, model, scaled, forest = fitted
    a = iforest.score(scaled, forest).collect()
    again = iforest.fit_forest(scaled, model.features, ForestParams(n_estimators=50))
    b = {r["Precinct_ID"]: r["IF_Anomaly_Score"] for r in iforest.score(scaled, again).collect()}
    assert all(0.0 <= r["IF_Anomaly_Score"] <= 1.0 for r in a)
    assert max(r["IF_Anomaly_Score"] for r in a) == pytest.approx(1.0)
    assert all(abs(b[r["Precinct_ID"]] - r["IF_Anomaly_Score"]) < 1e-12 for r in a)


def test_forest_isolates_an_outlier(spark):
    rows = [(f"p{i:03d}", [float(i % 7) / 7, float(i % 5) / 5]) for i in range(200)] + [("out", [40.0, -40.0])]
    df = spark.createDataFrame(rows, "Precinct_ID string, features array<double>")
    forest = iforest.fit_forest(df, ["a", "b"], ForestParams(n_estimators=100))
    scores = {r["Precinct_ID"]: r for r in iforest.score(df, forest).collect()}
    assert scores["out"]["IF_Anomaly_Flag"] and scores["out"]["IF_Anomaly_Score"] == pytest.approx(1.0)


def test_importance_ranks_features(fitted):
    _f, _n, model, scaled, forest = fitted
    imp = iforest.feature_importance(scaled, forest).collect()
    assert len(imp) == len(model.features) and all(r["importance"] >= 0 for r in imp)


def test_save_and_load_forest(fitted, tmp_path):
    _f, _n, model, scaled, forest = fitted
    path = str(tmp_path / "model")
    iforest.save_forest(forest, path, model.to_json())
    loaded, fm = iforest.load_forest(path)
    assert features.FeatureModel.from_json(fm).features == model.features
    a = {r[0]: r[1] for r in iforest.score(scaled, forest).select("Precinct_ID", "IF_Raw_Score").collect()}
    b = {r[0]: r[1] for r in iforest.score(scaled, loaded).select("Precinct_ID", "IF_Raw_Score").collect()}
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_transform_needs_fitted_features(fitted, spark):
    _f, _n, model, _s, _forest = fitted
    with pytest.raises(ValueError, match="lacks"):
        features.transform(spark.createDataFrame([("x",)], "Precinct_ID string"), model)


def test_dbscan_two_blobs(spark):
    rows = [(f"a{i}", [0.0 + i * 0.01, 0.0]) for i in range(10)] + [(f"b{i}", [3.0 + i * 0.01, 3.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "Precinct_ID string, features array<double>")
    res = dbscan.dbscan(df, DbscanParams(enabled=True, eps=0.2, min_samples=3))
    labels = {r[0]: r[1] for r in res.data.select("Precinct_ID", "DBSCAN_Cluster").collect()}
    assert {labels[f"a{i}"] for i in range(10)} == {0} and {labels[f"b{i}"] for i in range(10)} == {1}
    assert res.diagnostics["n_clusters"] == 2 and res.diagnostics["n_noise"] == 0


def test_dbscan_all_noise_is_unavailable(spark):
    rows = [(f"p{i}", [float(i) * 10, 0.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "Precinct_ID string, features array<double>")
    with pytest.raises(AnalysisUnavailable):
        dbscan.dbscan(df, DbscanParams(enabled=True, eps=0.5, min_samples=2))


def test_dbscan_hot_point(spark):
    """A third of all rows on one point: one weighted point, same clusters."""
    rows = [(f"h{i:04d}", [0.0, 0.0]) for i in range(300)] + [(f"a{i:04d}", [0.05 * i, 1.0]) for i in range(300)] + [(f"n{i:04d}", [10.0 * i, -50.0]) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "Precinct_ID string, features array<double>")
    res = dbscan.dbscan(df, DbscanParams(enabled=True, eps=0.2, min_samples=5))
    got = {r["Precinct_ID"]: r["DBSCAN_Cluster"] for r in res.data.collect()}
    assert {got[f"h{i:04d}"] for i in range(300)} == {1} and {got[f"a{i:04d}"] for i in range(300)} == {0}
    assert {got[f"n{i:04d}"] for i in range(1, 301)} == {-1} and res.diagnostics["n_clusters"] == 2


def test_exchanged_features_change_scores_as_when_scored_anew():
    import numpy as np
    import pandas as pd

    from tallyscope.operators.iforest import Forest, grow_tree
    from tallyscope.schema import ForestParams

    rng = np.random.default_rng(4)
    grown = [(t, *node) for t in range(12) for node in grow_tree(rng.normal(size=(40, 5)).round(1), 6, 7, t)]
    forest = Forest(pd.DataFrame(grown, columns=["tree", "node", "feature", "threshold", "left", "right", "value"]), 40, list("abcde"), ForestParams())
    x, other = rng.normal(size=(2, 90, 5)).round(1)
    expected = []
    for j in range(5):
        changed = x.copy()
        changed[:, j] = other[:, j]
        expected.append(np.abs(forest.raw(changed) - forest.raw(x)).sum())
    assert np.allclose(forest.exchanged_change(x, other), expected, rtol=1e-12)
    assert (forest.exchanged_change(x, x) == 0).all()


def test_fit_finds_medians_and_quartiles_in_one_search(spark, monkeypatch):
    """Few or many NULLs, odd and even counts, ties; against numpy on the filled columns."""
    rng = np.random.default_rng(8)
    columns = {"a": rng.normal(size=101), "b": rng.integers(0, 4, 101).astype(float), "c": rng.exponential(size=101), "d": rng.normal(size=101)}
    empty = {"a": 0, "b": 30, "c": 70, "d": 1}
    rows = [tuple(None if i < empty[k] else float(columns[k][i]) for k in columns) for i in range(101)]
    frame = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in columns)).repartition(3)
    searches, settle = [], quantile._settle
    monkeypatch.setattr(quantile, "_settle", lambda *args: searches.append(1) or settle(*args))
    model = features.fit(frame, list(columns))
    assert len(searches) == 1
    for k, x in columns.items():
        median = float(np.median(x[empty[k] :]))
        filled = np.r_[x[empty[k] :], [median] * empty[k]]
        low, middle, high = (float(np.quantile(filled, q)) for q in (0.25, 0.5, 0.75))
        assert (model.medians[k], model.centers[k]) == pytest.approx((median, middle))
        assert model.scales[k] == pytest.approx(high - low if high != low else 1.0)
