"""Known values and invariances of the statistical methods."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tallyscope.functions.adjust import benjamini_hochberg, holm, holm_values
from tallyscope.functions.special import chi2_sf, t_ppf
from tallyscope.operators import digits, downballot, spatial, trend, turnout
from tallyscope.operators.common import AnalysisUnavailable
from tallyscope.schema import DigitParams, DownBallotPair, SpatialParams, TurnoutShareParams

SHARE_A = "Candidate_Share__candidate_a"


def test_special_functions():
    assert abs(t_ppf(0.975, 98) - 1.9844674545084802) < 1e-12
    assert abs(chi2_sf(16.9, 9) - 0.050305190124310784) < 1e-14


def test_holm_and_bh_known_values(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    h = {r["k"]: r["h"] for r in holm(df, "p", "h").collect()}
    b = {r["k"]: r["b"] for r in benjamini_hochberg(df, "p", "b").collect()}
    assert [round(h[k], 10) for k in "abc"] == [0.03, 0.06, 0.06]
    assert [round(b[k], 10) for k in "abc"] == [0.03, 0.04, 0.04]
    assert [round(v, 10) for v in holm_values([0.01, 0.04, 0.03])] == [0.03, 0.06, 0.06]
    with pytest.raises(ValueError):
        holm(spark.createDataFrame([("a", 1.5)], "k string, p double"), "p", "h")


def test_turnout_share_fixture_values(frame_0001):
    res = turnout.turnout_share(frame_0001, SHARE_A)
    m = res.diagnostics
    assert abs(m["baseline_turnout_upper_limit"] - 80.352599) < 1e-6
    assert m["baseline_observations"] == 135
    agg = res.data.agg(F.count_if("Turnout_Share_Flag"), F.count_if("Turnout_Share_High_Leverage"),
                       F.sum(F.pow("Turnout_Share_Residual", 2)), F.max(F.abs("Turnout_Share_Studentized_Residual"))).first()
    assert agg[0] == 0 and agg[1] == 26
    assert abs(agg[2] - 2.07437911) < 1e-7 and abs(agg[3] - 2.93779080) < 1e-7


def test_turnout_share_order_invariance(frame_0001):
    a = turnout.turnout_share(frame_0001.repartition(1), SHARE_A).data
    b = turnout.turnout_share(frame_0001.repartition(7, "Precinct"), SHARE_A).data
    cols = ["Precinct_ID", "Turnout_Share_Residual"]
    ra = {r[0]: r[1] for r in a.select(*cols).collect()}
    rb = {r[0]: r[1] for r in b.select(*cols).collect()}
    assert ra.keys() == rb.keys() and all(abs(ra[k] - rb[k]) < 1e-9 for k in ra)


def test_turnout_share_preconditions(spark, frame_0001):
    with pytest.raises(AnalysisUnavailable):
        turnout.turnout_share(frame_0001.limit(5), SHARE_A)
    with pytest.raises(AnalysisUnavailable):
        turnout.turnout_share(frame_0001, "Votes_Candidate_A")
    with pytest.raises(ValueError):
        turnout.turnout_share(frame_0001, SHARE_A, TurnoutShareParams(baseline_turnout_quantile=0.2))
    const = frame_0001.withColumn("Calculated_Turnout_Percent", F.lit(50.0))
    with pytest.raises(AnalysisUnavailable, match="vary"):
        turnout.turnout_share(const, SHARE_A)


def test_candidate_swap_symmetry(frame_0001):
    swapped = frame_0001.withColumn("Candidate_Share__candidate_b", F.col(SHARE_A))
    a = turnout.turnout_share(frame_0001, SHARE_A).diagnostics
    b = turnout.turnout_share(swapped, "Candidate_Share__candidate_b").diagnostics
    assert a["coefficients"] == pytest.approx(b["coefficients"])


def test_vote_share_trend_fixture(frame_0001):
    m = trend.vote_share_trend(frame_0001, SHARE_A, "Votes_Candidate_A").diagnostics
    assert abs(m["slope_share_per_100_votes"] - 0.0723996) < 1e-6
    assert abs(m["r_squared"] - 0.4054917) < 1e-6
    assert 0 <= m["slope_p_value"] < 1e-10


def test_down_ballot_known_values(spark):
    df = spark.createDataFrame([("a", 100.0, 95.0), ("b", 95.0, 100.0), ("c", 0.0, 1.0)], "Precinct_ID string, President double, Senate double")
    res = downballot.down_ballot_difference(df, "President", [DownBallotPair("x", "Senate", "S", "senate")])
    got = {r[0]: r[1] for r in res.data.select("Precinct_ID", "Down_Ballot_Difference_Percent__senate").collect()}
    assert got["a"] == pytest.approx(5.0) and got["b"] == pytest.approx(-5.2631579) and got["c"] is None
    comp = res.diagnostics["comparisons"][0]
    assert comp["valid_observations"] == 2 and comp["negative_difference_precincts"] == 1


def test_down_ballot_fixture(frame_0001):
    pair = DownBallotPair("candidate_a", "Votes_Down_Ballot_A", "A", "a")
    comp = downballot.down_ballot_difference(frame_0001, "Votes_Candidate_A", [pair]).diagnostics["comparisons"][0]
    assert (comp["valid_observations"], comp["aggregate_difference_votes"], comp["negative_difference_precincts"]) == (149, 806, 22)


def test_digits_detect_round_numbers(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10, 1001, 10)], "Votes double")
    res = digits.digit_diagnostics(df, ["Votes"])
    t = res.diagnostics["tests"][0]
    assert t["status"] == "successful" and t["significant"]
    assert res.data.filter(~F.col("Round_Number_Multiple_10__Votes")).count() == 0


def test_benford_branches(spark):
    df = spark.createDataFrame([(float(v),) for v in list(range(100, 1000)) * 2], "Votes double")
    res = digits.digit_diagnostics(df, ["Votes"], DigitParams(benford_enabled=True))
    benford = [t for t in res.diagnostics["tests"] if t["test"] == "benford_first_digit"][0]
    assert benford["status"] == "unavailable"  # spans less than two orders of magnitude
    df2 = spark.createDataFrame([(float(v),) for v in range(1, 2000)], "Votes double")
    res2 = digits.digit_diagnostics(df2, ["Votes"], DigitParams(benford_enabled=True))
    assert [t for t in res2.diagnostics["tests"] if t["test"] == "benford_first_digit"][0]["status"] == "successful"


def test_last_digit_counts_fixture(frame_0001):
    t = digits.last_digit_table(frame_0001, ["Votes_Candidate_A"])
    got = [r["n"] for r in t.orderBy("digit").collect()]
    assert got == [19, 17, 13, 16, 18, 9, 14, 14, 16, 14]
    stat = digits.digit_diagnostics(frame_0001, ["Votes_Candidate_A"]).diagnostics["tests"][0]["statistic"]
    assert abs(stat - 4.93333333) < 1e-7


def test_moran_fixture_values(frame_0001):
    res = spatial.moran(frame_0001, SHARE_A)
    m = res.diagnostics
    assert abs(m["global_moran_i"] - 0.0340556821) < 1e-9
    assert m["global_permutation_p"] == pytest.approx(0.388, abs=0.05)  # another random order than the known value's
    loc = res.tables["local"]
    s = loc.agg(F.sum("Local_Moran_Raw_P"), F.count_if("Spatial_Significant")).first()
    assert abs(s[0] - 70.396) < 2 and s[1] == 0
    q = {r[0]: r[1] for r in loc.groupBy("Spatial_Pattern").count().collect()}
    assert q == {"high-high cluster": 41, "low-low cluster": 41, "high-low spatial outlier": 34, "low-high spatial outlier": 34}


def test_knn_matches_brute_force(spark):
    import random

    rnd = random.Random(3)
    pts = [(f"p{i:03d}", rnd.random(), rnd.random()) for i in range(60)]
    pts += [("d1", 0.5, 0.5), ("d2", 0.5, 0.5), ("d3", 0.5, 0.5)]  # duplicate location
    nodes = spark.createDataFrame(pts, "id string, x double, y double")
    got = {}
    for r in spatial.knn_edges(nodes, 4).collect():
        got.setdefault(r["src"], []).append(r["dst"])
    for pid, x, y in pts:
        want = sorted(((math.hypot(x - a, y - b), q) for q, a, b in pts if q != pid))[:4]
        assert sorted(got[pid]) == sorted(q for _, q in want)


def test_polygon_contiguity_grid(spark):
    sq = lambda x, y: [(float(x), float(y)), (x + 1.0, float(y)), (x + 1.0, y + 1.0), (float(x), y + 1.0), (float(x), float(y))]
    rows = [(f"c{x}{y}", [{"x": a, "y": b} for a, b in sq(x, y)]) for x in range(5) for y in range(5)]
    polys = spark.createDataFrame(rows, "Precinct_ID string, Geometry array<struct<x:double,y:double>>")
    assert spatial.polygon_edges(polys, "rook").count() == 80
    assert spatial.polygon_edges(polys, "queen").count() == 144


def test_polygon_hub_vertex(spark, monkeypatch):
    # a fan of triangles around one vertex holds a third of all rings; the others are a strip of squares
    fan = [(f"f{i}", [(0.0, 0.0), (math.cos(i), math.sin(i)), (math.cos(i + 0.4), math.sin(i + 0.4)), (0.0, 0.0)]) for i in range(150)]
    strip = [(f"s{i}", [(i + 5.0, 5.0), (i + 6.0, 5.0), (i + 6.0, 6.0), (i + 5.0, 6.0), (i + 5.0, 5.0)]) for i in range(300)]
    rows = [(n, [{"x": a, "y": b} for a, b in ring]) for n, ring in fan + strip]
    polys = spark.createDataFrame(rows + rows[:3], "Precinct_ID string, Geometry array<struct<x:double,y:double>>")
    want = {(a, b) for a, _ in fan for b, _ in fan if a != b}
    want |= {(f"s{i}", f"s{j}") for i in range(300) for j in (i - 1, i + 1) if 0 <= j < 300}
    assert spatial.MEETING_RINGS < 150
    got = [(r["src"], r["dst"]) for r in spatial.polygon_edges(polys, "queen").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r["src"], r["dst"]) for r in spatial.polygon_edges(polys, "rook").collect()} == {p for p in want if p[0][0] == "s"}
    # however small a group is, the edges are the same
    monkeypatch.setattr(spatial, "MEETING_RINGS", 7)
    assert {(r["src"], r["dst"]) for r in spatial.polygon_edges(polys, "queen").collect()} == want
    assert spatial.polygon_edges(polys.limit(0), "queen").count() == 0


def test_spatial_requires_geometry_for_polygons(frame_0001):
    with pytest.raises(AnalysisUnavailable, match="Geometry"):
        spatial.moran(frame_0001, SHARE_A, SpatialParams(weights_type="queen"))


def test_knn_hot_location_is_exact(spark):
    """A location holding many rows (a skewed key) still gives exact neighbours."""
    import random

    rnd = random.Random(5)
    pts = [(f"h{i:03d}", 0.25, 0.75) for i in range(40)]
    pts += [(f"p{i:03d}", rnd.random(), rnd.random()) for i in range(40)]
    nodes = spark.createDataFrame(pts, "id string, x double, y double")
    k = 4
    got = {}
    for r in spatial.knn_edges(nodes, k).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    for pid, x, y in pts:
        want = {q for _, q in sorted(((math.hypot(x - a, y - b), q) for q, a, b in pts if q != pid))[:k]}
        assert got[pid] == want, pid


def test_duplicate_rule_with_hot_blank_key(spark):
    """Many blank precincts in one jurisdiction collide on one key; all copies are flagged."""
    from tallyscope.operators.ingest import ingest
    from tallyscope.schema import default_schema

    cols = ["Jurisdiction", "Precinct", "Valid_Contest_Votes", "Votes_Candidate_A", "Votes_Candidate_B"]
    rows = [("J", " ", "10", "4", "5")] * 300 + [("J", f"p{i}", "10", "4", "5") for i in range(100)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    issues = ingest(df, default_schema()).issues
    counts = {r[0]: r[1] for r in issues.groupBy("code").count().collect()}
    assert counts["duplicate_precinct_id"] == 300 and counts["missing_identifier"] == 300


def test_adjustments_match_reference_definition(spark):
    """Distributed prefix-scan Holm/BH equal the sort-based definitions, with ties and families."""
    import random

    import numpy as np

    def ref_holm(p):
        p = np.asarray(p)
        o = np.argsort(p, kind="stable")
        adj = np.maximum.accumulate(np.minimum(1, p[o] * np.arange(len(p), 0, -1)))
        out = np.empty_like(adj)
        out[o] = adj
        return out

    def ref_bh(p):
        p = np.asarray(p)
        o = np.argsort(p, kind="stable")
        n = len(p)
        adj = np.minimum.accumulate((p[o] * n / np.arange(1, n + 1))[::-1])[::-1]
        out = np.empty_like(adj)
        out[o] = np.minimum(1, adj)
        return out

    rnd = random.Random(1)
    rows = [(f"k{i}", f"f{i % 3}", round(rnd.random() ** 3, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, fam string, p double")
    for fam in ([], ["fam"]):
        h = {r["k"]: r["h"] for r in holm(df, "p", "h", family=fam).collect()}
        b = {r["k"]: r["b"] for r in benjamini_hochberg(df, "p", "b", family=fam).collect()}
        groups = {}
        for k, f, p in rows:
            groups.setdefault(f if fam else "", []).append((k, p))
        for items in groups.values():
            ks, ps = [k for k, _ in items], [p for _, p in items]
            assert all(abs(h[k] - v) < 1e-12 for k, v in zip(ks, ref_holm(ps), strict=True))
            assert all(abs(b[k] - v) < 1e-12 for k, v in zip(ks, ref_bh(ps), strict=True))


def test_quantile_with_ties_collects_few_rows(spark, monkeypatch):
    """A third of all rows on the median: the tied value is found without collecting its rows."""
    from tallyscope.functions import quantile

    values = [0.0] * 4000 + [float(i % 997) - 400 for i in range(8000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4).persist()
    monkeypatch.setattr(quantile, "FEW", 16)
    settled = []
    real = quantile._settle
    monkeypatch.setattr(quantile, "_settle", lambda d, names, ranks: (settled.extend(r.inside for r in ranks), real(d, names, ranks)))
    qs = [0.0, 0.1, 0.43, 0.5, 0.9, 1.0]
    got = quantile.exact_quantiles(df, {"v": qs})
    assert [got[("v", q)] for q in qs] == pytest.approx([float(np.quantile(values, q)) for q in qs])
    assert all(n <= 16 for n in settled)


def test_knn_follows_the_density(spark):
    """Half of the points in one small area, the rest spread wide, a few very far: exact, and few pairs are compared."""
    rng = np.random.default_rng(12)
    city = rng.normal(0, 1e-4, (600, 2))
    land = rng.uniform(-50, 50, (600, 2))
    far = np.array([[1e4, 1e4], [-1e4, 5.0]])
    xy = np.vstack([city, land, far])
    k = 5
    nodes = spark.createDataFrame([(f"p{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(xy)], "id string, x double, y double")
    pairs: list[int] = []
    got: dict[str, list] = {}
    for r in spatial.knn_edges(nodes, k, candidates=pairs).collect():
        got.setdefault(r["src"], []).append((r["dist"], r["dst"]))
    dist = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1))
    for i in range(len(xy)):
        near = sorted((float(dist[i, j]), f"p{j:05d}") for j in range(len(xy)) if j != i)[:k]
        assert [d for _, d in sorted(got[f"p{i:05d}"])] == [d for _, d in near]
    assert sum(pairs) < 40 * len(xy) * k


def test_knn_candidates_are_ranked_by_tasks_of_few_points(spark, monkeypatch):
    """The number of tasks follows the points; one that adaptive execution gathers by bytes ranks them all."""
    monkeypatch.setattr(spatial, "POINTS_PER_TASK", 20, raising=False)
    dealt, frame = [], type(spark.range(0))
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: dealt.append(n) or repartition(self, n, *cols))
    rng = random.Random(2)
    rows = [(f"{i:03d}", rng.random(), rng.random()) for i in range(400)]
    got = spatial.knn_edges(spark.createDataFrame(rows, "id string, x double, y double"), 2).groupBy("src").agg(F.sort_array(F.collect_list("dst"))).collect()
    assert dealt and min(dealt) >= 400 // 20
    for src, found in got:
        _, x, y = rows[int(src)]
        near = sorted((math.hypot(x - a, y - b), i) for i, a, b in rows if i != src)[:2]
        assert found == sorted(i for _, i in near)
    assert len(got) == len(rows)


def test_moran_goes_by_number(spark, monkeypatch):
    """Neighbours are sought by number, ties as by key; the weights come back by key."""
    rng = random.Random(4)
    # on a lattice, so that many distances tie, and with keys in another order than their numbers
    rows = [(f"p{i}", float(i % 9), float(i // 9), rng.random()) for i in range(80)]
    frame = spark.createDataFrame(rows, "Precinct_ID string, Longitude double, Latitude double, v double")
    kinds, sought = [], spatial.knn_edges
    monkeypatch.setattr(spatial, "knn_edges", lambda nodes, k: kinds.append(dict(nodes.dtypes)["id"]) or sought(nodes, k))
    res = spatial.moran(frame, "v", SpatialParams(knn_neighbors=3, permutations=19))
    assert kinds == ["bigint"]
    near = {a: [r[0] for r in sorted(rows, key=lambda r: (math.hypot(x - r[1], y - r[2]), r[0])) if r[0] != a][:3] for a, x, y, _ in rows}
    assert {(r["src"], r["dst"], r["w"]) for r in res.tables["weights"].collect()} == {(a, b, 1 / 3) for a, some in near.items() for b in some}
    mean = sum(r[3] for r in rows) / len(rows)
    z = {r[0]: r[3] - mean for r in rows}
    power = sum(v * v for v in z.values()) / len(rows)
    local = {r["Precinct_ID"]: r["Local_Moran_I"] for r in res.data.collect()}
    assert local == pytest.approx({a: z[a] * sum(z[b] for b in some) / 3 / power for a, some in near.items()})
