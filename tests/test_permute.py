"""Keyed bijections, Moran counts of both plans, and radix quantiles."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.functions import permute, quantile
from tallyscope.operators import spatial


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_images_are_permutations_and_invert(n):
    pair, offset = permute.key_arrays(7, 0, 40, n)
    got = permute.images(np.arange(n), pair, offset, n)
    assert (np.sort(got, 0) == np.arange(n)[:, None]).all()
    for p in (0, 39):
        back = permute.images(got[:, p], pair[:, p : p + 1], offset[:, p : p + 1], n, inverse=True)
        assert (back[:, 0] == np.arange(n)).all()


def _image(x, keys, n):
    """The definition, in integers without limit."""
    for k, c in keys:
        other = (k - x) % n
        h = ((max(x, other) + c) & permute.LOW) * permute.FIRST & permute.WORD
        h = ((h ^ h >> 16) & permute.LOW) * permute.SECOND & permute.WORD
        x = other if h >> 17 & 1 else x
    return x


def test_images_take_words_of_32_bits():
    rng = np.random.default_rng(1)
    for n in (1, 2, 97, 900_000, (1 << 31) - 1, 1 << 31, (1 << 31) + 5, 1 << 40):
        x = np.unique(np.r_[0, n - 1, rng.integers(0, n, 50)])
        pair, offset = permute.key_arrays(11, 0, 3, n)
        got = permute.images(x, pair, offset, n)
        for p in range(3):
            keys = list(zip(*permute.keys(11, p, n)))
            assert got[:, p].tolist() == [_image(v, keys, n) for v in x.tolist()]
            assert (permute.images(got[:, p], pair[:, p : p + 1], offset[:, p : p + 1], n, inverse=True)[:, 0] == x).all()
    pair, offset = permute.key_arrays(11, 0, 64, 900_000)
    tracemalloc.start()
    permute.images(np.arange(1024), pair, offset, 900_000)
    assert tracemalloc.get_traced_memory()[1] < 28 * 1024 * 64
    tracemalloc.stop()


def test_images_are_uniform():
    """Every place is about equally likely for one index, for neighbours jointly, and differs between keys."""
    n, turns = 12, 6000
    pair, offset = permute.key_arrays(3, 0, turns, n)
    got = permute.images(np.arange(n), pair, offset, n)
    for i in (0, 5, 11):
        seen = np.bincount(got[i], minlength=n)
        assert ((seen - turns / n) ** 2 / (turns / n)).sum() < 40
    joint = np.bincount(got[4] * n + got[5], minlength=n * n).reshape(n, n)
    assert (joint.diagonal() == 0).all()
    expected = turns / (n * (n - 1))
    rest = joint[~np.eye(n, dtype=bool)]
    assert ((rest - expected) ** 2 / expected).sum() < 131 + 5 * math.sqrt(2 * 131)


def test_expression_equals_numpy(spark):
    n = 1234
    pair, offset = permute.key_arrays(42, 0, 3, n)
    rows = spark.range(n)
    got = rows.select("id", *[permute.image(F.col("id"), permute.rounds_literal(42, p, n), n).alias(f"x{p}") for p in range(3)],
                      permute.image(permute.image(F.col("id"), permute.rounds_literal(42, 0, n), n), permute.rounds_literal(42, 0, n, inverse=True), n).alias("back")).orderBy("id").collect()
    want = permute.images(np.arange(n), pair, offset, n)
    assert [[r["x0"], r["x1"], r["x2"]] for r in got] == want.tolist() and all(r["back"] == r["id"] for r in got)


def moran_case(spark, n, hub):
    """A ring of nodes, and a hub that is everyone's neighbour."""
    rng = np.random.default_rng(n)
    z = rng.normal(size=n)
    z -= z.mean()
    links = [(i, (i + d) % n) for i in range(n) for d in (1, 2)] + ([(0, j) for j in range(3, n)] if hub else [])
    links = sorted({(a, b) for a, b in links if a != b and a != n - 1})  # the last node has no neighbour
    degree = np.bincount([a for a, _ in links], minlength=n)
    w = np.zeros((n, n))
    for a, b in links:
        w[a, b] = 1 / degree[a]
    local = z * (w @ z) / ((z @ z) / n)
    nodes = spark.createDataFrame([(f"n{i}", i, float(z[i]), float(local[i])) for i in range(n)], "id string, idx bigint, z double, local_i double").repartition(3)
    edges = spark.createDataFrame([(a, b, float(w[a, b])) for a, b in links], "src bigint, dst bigint, w double").repartition(3)
    return z, w, local, nodes, edges


@pytest.mark.parametrize("limit", [0, 1 << 21])
def test_counts_equal_numpy_for_both_plans(spark, monkeypatch, limit):
    n, turns = 40, 130
    for name, value in (("BROADCAST_NODES", limit), ("EDGE_BLOCK", 7), ("HUB_NEIGHBOURS", 10)):
        monkeypatch.setattr(spatial, name, value)
    z, w, local, nodes, edges = moran_case(spark, n, hub=True)
    denom = float(z @ z)
    observed = float(z @ w @ z) / denom
    pair, offset = permute.key_arrays(5, 0, turns, n)
    values = z[permute.images(np.arange(n), pair, offset, n)]
    lags = w @ values
    hits = (np.abs(z[:, None] * lags / (denom / n)) >= np.abs(local)[:, None] * (1 - spatial.TIE)).sum(1)
    reached = int((np.abs((values * lags).sum(0) / denom) >= abs(observed) * (1 - spatial.TIE)).sum())
    counts, got = spatial.permuted_counts(nodes, edges, n, denom, observed, turns, 5)
    assert got == reached
    assert {r["idx"]: r["cnt"] for r in counts.collect()} == {i: int(hits[i]) for i in range(n - 1)}


def test_quantiles_of_odd_doubles(spark, monkeypatch):
    """Signs, zeros, infinities, tiny and close values, NULLs, whole numbers and an empty column; all four passes."""
    rng = np.random.default_rng(0)
    close = 1.0 + np.arange(300) * 2.0**-52
    x = [*rng.normal(size=500), *(-rng.pareto(1, 200)), *close, *[0.0, -0.0] * 40, 5e-324, -5e-324, 1e308, -1e308]
    rows = [(float(v), i % 50, None) for i, v in enumerate(x)] + [(None, None, None)] * 30
    df = spark.createDataFrame(rows, "`a b` double, k int, none double").repartition(3)
    for few in (4096, 1):
        monkeypatch.setattr(quantile, "FEW", few)
        qs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.99, 1.0]
        got = quantile.exact_quantiles(df, {"a b": qs, "k": qs, "none": [0.5]})
        k = [r[1] for r in rows if r[1] is not None]
        assert [got["a b", q] for q in qs] == pytest.approx([float(np.quantile(x, q)) for q in qs], rel=1e-15)
        assert [got["k", q] for q in qs] == pytest.approx([float(np.quantile(k, q)) for q in qs]) and got["none", 0.5] is None
    assert quantile._double(int(quantile.ordered_bits(np.array([-3.5]))[0])) == -3.5


def test_ends_shared_by_edges_are_permuted_once(monkeypatch):
    seen, images = [], spatial.images
    monkeypatch.setattr(spatial, "images", lambda x, *rest: seen.append(len(x)) or images(x, *rest))
    rng = np.random.default_rng(6)
    n, own = 50, np.arange(20)
    z, dst, first = rng.normal(size=n), rng.integers(0, 25, 160), np.arange(0, 161, 8)
    total = np.zeros(10)
    counts = spatial._reached(z, own, np.full(20, 0.2), dst, np.full(160, 1 / 8), first, 1.0, 3, total)
    assert sum(seen) <= 25
    pair, offset = spatial.key_arrays(3, 0, 10, n)
    lag = z[images(dst, pair, offset, n)].reshape(20, 8, 10).sum(1) / 8
    assert np.allclose(total, (z[images(own, pair, offset, n)] * lag).sum(0))
    assert (counts == (np.abs(z[own, None] * lag) >= 0.2 * (1 - spatial.TIE)).sum(1)).all()
