"""Isolation Forest as Spark jobs.

Published algorithm (Liu, Ting & Zhou 2008): T trees, each grown on a random
sub-sample of psi rows with random feature / random threshold splits up to
height ceil(log2 psi); a row's anomaly score is s = 2 ** (-E[h] / c(psi)), where
h is the path length plus c(leaf size).

Every draw is an integer hash of (seed, tree, row or node), so any engine can rebuild the forest.

Plan:
* sampling - a row-level hash keeps a pool of ~3*psi*T rows (a narrow filter,
  independent of n afterwards); pool rows are exploded over trees and a
  per-(tree, row) hash keeps ~3*psi candidates per tree; the psi smallest hashes
  per tree are kept (``row_number`` inside groups of ~3*psi rows). The result is
  a uniform sample without replacement per tree; a tree that came up short is
  re-drawn with a wider threshold.
* growing - ``groupBy(tree).applyInArrow``: one task per tree, psi rows each. Nodes are numbered
  as in a heap (root 1, children 2k and 2k+1); a node splits on one of the features that vary in
  it, at a point between their smallest and largest value, both drawn by hash.
* scoring - the node table has at most T * (2*psi - 1) rows (102,200 for the
  defaults) whatever the input size, so it is collected and shipped with the
  scoring function; scoring is a narrow ``mapInArrow`` (no shuffle).
* importance - row i gets a feature from row image(i) under a keyed bijection of the whole table
  (``functions.permute``), one shuffle of n values a feature; scoring is narrow again.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.index import consecutive_index
from ..functions.partition import matrix
from ..functions.permute import FIRST, LOW, SECOND, WORD, image, rounds_literal
from ..functions.quantile import exact_quantile
from ..schema import ForestParams
from ..session import ensure_checkpoint_dir, ship_package
from .common import AnalysisUnavailable

#: Rows that walk down a tree together.
SCORED_ROWS = 4096
EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value double"


def average_path(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful binary-search-tree lookup."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def draw_keys(seed: int, purpose: str, tree: int) -> tuple[int, int]:
    """Two 28-bit hash offsets."""
    digits = hashlib.md5(f"{seed}:{purpose}:{tree}".encode()).hexdigest()
    return int(digits[:7], 16), int(digits[7:14], 16)


def draw(x: int, first: int, second: int) -> int:
    """A 32-bit hash of a non-negative integer below 2**60."""
    h = ((x & LOW) + first & LOW) * FIRST & WORD
    h = ((h ^ h >> 16) + second + (x >> 30) & LOW) * SECOND & WORD
    return h ^ h >> 15


def drawn(x: Column, first: Column, second: Column) -> Column:
    """``draw`` as an expression."""
    low, word = F.lit(LOW), F.lit(WORD)
    h = ((x.bitwiseAND(low) + first).bitwiseAND(low) * F.lit(FIRST)).bitwiseAND(word)
    h = ((h.bitwiseXOR(F.shiftright(h, 16)) + second + F.shiftright(x, 30)).bitwiseAND(low) * F.lit(SECOND)).bitwiseAND(word)
    return h.bitwiseXOR(F.shiftright(h, 15))


def row_hash(key: str) -> Column:
    """60 bits of the md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def grow_tree(x: np.ndarray, max_depth: int, seed: int, tree: int) -> list[tuple]:
    """Random isolation tree over rows ``x``; returns node tuples (node, feature, thr, left, right, value)."""
    which, where = draw_keys(seed, "feature", tree), draw_keys(seed, "threshold", tree)
    nodes, stack = [], [(1, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        depth = node.bit_length() - 1
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if len(rows) <= 1 or depth >= max_depth or not len(varying):
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path([len(rows)])[0])))
            continue
        f = int(varying[draw(node, *which) % len(varying)])
        thr = float(lo[f] + draw(node, *where) / 4294967296.0 * (hi[f] - lo[f]))
        if thr >= hi[f]:
            thr = float(lo[f])
        nodes.append((node, f, thr, 2 * node, 2 * node + 1, 0.0))
        go_left = sub[:, f] <= thr
        stack += [(2 * node, rows[go_left]), (2 * node + 1, rows[~go_left])]
    return nodes


class Forest:
    """Fitted forest: node arrays per tree (feature, threshold, children, value, depth); a leaf is its own child."""

    def __init__(self, nodes: pd.DataFrame, psi: int, features: list[str], params: ForestParams):
        self.psi, self.features, self.params = psi, features, params
        self.trees = []
        for _t, g in nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
            # nodes in use numbered from 0 on; the root is the first
            number = {k: i for i, k in enumerate(g["node"].tolist())}
            child = np.array([[number.get(k, i) for k in pair] for i, pair in enumerate(zip(g["left"].tolist(), g["right"].tolist()))], np.int64)
            feature = g["feature"].to_numpy(np.int64)
            leaf = feature < 0
            self.trees.append((np.where(leaf, 0, feature), np.where(leaf, np.inf, g["threshold"].to_numpy(np.float64)), child.ravel(), g["value"].to_numpy(np.float64), int(g["node"].max()).bit_length() - 1))
        self.nodes = nodes
        self.offset = -0.5
        self.score_min: float | None = None
        self.score_max: float | None = None

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), SCORED_ROWS):
            part = np.ascontiguousarray(x[a : a + SCORED_ROWS])
            flat, start = part.ravel(), np.arange(len(part)) * x.shape[1]
            total = np.zeros(len(part))
            for feature, threshold, child, value, depth in self.trees:
                node = np.zeros(len(part), np.int64)
                for _ in range(depth):
                    node = child.take(2 * node + ~(flat.take(feature.take(node) + start) <= threshold.take(node)))
                total += value.take(node)
            out[a : a + SCORED_ROWS] = total / len(self.trees)
        return out

    def exchanged_paths(self, x: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean path of each row, and of each row with feature j taken from ``other`` (a column per j).

        On its way down a tree a row collects the interval of each feature that leads to the same leaf;
        only values outside go down again.
        """
        n, dims = x.shape
        x, other = np.ascontiguousarray(x), np.ascontiguousarray(other)
        flat, start = x.ravel(), np.arange(n) * dims
        total, change = np.zeros(n), np.zeros(n * dims)
        for feature, threshold, child, value, depth in self.trees:
            low, high = np.full(n * dims, -np.inf), np.full(n * dims, np.inf)
            node = np.zeros(n, np.int64)
            for _ in range(depth):
                at, bound = feature.take(node) + start, threshold.take(node)
                left = flat.take(at) <= bound
                high[at] = np.where(left, np.minimum(high.take(at), bound), high.take(at))
                low[at] = np.where(left, low.take(at), np.maximum(low.take(at), bound))
                node = child.take(2 * node + ~left)
            here = value.take(node)
            total += here
            swapped = other.ravel()
            moved = np.flatnonzero(~((swapped > low) & (swapped <= high)))
            row, j = np.divmod(moved, dims)
            new, first, node = swapped.take(moved), row * dims, np.zeros(len(moved), np.int64)
            for _ in range(depth):
                split = feature.take(node)
                left = np.where(split == j, new, flat.take(split + first)) <= threshold.take(node)
                node = child.take(2 * node + ~left)
            change[moved] += value.take(node) - here.take(row)
        return total / len(self.trees), (total[:, None] + change.reshape(n, dims)) / len(self.trees)

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        """Negative anomaly score -s (higher is more normal), like the usual convention."""
        return self._scores(self.mean_path(x))

    def _scores(self, path: np.ndarray) -> np.ndarray:
        c = float(average_path([self.psi])[0]) or 1.0
        return -np.power(2.0, -path / c)

    def exchanged_change(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Per feature, the sum over rows of |change in raw score| when the row takes that feature from ``other``."""
        base, changed = (self._scores(path) for path in self.exchanged_paths(x, other))
        return np.abs(changed - base[:, None]).sum(0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Raw outlier score = -(decision function) = s + offset."""
        return -(self.score_samples(x) - self.offset)


def _sample(frame: DataFrame, key: str, n: int, psi: int, trees: int, seed: int) -> DataFrame:
    """psi rows per tree, uniformly without replacement, never exploding all n rows.

    A row-level hash first keeps a pool of about 3*psi*trees rows (fraction
    p_pool); only the pool is exploded over trees, and a per-(tree, row) hash
    keeps each pool row for a tree with probability (3*psi/n) / p_pool. Per tree
    the candidates are a uniform random subset of all rows, and the psi smallest
    per-tree hashes among them are a uniform sample without replacement.
    """
    frac = 1.0
    while True:
        keep = min(1.0, frac * 3.0 * psi / max(n, 1))
        pool = min(1.0, keep * trees)
        per_tree = min(1.0, keep / pool)
        rows = frame.select(key, "features", row_hash(key).alias("b"))
        if pool < 1.0:
            rows = rows.filter(drawn(F.col("b"), *map(F.lit, draw_keys(seed, "pool", 0))) < F.lit(int(pool * 2**32)))
        turns = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(a).alias("a"), F.lit(c).alias("c")) for t in range(trees) for a, c in [draw_keys(seed, "sample", t)]])
        pairs = rows.select(key, "features", "b", F.explode(turns).alias("t"))
        pairs = pairs.select(key, "features", "t.tree", drawn(F.col("b"), F.col("t.a"), F.col("t.c")).alias("h"))
        if per_tree < 1.0:
            pairs = pairs.filter(F.col("h") < F.lit(int(per_tree * 2**32)))
        w = Window.partitionBy("tree").orderBy("h", key)
        sample = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= psi).persist()
        sizes = sample.groupBy("tree").count()
        short = sizes.filter(F.col("count") < psi).count()
        got = sizes.count()
        if (short == 0 and got == trees) or keep >= 1.0:
            return sample
        sample.unpersist()
        frac *= 4.0


def fit_forest(frame: DataFrame, features: list[str], params: ForestParams | None = None, key: str = "Precinct_ID") -> Forest:
    """Fit on a frame holding ``key`` and ``features`` (ARRAY<DOUBLE>, scaled)."""
    return _fit(frame, features, params, key)[0]


def fit_and_score(frame: DataFrame, features: list[str], params: ForestParams | None = None,
                  key: str = "Precinct_ID") -> tuple[Forest, DataFrame]:
    """Fit, then flag the training rows from the training scores (one Python scoring pass, not two)."""
    forest, scored = _fit(frame, features, params, key)
    return forest, flags(scored, forest, key)


def _fit(frame: DataFrame, features: list[str], params: ForestParams | None, key: str) -> tuple[Forest, DataFrame]:
    params = params or ForestParams()
    n = frame.count()
    if n == 0:
        raise AnalysisUnavailable("no rows to grow trees from")
    ms = params.max_samples
    psi = min(256, n) if ms == "auto" else (min(int(ms), n) if isinstance(ms, int) else max(1, int(float(ms) * n)))
    depth = int(math.ceil(math.log2(max(psi, 2))))
    seed, trees = int(params.random_state), int(params.n_estimators)
    sample = _sample(frame, key, n, psi, trees, seed)

    ship_package(frame.sparkSession)
    dims = len(features)

    def grow(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        rows = grow_tree(matrix(table, "features", dims), depth, seed, tree)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "value"])
        out.insert(0, "tree", tree)
        return pa.Table.from_pandas(out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32", "right": "int32"}), preserve_index=False)

    nodes = sample.select("tree", "features").groupBy("tree").applyInArrow(grow, NODE_SCHEMA).toPandas()
    sample.unpersist()
    forest = Forest(nodes, psi, features, params)
    # Training score range and (numeric contamination) the offset.
    # Checkpointed (shared folder): the training scores feed the score range and the
    # training flags, and a lost executor re-reads them instead of re-scoring.
    ensure_checkpoint_dir(frame.sparkSession)
    scored = score(frame, forest, key, with_flags=False).checkpoint()
    if params.contamination != "auto":
        q = exact_quantile(scored.select(F.col("_ss")), "_ss", float(params.contamination))
        forest.offset = float(q)
        scored = scored.withColumn("raw", -(F.col("_ss") - F.lit(forest.offset)))
    st = scored.agg(F.min("raw"), F.max("raw")).first()
    forest.score_min, forest.score_max = float(st[0]), float(st[1])
    return forest, scored


def score(frame: DataFrame, forest: Forest, key: str = "Precinct_ID", with_flags: bool = True) -> DataFrame:
    """Narrow scoring pass: raw score, flag and min-max normalised score per row."""
    ship_package(frame.sparkSession)
    fz, dims = forest, len(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ss = fz.score_samples(matrix(rb, "features", dims))
            yield pa.RecordBatch.from_arrays([rb.column(key), pa.array(ss), pa.array(-(ss - fz.offset))], [key, "_ss", "raw"])

    kind = frame.schema[key].dataType.simpleString()
    out = frame.select(key, "features").mapInArrow(run, f"`{key}` {kind}, _ss double, raw double")
    return flags(out, forest, key) if with_flags else out


def flags(out: DataFrame, forest: Forest, key: str = "Precinct_ID") -> DataFrame:
    """Flag and min-max normalised score from raw scores (``key``, ``raw``)."""
    span = forest.score_max - forest.score_min
    eps = float(np.finfo(float).eps)
    norm = F.lit(0.0) if span <= eps else F.least(F.greatest((F.col("raw") - F.lit(forest.score_min)) / F.lit(span), F.lit(0.0)), F.lit(1.0))
    return out.select(key, (F.col("raw") > 0).alias("IF_Anomaly_Flag"), norm.alias("IF_Anomaly_Score"), F.col("raw").alias("IF_Raw_Score"))


#: Rows scored at once for all permuted features.
IMPORTANCE_ROWS = 1024


def feature_importance(frame: DataFrame, forest: Forest, key: str = "Precinct_ID", seed: int = 42) -> DataFrame:
    """Mean |change in raw score| when one feature is permuted over all rows, largest first, then by name.

    Rows are numbered by ``key``; feature j of row i becomes that of row image(i) under permutation
    j of the table. Values travel to their rows packed by row, and each task adds up its changes.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    ship_package(frame.sparkSession)
    fz, names, dims = forest, forest.features, len(forest.features)
    rows = consecutive_index(frame.select(key, "features"), [key], "idx").select("idx", "features").checkpoint()
    n = rows.count()
    turns = F.array(*[F.struct(F.lit(j).alias("j"), rounds_literal(seed, j, n, inverse=True).alias("rounds")) for j in range(dims)])
    sent = rows.select("idx", "features", F.explode(turns).alias("t")).select(
        image(F.col("idx"), F.col("t.rounds"), n).alias("idx"), "t.j", F.get("features", F.col("t.j")).alias("v"))
    packed = sent.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("p")).select("idx", F.col("p.v").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(dims), 0
        for whole in batches:
            for a in range(0, whole.num_rows, IMPORTANCE_ROWS):
                rb = whole.slice(a, IMPORTANCE_ROWS)
                total += fz.exchanged_change(matrix(rb, "features", dims), matrix(rb, "other", dims))
                seen += rb.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(np.full(dims, seen))], ["feature", "s", "n"])

    parts = rows.join(packed, "idx").select("features", "other").mapInArrow(run, "feature string, s double, n bigint")
    found = parts.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("importance"))
    return found.orderBy(F.col("importance").desc(), "feature")


def save_forest(forest: Forest, path: str, feature_model_json: str) -> None:
    """Persist a fitted forest (node table + parameters) as parquet with a kind tag."""
    if forest.score_min is None:
        raise ValueError("this forest is not fitted")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    nodes = spark.createDataFrame(forest.nodes.astype({"tree": "int32", "node": "int32"}))
    nodes.withColumn("kind", F.lit("tallyscope.isolation_forest.nodes")).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    meta = {"kind": "tallyscope.isolation_forest", "psi": forest.psi, "features": forest.features, "offset": forest.offset,
            "score_min": forest.score_min, "score_max": forest.score_max, "feature_model": feature_model_json,
            "params": {"n_estimators": forest.params.n_estimators, "contamination": forest.params.contamination,
                       "max_samples": forest.params.max_samples, "random_state": forest.params.random_state}}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(os.path.join(path, "meta"))


def load_forest(path: str) -> tuple[Forest, str]:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
    if meta.get("kind") != "tallyscope.isolation_forest":
        raise ValueError("not the tables of a forest")
    nodes = spark.read.parquet(os.path.join(path, "nodes"))
    if nodes.filter(F.col("kind") != "tallyscope.isolation_forest.nodes").limit(1).count():
        raise ValueError("not the tables of a forest")
    params = ForestParams(**meta["params"])
    forest = Forest(nodes.drop("kind").toPandas(), int(meta["psi"]), list(meta["features"]), params)
    forest.offset, forest.score_min, forest.score_max = float(meta["offset"]), float(meta["score_min"]), float(meta["score_max"])
    return forest, meta["feature_model"]
