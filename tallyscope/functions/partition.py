"""k-d partition of a table of points into leaves of bounded size, and which leaves lie near each other.

Leaves are split in rounds. In a round each leaf that is too large gets planes from a bounded
sample of its own points (widest coordinate, median), and its points walk down them in one
expression, up to 64 parts a round; rounds are logarithmic in the number of points. Every
round is checkpointed. Planes only decide who sits together, never a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_dimension

#: Points a leaf may hold, levels of planes in a round, and points of a leaf that choose its planes.
LEAF_POINTS, LEVELS, CHOOSERS = 2048, 6, 1024
#: Box coordinates held against all leaves at once (16 MB).
BOX_VALUES = 1 << 21


def matrix(table: pa.Table | pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The vectors of an ARRAY<DOUBLE> column as rows."""
    values = table.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _planes(x: np.ndarray, levels: int) -> list[dict]:
    """Planes in heap order; ``dim`` -1 where a part is not split."""
    out = [{"dim": -1, "at": 0.0}] * (2**levels - 1)
    parts = {1: np.arange(len(x))}
    for k in range(1, 2**levels):
        rows = parts.pop(k, np.zeros(0, np.int64))
        if len(rows) < 2:
            continue
        own = x[rows]
        dim = int(np.argmax(own.max(0) - own.min(0)))
        values = np.sort(own[:, dim])
        low = values[values < values[-1]]
        if not len(low):
            continue
        at = min(values[(len(values) - 1) // 2], low[-1])
        out[k - 1] = {"dim": dim, "at": float(at)}
        right = own[:, dim] > at
        parts[2 * k], parts[2 * k + 1] = rows[~right], rows[right]
    return out


def kd_partition(points: DataFrame, dims: int, vector: str = "v", leaf_points: int | None = None) -> DataFrame:
    """``points`` (id, ``vector`` ARRAY<DOUBLE>, ...; distinct vectors) with a column ``leaf``."""
    leaf_points = leaf_points or LEAF_POINTS
    now = points.withColumn("leaf", F.lit(0).cast("bigint")).checkpoint()
    leaves, turn = 1, 0
    kind = pa.list_(pa.struct([("dim", pa.int32()), ("at", pa.float64())]))

    def choose(table: pa.Table) -> pa.Table:
        levels = min(LEVELS, max(1, math.ceil(math.log2(table.column("count")[0].as_py() / leaf_points))))
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "planes": pa.array([_planes(matrix(table, vector, dims), levels)], kind)})

    while True:
        large = now.groupBy("leaf").count().filter(F.col("count") > leaf_points).checkpoint()
        if large.isEmpty():
            return now
        turn += 1
        share = F.pmod(F.xxhash64(F.lit(turn), F.col("id")), F.lit(1 << 30)) < F.lit(CHOOSERS * float(1 << 30)) / F.col("count")
        some = join_dimension(now.select("id", "leaf", vector), large, "leaf").filter(share)
        planes = some.select("leaf", vector, "count").groupBy("leaf").applyInArrow(choose, "leaf bigint, planes array<struct<dim: int, at: double>>").checkpoint()
        step = (f"aggregate(sequence(1, {LEVELS}), 1, (k, i) -> CASE WHEN coalesce(get(planes, k - 1).dim, -1) < 0 THEN k "
                f"ELSE 2 * k + CAST(get({vector}, get(planes, k - 1).dim) > get(planes, k - 1).at AS INT) END)")
        moved = join_dimension(now, planes, "leaf", "left").withColumn("leaf", F.col("leaf") * (1 << (LEVELS + 1)) + F.expr(step)).drop("planes")
        now = moved.select(*points.columns, "leaf").checkpoint()
        before, leaves = leaves, now.select("leaf").distinct().count()
        if leaves == before:
            return now


def boxes(points: DataFrame, dims: int, vector: str = "v") -> DataFrame:
    """(leaf, lo, hi): the bounding box of every leaf."""
    side = lambda f: F.array(*[f(F.col(vector)[j]) for j in range(dims)])
    return points.groupBy("leaf").agg(side(F.min).alias("lo"), side(F.max).alias("hi")).checkpoint()


def gap_norm(gaps: np.ndarray, metric: str) -> np.ndarray:
    return gaps.sum(-1) if metric == "manhattan" else np.sqrt((gaps * gaps).sum(-1))


def near_leaves(box: DataFrame, dims: int, radius: float, metric: str) -> DataFrame:
    """(leaf, near, apart, lo, hi): other leaves whose box lies within ``radius``, how far their middles are apart, their box.

    Each row of ``box`` is held against all boxes in slices of bounded size.
    """
    spark = box.sparkSession
    slices = max(1, -(-box.count() * 2 * dims // BOX_VALUES))
    found = None
    for k in range(slices):
        part = box.filter(F.pmod(F.xxhash64("leaf"), F.lit(slices)) == k).toArrow()
        leaf, lo, hi = part.column("leaf").to_numpy(), matrix(part, "lo", dims), matrix(part, "hi", dims)
        shared = spark.sparkContext.broadcast((leaf, lo, hi))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            leaf, lo, hi = shared.value
            for rb in batches:
                own = rb.column("leaf").to_numpy()
                for i, (a, b) in enumerate(zip(matrix(rb, "lo", dims), matrix(rb, "hi", dims))):
                    gap = gap_norm(np.maximum(np.maximum(lo - b, a - hi), 0.0), metric)
                    # a little wider, so that rounding loses no leaf
                    hit = np.flatnonzero((gap <= radius * (1 + 1e-9)) & (leaf != own[i]))
                    apart = gap_norm(np.abs((lo[hit] + hi[hit]) - (a + b)), metric) / 2
                    cols = [np.full(len(hit), own[i]), leaf[hit], apart]
                    sides = [pa.array(list(x[hit]), pa.list_(pa.float64())) for x in (lo, hi)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *sides], ["leaf", "near", "apart", "lo", "hi"])

        got = box.mapInArrow(run, "leaf bigint, near bigint, apart double, lo array<double>, hi array<double>")
        found = got if found is None else found.unionByName(got)
    return found.checkpoint()
