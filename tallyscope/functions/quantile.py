"""Exact, linearly interpolated quantiles by radix selection, without a sort.

A quantile needs one or two order statistics. Doubles map to 64-bit integers of the same order,
and a rank is narrowed 16 bits at a time: one pass counts the next 16 bits of the values that
share the bits found so far, for all columns and ranks together (one histogram per task, added up
by a grouped sum), and the running count names the part that holds the rank. Ranks with few values
left read them; the others go on, four passes at most, after which all bits are known. Ties cost
nothing. The answer is the exact order statistic (the same definition as numpy's default "linear"
quantile and pandas' ``median``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

BITS, PASSES = 16, 4
#: Values left whose (value, count) groups come back.
FEW = 4096
#: Histograms of a task (512 KB each) in one pass.
HISTOGRAMS = 128


@dataclass
class _Rank:
    """One order statistic: the value at 0-based ``rank`` among the non-NULL values of ``column``."""

    column: str
    rank: int
    inside: int  # values that share the bits found
    prefix: int = 0  # the bits found, ``passes`` times BITS of them
    passes: int = 0
    below: int = 0  # values under them
    value: float | None = None

    @property
    def group(self) -> tuple[str, int, int]:
        return self.column, self.passes, self.prefix


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles ``x``; 0.0 and -0.0 are one value."""
    raw = (x + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63))


def _double(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _values(rb: pa.RecordBatch, column: int) -> np.ndarray:
    return rb.column(column).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)


def _inside(bits: np.ndarray, passes: int, prefix: int) -> np.ndarray:
    return bits[bits >> np.uint64(64 - BITS * passes) == np.uint64(prefix)] if passes else bits


def _narrow(df: DataFrame, names: list[str], ranks: list[_Rank]) -> None:
    """The next bits of each rank: one pass."""
    groups = sorted({r.group for r in ranks})
    wanted = [(g, names.index(c), passes, prefix) for g, (c, passes, prefix) in enumerate(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(wanted), 1 << BITS), np.int64)
        for rb in batches:
            bits = {c: ordered_bits(_values(rb, c)) for c in {w[1] for w in wanted}}
            for g, c, passes, prefix in wanted:
                own = _inside(bits[c], passes, prefix) >> np.uint64(64 - BITS * (passes + 1)) & np.uint64((1 << BITS) - 1)
                counts[g] += np.bincount(own.astype(np.int64), minlength=1 << BITS)
        g, digit = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(counts[g, digit])], ["g", "digit", "n"])

    counted = df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, "g int, digit int, n bigint").groupBy("g", "digit").agg(F.sum("n").alias("n"))
    # a group has at most 65,536 digits
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("digit")))
    number = {key: g for g, key in enumerate(groups)}
    asked = F.array(*[F.struct(F.lit(number[r.group]).alias("g"), F.lit(i).alias("i"), F.lit(r.rank - r.below).cast("bigint").alias("at")) for i, r in enumerate(ranks)])
    hit = upto.withColumn("ask", F.explode(F.filter(asked, lambda a: (a["g"] == F.col("g")) & (a["at"] < F.col("upto")) & (a["at"] >= F.col("upto") - F.col("n")))))
    for row in hit.select("ask.i", "digit", "n", "upto").collect():
        r = ranks[row["i"]]
        r.prefix, r.passes, r.inside = r.prefix << BITS | row["digit"], r.passes + 1, row["n"]
        r.below += row["upto"] - row["n"]
        if r.passes == PASSES:
            r.value = _double(r.prefix)


def _settle(df: DataFrame, names: list[str], ranks: list[_Rank]) -> None:
    """Values of ranks with few values left, from their (value, count) groups."""
    groups = sorted({r.group for r in ranks})
    wanted = [(g, names.index(c), passes, prefix) for g, (c, passes, prefix) in enumerate(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            bits = {c: ordered_bits(_values(rb, c)) for c in {w[1] for w in wanted}}
            for g, c, passes, prefix in wanted:
                key, n = np.unique(_inside(bits[c], passes, prefix), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), g, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["g", "key", "n"])

    got = df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, "g int, key bigint, n bigint").groupBy("g", "key").agg(F.sum("n").alias("n")).collect()
    held: dict[tuple, list[tuple[int, int]]] = {key: [] for key in groups}
    for row in got:
        held[groups[row["g"]]].append((row["key"] & ((1 << 64) - 1), row["n"]))
    for r in ranks:
        passed = r.below
        for key, n in sorted(held[r.group]):
            if passed <= r.rank < passed + n:
                r.value = _double(key)
            passed += n


def exact_quantiles(df: DataFrame, requests: dict[str, list[float]], counts: dict[str, int] | None = None) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolation quantiles of non-NULL values for each (column, q)."""
    if any(not 0.0 <= q <= 1.0 for qs in requests.values() for q in qs):
        raise ValueError("quantile must be in [0, 1]")
    if counts is None:
        row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(requests)]).first()
        counts = {c: int(row[f"n{i}"]) for i, c in enumerate(requests)}
    asked = {c: sorted({r for q in qs for r in ranks_of(counts[c], q)}) for c, qs in requests.items()}
    values = order_statistics(df, asked, counts)
    return {(c, q): interpolated(counts[c], q, lambda r, c=c: values[(c, r)]) for c, qs in requests.items() for q in qs}


def ranks_of(n: int, q: float) -> list[int]:
    """The ranks between which quantile ``q`` of ``n`` values lies."""
    h = (n - 1) * q
    return sorted({math.floor(h), math.ceil(h)}) if n else []


def interpolated(n: int, q: float, value: Callable[[int], float]) -> float | None:
    """Quantile ``q`` of ``n`` values, given the value at a rank."""
    found, h = [value(r) for r in ranks_of(n, q)], (n - 1) * q
    return found[0] + (h - math.floor(h)) * (found[-1] - found[0]) if found else None


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], counts: dict[str, int]) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank among the ``counts`` non-NULL values of each column."""
    ship_package(df.sparkSession)
    df = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in wanted])
    ranks = {(c, k): _Rank(c, k, counts[c]) for c, some in wanted.items() for k in some}
    for step, some in ((_narrow, lambda r: r.inside > FEW), (_settle, lambda r: r.inside <= FEW)):
        while wide := [r for r in ranks.values() if r.value is None and some(r)]:
            # ranks of one group share its histogram
            now = set(list(dict.fromkeys(r.group for r in wide))[:HISTOGRAMS])
            wide = [r for r in wide if r.group in now]
            step(df, sorted({r.column for r in wide}), wide)
    return {key: r.value for key, r in ranks.items()}


def exact_quantile(df: DataFrame, column: str, q: float, n: int | None = None) -> float | None:
    counts = None if n is None else {column: n}
    return exact_quantiles(df, {column: [q]}, counts)[(column, q)]
