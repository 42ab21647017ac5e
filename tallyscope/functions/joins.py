"""Join helpers: broadcast only behind a checked size, shuffle join otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side (text bytes plus 8 per other value) that is broadcast after it was measured; beyond
# it the join shuffles and AQE's skew-join handling splits hot partitions.
BROADCAST_BYTES = 16 << 20


def _bytes(df: DataFrame) -> int:
    texts = [c for c, t in df.dtypes if t == "string"]
    width = F.lit(8 * (len(df.columns) - len(texts)))
    for c in texts:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return df.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``dim`` onto ``fact``; broadcast ``dim`` only if it holds at most ``max_bytes``.

    The dimension is persisted before it is measured, so the measure and the join
    read it once.
    """
    dim = dim.persist()
    return fact.join(F.broadcast(dim) if _bytes(dim) <= max_bytes else dim, on, how)


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of two row-level tables that must each hold a non-null ``key`` at most once.

    One grouped count per side (combined map-side) finds repeated keys before they multiply rows.
    """
    for side, df in (("left", left), ("right", right)):
        twice = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").orderBy(key).limit(3).collect()
        if twice:
            raise ValueError(f"{key} is not unique on the {side} side of a one-to-one join: {', '.join(str(r[key]) for r in twice)}")
    return left.join(right, key, "left")
