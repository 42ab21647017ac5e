"""Benchmark decontamination: size-partitioned MinHash containment search, on SQL functions only.

An item is contained in a document if at least 0.8 of the item's distinct word shingles
occur there. Items are partitioned by their number of shingles. The MinHash sketch of an
item holds its n - ceil(0.8 n) + 1 smallest shingle hashes: a document with 0.8 of the item
has at least one of them, so the search misses nothing. For each partition the largest sketch
hash bounds what a document has to show; a document joins the partitions that its own size
allows, with its hashes up to their bound. Pairs that share a sketch hash are candidates and
are verified by exact containment of the shingle texts.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Null texts and texts
under ``size`` words have no shingles: such items are found nowhere. Rows with a null id are
not searched. Rows with equal ids count as found if one of them is; equal items each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.tables import stage

#: An item is contained from this share of its shingles on, NUM / DEN.
NUM, DEN = 8, 10
#: Sketches (24 bytes a row), pairs and item shingles are broadcast up to these counts; beyond, they are joined by shuffle.
SKETCH_BROADCAST = 1_000_000
IDS_BROADCAST = 2_000_000
ITEM_BROADCAST_BYTES = 8 << 20

_WORDS = r"regexp_extract_all(lower({0}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)"


def _words(text: str) -> Column:
    return F.expr(_WORDS.format(text))


def _hashes(words: str, size: int) -> Column:
    """One hash per window of ``size`` words."""
    args = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> xxhash64({args})) else array() end")


def _shingles(words: str, size: int) -> Column:
    """The distinct windows of ``size`` words, as texts."""
    return F.expr(f"array_distinct(case when size({words}) >= {size} then transform(sequence(1, size({words}) - {size - 1}), i -> concat_ws(' ', slice({words}, i, {size}))) else array() end)")


def item_sketches(items: DataFrame, size: int) -> DataFrame:
    """(item_id, n, part, h): sketch hashes of every item; ``part`` is its size partition."""
    hashed = items.withColumn("w", _words("text")).withColumn("hs", F.array_sort(F.array_distinct(_hashes("w", size)))).withColumn("n", F.size("hs"))
    part = F.floor(F.log2("n")).cast("int").alias("part")
    # explode_outer (and coalesce below), as the null filters that Spark derives from explode and
    # from comparisons would be pushed into the scan, where they evaluate all these expressions anew
    sketch = F.expr(f"slice(hs, 1, n - int(ceil({NUM} * n / {DEN})) + 1)")
    return hashed.select("item_id", "n", part, F.explode_outer(sketch).alias("h")).filter("h is not null")


def find_contained(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) of every contained item."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    items = items.select("item_id", "text").filter("item_id is not null and text is not null")
    sketches = stage(spark, item_sketches(items, size), "sketches")
    # one row per power of two of the item sizes
    parts = sketches.groupBy("part").agg(F.max("h").alias("top"), F.min("n").alias("n"), F.count("*").alias("k")).collect()
    small = sum(p["k"] for p in parts) <= SKETCH_BROADCAST

    hashed = docs.select("doc_id", _words("text").alias("w")).select("doc_id", _hashes("w", size).alias("hs")).withColumn("m", F.size("hs"))
    bound = F.greatest(*(F.when(F.col("m") * DEN >= p["n"] * NUM, F.lit(p["top"])) for p in parts), F.lit(-(2**63)), F.lit(-(2**63)))
    shown = hashed.withColumn("bound", bound).select("doc_id", "m", F.explode_outer(F.expr("filter(hs, h -> h <= bound)")).alias("h")).filter("h is not null")
    met = shown.join(F.broadcast(sketches) if small else sketches, "h").filter(f"coalesce(m, 0) * {DEN} >= coalesce(n, 0) * {NUM}")  # coalesce: see item_sketches
    pairs = stage(spark, met.select("doc_id", "item_id").distinct(), "candidates")

    # exact containment of the candidates, on the shingle texts
    few = pairs.limit(IDS_BROADCAST + 1).count() <= IDS_BROADCAST
    listed = items.select("item_id", _words("text").alias("w")).select("item_id", _shingles("w", size).alias("item_shingles"))
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    light = n_bytes * size <= ITEM_BROADCAST_BYTES
    texts = docs.join(F.broadcast(pairs) if few else pairs, "doc_id").select("doc_id", "item_id", _words("text").alias("w")).select("doc_id", "item_id", _shingles("w", size).alias("doc_shingles"))
    both = texts.join(F.broadcast(listed) if light else listed, "item_id")
    counted = both.select("doc_id", "item_id", F.size("item_shingles").cast("bigint").alias("n_shingles"), F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("bigint").alias("n_common"))
    return (
        counted.groupBy("doc_id", "item_id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.max("n_common").alias("n_common"))
        .filter(f"n_common * {DEN} >= n_shingles * {NUM}")
        .withColumn("containment", F.col("n_common") / F.col("n_shingles"))
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
si AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_common * 10 >= n_shingles * 8
"""
