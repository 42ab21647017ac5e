"""Document fingerprints by locally consistent parsing.

Each level labels its symbols by deterministic coin tossing: a symbol is replaced by the
place and value of the lowest bit in which it differs from its left neighbour, a few times
over, which leaves a handful of labels. Phrases begin at strict local maxima of the labels,
and a phrase's name, a hash of its symbols, is a symbol of the next level. Labels depend on
a few neighbours only, so equal substrings get equal phrase names inside, wherever they
stand. The k-th occurrence of a name counts as an element of its own, so repetition weighs.
A fingerprint holds, for fixed hash slots, the smallest element of levels 2 and 3 that falls
there; likeness is the share of agreeing slots among those that either text fills.

Null text counts as empty: an all-empty fingerprint, alike to another empty one only.
Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.ragged import _rolling, mix, row_slices, utf8

#: Level -> number of slots of the fingerprint.
SLOTS = {2: 16, 3: 48}
N_SLOTS = sum(SLOTS.values())
EMPTY = 0xFFFF
#: UTF-8 bytes of text that one task of the neighbour step is dealt, about.
TASK_BYTES = 8 << 20
#: Text bytes parsed at once.
SLICE_BYTES = 1 << 19


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing; ``first`` marks the row starts, which have no left neighbour."""
    one = x.dtype.type(1)
    diff = np.empty_like(x)
    diff[0] = one
    np.bitwise_xor(x[1:], x[:-1], out=diff[1:])
    diff[first] = one
    low = diff & (~diff + one)
    place = np.bitwise_count(low - one)
    bit = (x & low) != 0
    return (place << np.uint8(1)) | bit


def phrases(symbol: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of every row, and their row offsets."""
    n = len(symbol)
    if not n:
        return np.zeros(0, np.uint64), offsets
    first = offsets[:-1][np.diff(offsets) > 0]
    label = symbol
    for _ in range(3 if symbol.dtype == np.uint8 else 4):
        label = _toss(label, first)
    begins = np.zeros(n, bool)
    begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = offsets[1:][np.diff(offsets) > 0] - 1
    begins[last] = False
    begins[first] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    name = mix(_rolling(symbol.astype(np.uint64) + np.uint64(1), start, end, 0xA0761D6478BD642F) + (end - start).astype(np.uint64))
    return name, np.searchsorted(start, offsets)


def sketch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints, rows x slots; an empty slot is EMPTY."""
    rows = len(offsets) - 1
    out = np.full((rows, N_SLOTS), np.uint64(2**64 - 1), np.uint64)
    symbol, off, base = data, offsets, 0
    for level in range(1, max(SLOTS) + 1):
        symbol, off = phrases(symbol, off)
        if level in SLOTS:
            row = np.repeat(np.arange(rows), np.diff(off))
            own = mix(symbol + mix(row.astype(np.uint64)))
            order = np.argsort(own)
            own, row, name = own[order], row[order], symbol[order]
            place = np.arange(len(own))
            fresh = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
            nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
            h = mix(name + np.uint64(level) + mix(nth.astype(np.uint64)))
            slot = (h >> np.uint64(40)) % np.uint64(SLOTS[level])
            np.minimum.at(out, (row, slot.astype(np.int64) + base), h)
            base += SLOTS[level]
    full = out != np.uint64(2**64 - 1)
    return np.where(full, mix(out) % np.uint64(EMPTY), EMPTY).astype(np.uint16)


def to_text(prints: np.ndarray) -> list[str]:
    raw = prints.astype(">u2").tobytes()
    step = 2 * N_SLOTS
    return [raw[i : i + step].hex() for i in range(0, len(raw), step)]


#: Ranges of ids at most, so that their bounds and first ids stay small at any size; a task streams its range, which Spark sorts with spilling.
MOST_PARTS = 1 << 14


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing slots among those filled on either side, row by row; two empty ones are alike."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = filled.sum(1)
    return np.where(n > 0, ((a == b) & filled).sum(1) / np.maximum(n, 1), 1.0)


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    return sketch(*utf8(pa.array(texts, pa.large_string())))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches, max_bytes=SLICE_BYTES):
            texts = [t or "" for t in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(to_text(fingerprint_texts(texts)))], ["doc_id", "n_chars", "fingerprint"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (part, copy, doc_id, text) such that, sorted by (part, copy, doc_id, text), the
    document after a row in ascending id order is the next row of its part.

    Parts are ranges of the id. Each part also gets a copy of the first document of the
    part after it (the last part: of the first part), so no window spans the table and
    texts are shuffled once. A null id sorts first.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES)))
    marks = [i / n_parts for i in range(1, n_parts)]
    bounds = docs.select(key.alias("k")).agg(F.percentile_approx("k", marks, 10 * n_parts)).first()[0] if marks else None
    # fewer than one number per part; a part is found by binary search
    shared = spark.sparkContext.broadcast(np.array(sorted(set(bounds or [])), np.int64))

    @F.pandas_udf("int")
    def part(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, k.to_numpy(), "left"))

    keyed = docs.withColumn("k", key).withColumn("part", part("k"))
    heads = {r["part"]: r["k"] for r in keyed.groupBy("part").agg(F.min("k").alias("k")).collect()}
    order = sorted(heads)
    after = [(heads[q], p) for p, q in zip(order, order[1:] + order[:1])]
    # one row per part, at most n_parts
    copies = keyed.drop("part").join(F.broadcast(spark.createDataFrame(after, "k bigint, part int")), "k")
    rows = keyed.select("part", F.lit(0).alias("copy"), "doc_id", "text").unionByName(copies.select("part", F.lit(1).alias("copy"), "doc_id", "text"))
    return rows.repartition(n_parts, "part").sortWithinPartitions("part", "copy", "doc_id", "text")


def edited_fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, and their likeness.

    The edited text has its last quarter of code points replaced by the beginning of the
    next document in ascending id order (rows of equal id: by text; after the last: the
    first). A single document is its own next one.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def emit(ids: list, texts: list[str], owned: list[bool], nexts: list[bool]) -> pa.RecordBatch:
        """Rows 0..n-2 of a run whose row i + 1 is the next of row i."""
        at = [i for i in range(len(texts) - 1) if owned[i] and nexts[i]]
        changed = []
        for i in at:
            n = len(texts[i])
            changed.append(texts[i][: n - n // 4] + texts[i + 1][: n // 4])
        prints = fingerprint_texts(texts)
        own, following, new = prints[at], prints[[i + 1 for i in at]], fingerprint_texts(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(to_text(own), pa.string()), pa.array(to_text(new), pa.string()),
                pa.array(likeness(own, new)), pa.array(likeness(own, following)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, owned, parts = [], [], [], []
        for rb in row_slices(batches, max_bytes=SLICE_BYTES):
            ids += rb.column("doc_id").to_pylist()
            texts += [t or "" for t in rb.column("text").to_pylist()]
            owned += [c == 0 for c in rb.column("copy").to_pylist()]
            parts += rb.column("part").to_pylist()
            if len(texts) > 1:
                yield emit(ids, texts, owned, [a == b for a, b in zip(parts, parts[1:])])
                ids, texts, owned, parts = ids[-1:], texts[-1:], owned[-1:], parts[-1:]

    out = with_next(spark, picked).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
