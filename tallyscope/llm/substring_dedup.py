"""Substring dedup: repeated windows of words are removed from all but the first document.

Every window of ``size`` consecutive words has a Rabin-Karp hash (one prefix sum per batch
gives all of them). The hashes are dealt to buckets in packed rows and counted there: a
window is repeated in a document if it also starts in a document with a smaller id. The
repeated windows go back to their documents, where overlapping ones merge into maximal
removal intervals. Windows frequent all over the corpus would gather in one bucket; a sample
names them, and their smallest document comes from a pre-aggregated minimum instead.

Null text has no words; a text shorter than a window is kept whole. Rows with a null id are
kept whole and repeat nothing. Rows with equal ids count as one document. Windows are judged
on the input, not on what is left. One row out per row in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.exchange import PACKED, bucket_bits, frequent_hashes, is_member, pack_rows, unpack_rows
from tallyscope.llm.ragged import NON_SPACE, row_slices, utf8, window_hashes, word_hashes, words
from tallyscope.llm.tables import stage, wider

#: Text bytes hashed at once.
SLICE_BYTES = 1 << 19
#: Up to so many ids of documents with repeats are broadcast (16 MB) so that other texts need no shuffle.
IDS_BROADCAST = 2_000_000


def _windows(rb: pa.RecordBatch, size: int, column: str = "text"):
    data, offsets = utf8(rb.column(column))
    w = words(data, offsets, NON_SPACE)
    h, start, first = window_hashes(word_hashes(data, w), w, size)
    return data, offsets, w, h, start, first


def frequent_minima(spark: SparkSession, docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent windows (sorted hashes) and the smallest id of a document that has each."""

    def sampled(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        *_, h, _, first = _windows(rb, size)
        return h, np.repeat(np.arange(rb.num_rows), np.diff(first))

    frequent = frequent_hashes(docs, sampled)
    if not len(frequent):
        return frequent, np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        least = np.full(len(table), np.iinfo(np.int64).max)
        for rb in row_slices(batches, max_bytes=SLICE_BYTES):
            *_, h, _, first = _windows(rb, size)
            hit = np.flatnonzero(is_member(h, table))
            ids = rb.column("doc_id").to_numpy()[np.searchsorted(first, hit, "right") - 1]
            np.minimum.at(least, np.searchsorted(table, h[hit]), ids)
        seen = least < np.iinfo(np.int64).max
        # one row per task and window
        yield pa.RecordBatch.from_arrays([pa.array(table[seen].view(np.int64)), pa.array(least[seen])], ["h", "doc_id"])

    got = docs.mapInArrow(run, "h bigint, doc_id bigint").groupBy("h").agg(F.min("doc_id").alias("doc_id")).toArrow()
    h = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got.column("doc_id").to_numpy()[order]


def repeated_windows(spark: SparkSession, docs: DataFrame, size: int, skip: np.ndarray) -> DataFrame:
    """(doc_id, hashes): per document and bucket the windows that start in an earlier document, those in ``skip`` apart."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(spark, n_bytes // 6)
    shared = spark.sparkContext.broadcast(skip)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches, max_bytes=SLICE_BYTES):
            *_, h, _, first = _windows(rb, size)
            owner = np.repeat(np.arange(rb.num_rows), np.diff(first))
            if len(shared.value):
                rest = ~is_member(h, shared.value)
                h, owner = h[rest], owner[rest]
            yield pack_rows(h, owner, rb.column("doc_id").to_numpy(), bits)

    def count(table: pa.Table) -> pa.Table:
        h, ids, _ = unpack_rows(table, bits)
        order = np.argsort(h)
        h, ids = h[order], ids[order]
        run = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size_of = np.diff(np.r_[run, len(h)])
        later = ids > np.repeat(np.minimum.reduceat(ids, run), size_of)
        h, ids = h[later], ids[later]
        order = np.argsort(ids, kind="stable")
        h, ids = h[order], ids[order]
        cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        ends = np.r_[cut[1:], len(ids)] if len(ids) else cut
        blobs = [np.unique(h[a:b]).tobytes() for a, b in zip(cut.tolist(), ends.tolist())]
        return pa.table({"doc_id": pa.array(ids[cut], pa.int64()), "hashes": pa.array(blobs, pa.binary())})

    packed = docs.mapInArrow(deal, PACKED)
    return packed.groupBy("bucket").applyInArrow(count, "doc_id bigint, hashes binary")


def _covered(rb: pa.RecordBatch, size: int, blobs: list | None, frequent: np.ndarray, least: np.ndarray):
    """Words of a batch and which of them lie in a repeated window."""
    data, offsets, w, h, start, first = _windows(rb, size)
    hit = np.zeros(len(h), bool)
    ids = rb.column("doc_id").to_pylist()
    if len(frequent) and len(h):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        own = np.repeat(np.array([np.iinfo(np.int64).min if i is None else i for i in ids]), np.diff(first))
        hit = (frequent[at] == h) & (least[at] < own)
    for i, parts in enumerate(blobs or []):
        if parts:
            table = np.sort(np.frombuffer(b"".join(parts), np.uint64))
            a, b = first[i], first[i + 1]
            hit[a:b] |= is_member(h[a:b], table)
    edge = np.zeros(len(w.start) + size + 1, np.int32)
    np.add.at(edge, start[hit], 1)
    np.add.at(edge, start[hit] + size, -1)
    return data, offsets, w, np.cumsum(edge)[: len(w.start)] > 0


def _intervals(gone: np.ndarray) -> list[dict]:
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def cut_text(raw: bytes, start: np.ndarray, gone: np.ndarray) -> str:
    """The text without the removed words and the white space after them; the rest as it was."""
    if not gone.any():
        return raw.decode()
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(raw[at : start[a]])
        at = int(start[b]) if b < len(start) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode().rstrip("\t\n\v\f\r ") if gone[-1] else b"".join(out).decode()


def remove_repeats(spark: SparkSession, docs: DataFrame, size: int = 13, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and, after ``prefix``, n_words, n_removed, removed (word intervals), kept_sha256, kept_text.

    kept_sha256 digests the kept words joined by one space; kept_text is the text with the
    intervals cut out and its layout otherwise kept. Columns that have these names are replaced.
    """
    core = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    frequent, least = frequent_minima(spark, core, size)
    parts = stage(spark, repeated_windows(spark, core, size, frequent), "repeated-windows")
    known = spark.sparkContext.broadcast((frequent, least))

    kinds = {"n_words": "bigint", "n_removed": "bigint", "removed": "array<struct<start: bigint, end: bigint>>", "kept_sha256": "string", "kept_text": "string"}
    new = [prefix + n for n in kinds]
    rows = docs.drop("repeat_hashes__", "repeat_doc_id__", *new)
    schema = wider(rows.schema, ", ".join(f"{n} {k}" for n, k in zip(new, kinds.values())))
    names = rows.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches):
            blobs = rb.column("repeat_hashes__").to_pylist() if "repeat_hashes__" in rb.schema.names else None
            data, offsets, w, gone = _covered(rb, size, blobs, *known.value)
            raw = data.tobytes()
            removed, digest, text = [], [], []
            dropped = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.first[:-1], len(gone)))
            dropped[w.per_row == 0] = 0
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                own = raw[a:b]
                if dropped[i]:
                    mask = gone[w.first[i] : w.first[i + 1]]
                    removed.append(_intervals(mask))
                    kept = compress(own.split(), (~mask).tolist())
                    text.append(cut_text(own, w.start[w.first[i] : w.first[i + 1]] - a, mask))
                else:
                    removed.append([])
                    kept = own.split()
                    text.append(own.decode())
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            cols = [rb.column(n) for n in names] + [
                pa.array(w.per_row.astype(np.int64)), pa.array(dropped), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(digest, pa.string()), pa.array(text, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*names, *new])

    per_doc = parts.groupBy("doc_id").agg(F.collect_list("hashes").alias("repeat_hashes__")).withColumnRenamed("doc_id", "repeat_doc_id__")
    key = F.col("doc_id").cast("bigint")
    ids = parts.select(F.col("doc_id").alias("repeat_doc_id__")).distinct()
    if ids.limit(IDS_BROADCAST + 1).count() > IDS_BROADCAST:
        joined = rows.join(per_doc, key == F.col("repeat_doc_id__"), "left").drop("repeat_doc_id__")
        return joined.mapInArrow(rewrite, schema)
    ids = F.broadcast(ids)
    touched = rows.join(ids, key == F.col("repeat_doc_id__"), "left_semi").join(per_doc, key == F.col("repeat_doc_id__")).drop("repeat_doc_id__")
    others = rows.join(ids, key == F.col("repeat_doc_id__"), "left_anti")
    return touched.mapInArrow(rewrite, schema).unionByName(others.mapInArrow(rewrite, schema))


#: The removed words of each document: whole windows that also start in a document with a smaller id.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(len(w) - 12)) AS pos, w FROM d WHERE len(w) >= 13),
g AS MATERIALIZED (SELECT doc_id, pos, hash(array_to_string(list_slice(w, pos + 1, pos + 13), ' ')) AS h, md5(array_to_string(list_slice(w, pos + 1, pos + 13), ' ')) AS m FROM v),
f AS (SELECT h, m, min(doc_id) AS least FROM g GROUP BY h, m),
r AS MATERIALIZED (SELECT g.doc_id, g.pos FROM g JOIN f USING (h, m) WHERE f.least < g.doc_id),
c AS (SELECT doc_id, list(DISTINCT pos + k) AS gone FROM r, range(13) t(k) GROUP BY doc_id),
j AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
z AS (SELECT doc_id, unnest(gone) AS i FROM c),
k AS (SELECT doc_id, list(x ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM j) u
      ANTI JOIN z USING (doc_id, i) GROUP BY doc_id)
SELECT j.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM j LEFT JOIN k USING (doc_id)
"""
