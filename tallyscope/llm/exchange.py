"""Dealing hashes to buckets in packed rows, and hashes that are frequent all over the corpus.

A slice of documents gives one row per bucket (the top bits of the hash): the documents that
have hashes there, how many each, and the remaining 56 bits of every hash, so a hash costs
little more than its 7 bytes in the shuffle instead of a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.ragged import row_slices

#: Hashes that a bucket is meant to hold.
BUCKET_HASHES = 1 << 20
PACKED = "bucket int, ids binary, counts binary, hashes binary, extra binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("ids", "counts", "hashes", "extra"))])

#: About so many documents are looked at to find the frequent hashes, whatever the number of documents ...
SAMPLE_DOCS = 4096
#: ... which are those in at least this share of the looked-at documents (in eight where all of few are looked at).
FREQUENT_SHARE, FREQUENT_LEAST = 0.002, 8


def bucket_bits(spark: SparkSession, n_hashes: int) -> int:
    """Bits of the bucket number: at least 8 (so no bit of a hash is lost), more as the corpus grows."""
    wanted = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_hashes // BUCKET_HASHES))
    return min(30, max(8, (wanted - 1).bit_length()))


def pack_rows(hashes: np.ndarray, owner: np.ndarray, ids: np.ndarray, bits: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of one slice. ``owner`` (ascending) points into the int64 array ``ids``; extra: one byte per hash."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    low = np.ascontiguousarray(hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
    more = extra[order] if extra is not None else None
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    cols: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts, cuts[1:]):
        own = owner[a:b]
        first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
        cols[0].append(int(bucket[a]))
        cols[1].append(ids[own[first]].tobytes())
        cols[2].append(np.diff(np.r_[first, b - a]).astype(np.int32).tobytes())
        cols[3].append(low[a:b].tobytes())
        cols[4].append(more[a:b].tobytes() if more is not None else None)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PACKED_ARROW)], schema=PACKED_ARROW)


def unpack_rows(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, id, extra) of all packed rows of one bucket."""
    bucket = np.uint64(table.column("bucket")[0].as_py())
    join = lambda c: b"".join(x for x in table.column(c).to_pylist() if x is not None)
    raw = np.frombuffer(join("hashes"), np.uint8).reshape(-1, 7)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :7] = raw
    low = wide.view("<u8").ravel()
    h = (low & np.uint64((1 << (64 - bits)) - 1)) | (bucket << np.uint64(64 - bits))
    ids = np.repeat(np.frombuffer(join("ids"), np.int64), np.frombuffer(join("counts"), np.int32))
    return h, ids, np.frombuffer(join("extra"), np.uint8)


def frequent_hashes(docs: DataFrame, per_slice: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sorted hashes that are frequent in a sample of documents (``doc_id``, ``text``), drawn by a hash of the id.

    ``per_slice`` gives hashes and their row. No more hashes than 1 / FREQUENT_SHARE times the
    mean number per document can reach that share, whatever the size of the corpus, so the
    result may be broadcast. The sample only steers the plan: results are the same without it.
    """
    n = docs.select("doc_id").count()
    some = docs.filter(F.pmod(F.xxhash64(F.lit("frequent"), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches):
            h, row = per_slice(rb)
            # once per document
            pair = np.unique(np.stack([row.astype(np.uint64), h], 1), axis=0)[:, 1]
            value, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    least = max(FREQUENT_LEAST, int(FREQUENT_SHARE * min(n, SAMPLE_DOCS)))
    counted = some.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(counted.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def is_member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values
