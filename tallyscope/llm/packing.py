"""Best-fit packing with certified repacking.

Tokenising: a document is its token ids and one end id.

Packing: only documents longer than a sequence are cut; their first piece takes the
remainder and all later ones fill a sequence each. All other pieces are dealt over
partitions by a hash and packed there by best-fit decreasing. A dual-feasible-function
bound on each partition's bin count certifies it; its bins stay, but for the emptiest. The
documents of those and of the partitions with a gap are pooled and exchanged: fewer and
larger partitions are packed anew, and the new packing stands if it needs fewer bins. Rounds
end when one task has packed the whole pool, when the pool packs no better, or at a bounded
task size.

Null text counts as empty: a piece of one end id. One result row per piece; repeated rows
are packed like any others. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.ragged import row_slices
from tallyscope.llm.tables import stage
from tallyscope.llm.token_counts import byte_alphabet

#: Pieces of one packing task in the first round, by how much a task grows from round to round, and rounds of exchange.
PIECES_PER_TASK = 8192
GROWTH = 4
ROUNDS = 2


class TokenIds:
    """Unsigned 32-bit ids of whole texts under a byte-level vocabulary file of the tokenizers library.

    The merge ranks of such a vocabulary are its ids, so the faster merge loop of tiktoken
    runs on the vocabulary read from the same file and gives the same ids; a text that
    holds a special string goes to the tokenizers library itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.merger = tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        """Loaded for the first text that needs it: few do, and it takes memory in every worker."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.merger.encode_to_numpy(text, disallowed_special=())


_workers: dict[str, TokenIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; no shuffle."""
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = TokenIds(path)
        for rb in row_slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(rb.column("text").to_pylist()):
                ids = memoryview(_workers[path].encode(text or "").astype("<u4").tobytes() + end)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size: longest first, each into the fullest bin that takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set while a bin with r free places exists
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_rooms >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_rooms ^= 1 << free
        else:
            free, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - free
        free -= s
        if free:
            room[free].append(b)
            open_rooms |= 1 << free
    return bins, offsets


def bin_bound(counts: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins for ``counts[size]`` pieces, from two families of dual feasible functions."""
    size = np.flatnonzero(counts)
    if not len(size):
        return 0
    n = counts[size].astype(np.int64)
    best = -(-int((size * n).sum()) // capacity)
    # sizes above capacity - cut count as a whole bin, those below cut as nothing
    for cut in range(1, capacity // 2 + 1):
        weight = np.where(size > capacity - cut, capacity, np.where(size < cut, 0, size))
        best = max(best, -(-int((weight * n).sum()) // capacity))
    # rounding to k-ths: a size of exactly i/(k+1) of a bin keeps its share
    for k in range(1, 33):
        scaled = size * (k + 1)
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((weight * n).sum()) // (capacity * k)))
    return best


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        sizes = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        leader = pd.Series(pdf["item"].to_numpy()).groupby(bins).transform("min").to_numpy()
        made = int(bins.max()) + 1
        bound = bin_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        load = np.bincount(bins, sizes)
        emptiest = (bins == load.argmin()) & (load.min() < capacity)
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "length": sizes, "bin": leader, "offset": offsets, "certified": (made <= bound) & ~emptiest})

    return run


def _pack(items: DataFrame, tasks: int, salt: int, capacity: int) -> DataFrame:
    dealt = items.withColumn("task", F.expr(f"pmod(xxhash64(item, {salt}), {tasks})"))
    return dealt.groupBy("task").applyInPandas(_pack_group(capacity), "item bigint, length bigint, bin bigint, offset bigint, certified boolean")


def pack(spark: SparkSession, cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`pieces`."""
    # ids are drawn once and kept: they name bins
    cut = stage(spark, cut.withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    loose = cut.filter(F.col("length") < capacity).select("item", "length")
    tasks = max(1, -(-loose.count() // PIECES_PER_TASK))
    packed = stage(spark, _pack(loose, tasks, 0, capacity), "pack-round")
    final, pool = packed.filter("certified"), packed.filter("not certified")
    for salt in range(1, ROUNDS + 1):
        n_pool, before = pool.agg(F.count("*"), F.count_distinct("bin")).first()
        if tasks == 1 or not n_pool:
            break
        tasks = max(1, -(-n_pool // (PIECES_PER_TASK * GROWTH**salt)))
        again = stage(spark, _pack(pool.select("item", "length"), tasks, salt, capacity), "pack-round")
        if again.agg(F.count_distinct("bin")).first()[0] >= before:
            break
        final, pool = final.unionByName(again.filter("certified")), again.filter("not certified")
    placed = final.unionByName(pool).select("item", "bin", "offset")
    return (
        cut.join(placed, "item", "left")
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.coalesce("bin", "item").alias("sequence_id"),
            F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"),
        )
    )


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    return pack(spark, pieces(docs, path, capacity, end_id), capacity)


def bound_of(cut: DataFrame, capacity: int = 1024) -> int:
    """Lower bound on the sequences of all pieces together (the size histogram has ``capacity`` rows at most)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return bin_bound(counts, capacity)
