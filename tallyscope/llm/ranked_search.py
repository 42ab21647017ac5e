"""Ranked lexical search: the k best documents of every item by exact weighted term scores.

1. Documents become rows of (length, terms, occurrences) over the terms of the items, written
   once; document counts per term are added up in tasks first.
2. A task indexes its documents in chunks of bounded size. The posting list of a term is cut into
   blocks of similar documents (each document goes to the most alike of evenly spaced ones, by a
   count sketch of its scores), and a block stores the largest score of each term in it. An item
   reads the lists whose terms together could lift a document to the item's k-th best score, and
   in them the blocks whose summed-up maxima reach it; only their documents are scored.
3. The first threshold of an item is its k-th best score in a hashed sample of documents. That is
   a lower bound of the final one, so it skips documents without losing any; tasks raise it by
   their own results. What tasks return, k rows an item at most each, is ranked at the end.

Items go through in waves of at most WAVE_TERMS distinct (item, term) pairs (one item at least), so
what is broadcast has a bound whatever the number of items.

Null texts and items have no terms. Every row is a document; rows of equal id rank one after the
other, null ids last among equal scores. Rows of equal item id are one item; a null item id is one
too. Items without a match return no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.ragged import ALNUM, LOWER, row_slices, utf8, words
from tallyscope.llm.tables import stage

#: Distinct (item, term) pairs held against the documents at once.
WAVE_TERMS = 1 << 20
#: One document in this many gives the first thresholds; results do not depend on it.
SAMPLE_ONE_IN = 16
#: Postings indexed at once, documents a block is meant to hold, cells of a document's sketch, items looked up together.
CHUNK_POSTINGS, BLOCK_DOCS, SKETCH, ITEMS_AT_ONCE = 1 << 18, 32, 64, 512

_UPPER, _PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Wave(NamedTuple):
    """Items of one wave: their terms (sorted UTF-8), and per item the indexes of its terms."""

    items: list
    terms: list[bytes]
    first: np.ndarray
    of_item: np.ndarray

    def terms_of(self, i: int) -> np.ndarray:
        return self.of_item[self.first[i] : self.first[i + 1]]


def _terms(text: Column) -> Column:
    """Distinct terms of a text, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _PLAIN)
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


def _waves(spark: SparkSession, items: DataFrame) -> Iterator[Wave]:
    """Waves of items; only one is on the driver at a time."""
    pairs = items.select("item_id", F.explode(_terms(F.col("text"))).alias("term")).distinct()
    sized = pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    sized = stage(spark, sized.select("item_id", F.array_sort("terms").alias("terms"), F.size("terms").alias("n")), "search-items")
    total = sized.agg(F.sum("n")).first()[0] or 0
    n_waves = max(1, -(-total // (WAVE_TERMS // 2)))
    for k in range(n_waves if total else 0):
        rows, held = [], 0
        # hashed waves hold half of WAVE_TERMS on average; one that holds more goes through in pieces
        for r in sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_waves)) == k).toLocalIterator():
            if rows and held + r["n"] > WAVE_TERMS:
                yield _wave(rows)
                rows, held = [], 0
            rows.append((r["item_id"], [t.encode() for t in r["terms"]]))
            held += r["n"]
        if rows:
            yield _wave(rows)


def _wave(rows: list) -> Wave:
    terms = sorted({t for _, own in rows for t in own})
    number = {t: i for i, t in enumerate(terms)}
    first = np.cumsum([0] + [len(own) for _, own in rows])
    return Wave([i for i, _ in rows], terms, first, np.array([number[t] for _, own in rows for t in own], np.int64))


# -- 1. documents as term counts ------------------------------------------------------------------


def count_terms(data: np.ndarray, offsets: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All terms per row; and row, term index, occurrences of those in ``terms``."""
    low = LOWER[data]
    w = words(low, offsets, ALNUM)
    mask = ALNUM[low]
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[mask]))])
    coded = column.dictionary_encode()
    at = pc.index_in(coded.dictionary, terms)
    known = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(w.start) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), w.per_row)
    hit = term >= 0
    key, n = np.unique(row[hit] * max(len(terms), 1) + term[hit], return_counts=True)
    return w.per_row, key // max(len(terms), 1), key % max(len(terms), 1), n


def term_counts(spark: SparkSession, docs: DataFrame, wave: Wave) -> DataFrame:
    """(doc_id, n, terms, counts): length and packed occurrences of the wave's terms."""
    shared = spark.sparkContext.broadcast(wave.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.large_binary())
        for rb in row_slices(batches):
            per_row, row, term, n = count_terms(*utf8(rb.column("text")), terms)
            cut = np.searchsorted(row, np.arange(rb.num_rows + 1)).tolist()
            packed = [[x[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])] for x in (term, n)]
            cols = [rb.column("doc_id"), pa.array(per_row.astype(np.int64)), *(pa.array(p, pa.binary()) for p in packed)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms binary, counts binary")


def document_counts(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents per term: one row a task and term, then a grouped sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for rb in batches:
            df += np.bincount(np.frombuffer(b"".join(rb.column("terms").to_pylist()), "<i4"), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    got = counted.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


# -- 2. blocks and exact scores -------------------------------------------------------------------


def term_scores(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """Score of each posting; 64-bit integers, or Python's where a length times the documents would not fit."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([50 + 50 * x * n_docs // n_all for x in n.tolist()], np.int64)
    else:
        m = 50 + 50 * n * n_docs // max(n_all, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of ``rows`` of a ragged array, and which of ``rows`` each belongs to."""
    size = first[rows + 1] - first[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[rows][owner], owner


class Chunk:
    """Index of some documents: postings by document and by term, blocks of a term's list one term at a time."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, score: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((term, doc))
        self.term, self.score = term[order], score[order]
        self.first = np.searchsorted(doc[order], np.arange(n_docs + 1))
        order = np.argsort(term, kind="stable")
        self.docs = doc[order]
        self.lists = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.top = np.zeros(n_terms, np.int64)
        np.maximum.at(self.top, term, score)
        # a signed count sketch per document, of unit length
        cell = (term * 0x9E3779B1 >> 7) % SKETCH
        sign = np.where((term * 0x85EBCA6B >> 11) & 1, 1.0, -1.0)
        flat = np.bincount(doc * SKETCH + cell, weights=sign * np.sqrt(score), minlength=n_docs * SKETCH)
        sketch = flat.reshape(n_docs, SKETCH).astype(np.float32)
        self.sketch = sketch / np.maximum(np.sqrt((sketch * sketch).sum(1, keepdims=True)), 1e-9)

    def blocks_of(self, t: int, wanted: np.ndarray) -> tuple:
        """Documents of the list by block, block borders, and per block the largest scores of its ``wanted`` terms."""
        docs = self.docs[self.lists[t] : self.lists[t + 1]]
        block = np.zeros(len(docs), np.int64)
        if len(docs) > BLOCK_DOCS:
            own = self.sketch[docs]
            centres = own[::BLOCK_DOCS].T
            for a in range(0, len(docs), 4096):
                block[a : a + 4096] = np.argmax(own[a : a + 4096] @ centres, 1)
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
        change = np.r_[False, block[1:] != block[:-1]]
        border = np.r_[0, np.flatnonzero(change), len(docs)]
        at, owner = _spread(self.first, docs)
        hit = wanted[self.term[at]]
        at, owner = at[hit], owner[hit]
        key = np.cumsum(change)[owner] * len(self.top) + self.term[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        most = np.maximum.reduceat(self.score[at[order]], head)
        return docs, border, key[head] // len(self.top), key[head] % len(self.top), most

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of documents over the terms marked in ``wanted``."""
        at, owner = _spread(self.first, docs)
        hit = wanted[self.term[at]]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, owner[hit], self.score[at[hit]])
        return out

    def needed(self, terms: np.ndarray, least: int) -> np.ndarray:
        """The terms of an item whose lists hold every document that can score ``least`` or more."""
        terms = terms[self.lists[terms + 1] > self.lists[terms]]
        terms = terms[np.argsort(self.top[terms], kind="stable")]
        # documents that hold only the weakest terms stay below
        return terms[np.cumsum(self.top[terms]) >= least]

    def candidates(self, items: list[np.ndarray], least: list[int]) -> list[np.ndarray]:
        """For each item (its terms) the documents of the blocks whose bound reaches ``least``."""
        lists = [self.needed(own, x) for own, x in zip(items, least)]
        term = np.concatenate(lists)
        item = np.repeat(np.arange(len(items)), [len(x) for x in lists])
        order = np.argsort(term, kind="stable")
        term, item = term[order], item[order]
        head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        found: list[list[np.ndarray]] = [[] for _ in items]
        wanted = np.zeros(len(self.top), bool)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(term)]):
            users = item[a:b].tolist()
            for i in users:
                wanted[items[i]] = True
            docs, border, block, held, most = self.blocks_of(int(term[a]), wanted)
            for i in users:
                wanted[items[i]] = False
            for i in users:
                wanted[items[i]] = True
                hit = wanted[held]
                wanted[items[i]] = False
                bound = np.zeros(len(border) - 1, np.int64)
                np.add.at(bound, block[hit], most[hit])
                live = np.flatnonzero(bound >= least[i])
                if len(live):
                    found[i].append(docs[_spread(border, live)[0]].astype(np.int32))
        return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int32) for f in found]


class Best:
    """The k best (score, id) of one item so far; ties go to the smaller id, null ids last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)
        self.score, self.id, self.absent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        good = score >= self.least
        score, ids, absent = (np.r_[a, b[good]] for a, b in ((self.score, score), (self.id, ids), (self.absent, absent)))
        order = np.lexsort((ids, absent, -score))[: self.k]
        self.score, self.id, self.absent = score[order], ids[order], absent[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def _ranked(spark: SparkSession, counted: DataFrame, wave: Wave, weight: np.ndarray, least: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    """(item, doc_id, score): every task's k best documents of each item at or above its threshold."""
    shared = spark.sparkContext.broadcast((wave.first, wave.of_item, weight, least))
    n_terms = len(wave.terms)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for rb in batches:
            for a in range(0, rb.num_rows, 256):
                part = rb.slice(a, 256)
                held.append(part)
                size += sum(map(len, part.column("terms").to_pylist())) // 4
                if size >= CHUNK_POSTINGS:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of_item, weight, least = shared.value
        best = [Best(k, int(x)) for x in least]
        wanted = np.zeros(n_terms, bool)
        for table in chunks(batches):
            blobs = table.column("terms").to_pylist()
            term = np.frombuffer(b"".join(blobs), "<i4").astype(np.int64)
            tf = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
            n = table.column("n").to_numpy()
            chunk = Chunk(doc, term, term_scores(weight[term], tf, n[doc], n_docs, n_all), len(blobs), n_terms)
            ids = table.column("doc_id")
            absent = ids.is_null().to_numpy()
            ids = ids.fill_null(0).to_numpy()
            for a in range(0, len(best), ITEMS_AT_ONCE):
                some = best[a : a + ITEMS_AT_ONCE]
                terms = [of_item[first[i] : first[i + 1]] for i in range(a, a + len(some))]
                for b, own, docs in zip(some, terms, chunk.candidates(terms, [b.least for b in some])):
                    if len(docs):
                        wanted[own] = True
                        b.add(chunk.scores(docs, wanted), ids[docs], absent[docs])
                        wanted[own] = False
        for i, b in enumerate(best):
            if len(b.score):
                ids = pa.array(b.id, pa.int64(), mask=b.absent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i, np.int32)), ids, pa.array(b.score)], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item: within salted parts first, so that no task gets all tasks' rows of an item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(32)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return part.drop("salt", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are not read.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    core = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    out = []
    for wave in _waves(spark, items):
        counted = stage(spark, term_counts(spark, core, wave), "search-counts")
        n_docs, n_all = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        n_all = n_all or 0
        weight = weights_of(document_counts(counted, len(wave.terms)), n_docs)
        least = np.zeros(len(wave.items), np.int64)
        some = counted.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE_ONE_IN)) == 0)
        sampled = _top(_ranked(spark, some, wave, weight, least, n_docs, n_all, k), k)
        for r in sampled.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).collect():
            if r["n"] == k:
                least[r["item"]] = r["score"]
        found = stage(spark, _ranked(spark, counted, wave, weight, least, n_docs, n_all, k), "search-found")
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(wave.items)], f"item int, item_id {kind}")
        out.append(_top(found, k).join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
size AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d),
total AS (SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
posting AS (
  SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM posting, total GROUP BY term),
scored AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS score
  FROM posting JOIN weight USING (term) JOIN size USING (doc_id), total),
summed AS (SELECT item_id, doc_id, CAST(sum(score) AS BIGINT) AS score FROM q JOIN scored USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM summed WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50
"""
