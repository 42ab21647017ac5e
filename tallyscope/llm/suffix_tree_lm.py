"""LM scoring with a probabilistic suffix tree.

The model reads a text as its lower-cased words, joined by one space, and an end: a sequence
of bytes folded to 64 symbols (the 62 most frequent bytes, one for a byte outside them, which
then costs its choice among the rest). Symbols up to DEPTH back are the contexts. A context
is kept if its next-symbol distribution diverges from that of its one-shorter suffix by at
least MIN_GAIN nats over all its occurrences, with all its suffixes. Kept distributions are smoothed by interpolation
with the suffix's (weight: the number of different next symbols). Each symbol is scored by the
state of the longest kept suffix of what precedes it.

All training rows are counted, words and symbol sequences alike, in Spark. The HEAD_STATES
contexts of largest divergence, with their suffixes, are broadcast, as are the HEAD_WORDS most
frequent words. The other contexts stay a table, joined to the distinct sequences of all rows
whose context may lie beyond the broadcast state (told by a bitmap of fixed size): what a
sequence gains by them. Up to DELTAS such sequences are broadcast, more are joined to the
rows. Other words of the documents are joined to the word counts. No bound decides what
counts, only where it is looked up.

Null text counts as empty: its one token is the end. One row out per row in; equal texts
score alike. Without training rows the tree is one uniform state and every count is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.ragged import LOWER, NON_SPACE, row_slices, utf8, word_hashes, words
from tallyscope.llm.tables import stage

DEPTH = 5
SYMBOLS = 64
BITS = 6
OTHER = SYMBOLS - 1
MIN_GAIN = 8.0
HEAD_STATES = 1 << 14
DELTAS = 1 << 22
#: Bits (a prime) that tell whether a context may be outside the broadcast states.
BITMAP = (1 << 26) - 5
HEAD_WORDS = 200_000
#: Distinct sequences that a counting task holds before it passes them on.
HELD = 1 << 20
END = 0x0A
MASKS = [(1 << (BITS * (d + 1))) - 1 for d in range(DEPTH + 1)]
CONTEXT_MASKS = [(1 << (BITS * d)) - 1 for d in range(DEPTH + 1)]


class Tree(NamedTuple):
    fold: np.ndarray  # byte -> symbol
    child: np.ndarray  # state * SYMBOLS + older symbol -> longer state, or 0
    logp: np.ndarray  # state * SYMBOLS + next symbol -> log10 probability


def symbol_stream(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the model's sequences, their row offsets, and the words per row."""
    data, offsets = utf8(rb.column("text"))
    # every row ends in one line feed, so each word has a separator after it
    n = len(offsets) - 1
    at = offsets[1:] + np.arange(n)
    grown = np.empty(len(data) + n, np.uint8)
    own = np.ones(len(grown), bool)
    own[at] = False
    grown[own] = LOWER[data]
    grown[at] = END
    off = offsets + np.arange(n + 1)
    inside = NON_SPACE[grown]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    grown[~inside] = 0x20
    w = words(grown, off, NON_SPACE)
    filled = w.per_row > 0
    grown[w.end[w.first[1:][filled] - 1]] = END
    keep[at[~filled]] = True
    grown[at[~filled]] = END
    upto = np.concatenate([[0], np.cumsum(keep)])
    return grown[keep], upto[off], w.per_row


def contexts(symbol: np.ndarray, is_end: np.ndarray) -> list[np.ndarray]:
    """The symbols 1..DEPTH back at each place; before the beginning of a text they are the end symbol."""
    out = []
    end = symbol[is_end][:1] if is_end.any() else np.zeros(1, np.uint8)
    over = np.zeros(len(symbol), bool)
    for d in range(1, DEPTH + 1):
        back = np.empty_like(symbol)
        back[:d], back[d:] = end, symbol[:-d]
        passed = np.ones(len(symbol), bool)
        passed[d:] = is_end[:-d]
        back[over] = end
        out.append(back)
        over |= passed
    return out


def sequence_codes(stream: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """At each place the symbols DEPTH back .. 0 back, BITS each, the newest lowest."""
    symbol = fold[stream]
    code = symbol.astype(np.int64)
    for d, back in enumerate(contexts(symbol, stream == END), 1):
        code |= back.astype(np.int64) << (BITS * d)
    return code


def _combine(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([n for _, n in parts]), len(value)).astype(np.int64)


def byte_fold(train: DataFrame) -> np.ndarray:
    """Symbols of the bytes, by frequency in the training rows (256 counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for rb in row_slices(batches):
            total += np.bincount(LOWER[utf8(rb.column("text"))[0]], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    counts = {r["byte"]: r["n"] for r in train.mapInArrow(run, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect()}
    usable = [b for b in range(256) if NON_SPACE[b] or b == 0x20]
    top = sorted(usable, key=lambda b: (-counts.get(b, 0) if b != 0x20 else -math.inf, b))[: OTHER - 1]
    fold = np.full(256, OTHER, np.uint8)
    fold[top] = np.arange(1, len(top) + 1)
    fold[END] = 0
    return fold


def corpus_counts(spark: SparkSession, train: DataFrame, fold: np.ndarray) -> DataFrame:
    """(kind, code, n): counts of words (kind 0, hashes), symbol sequences (1) and documents (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        n_docs = 0

        def passed_on(kind: int) -> pa.RecordBatch:
            value, n = _combine(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind, np.int32)), pa.array(value), pa.array(n)], ["kind", "code", "n"])

        for rb in row_slices(batches):
            n_docs += rb.num_rows
            data, offsets = utf8(rb.column("text"))
            low = LOWER[data]
            h = word_hashes(low, words(low, offsets, NON_SPACE)).view(np.int64)
            for kind, codes in ((0, h), (1, sequence_codes(symbol_stream(rb)[0], fold))):
                held[kind].append(np.unique(codes, return_counts=True))
                if len(held[kind]) > 1 and sum(len(v) for v, _ in held[kind]) > HELD:
                    held[kind] = [_combine(held[kind])]
                    if len(held[kind][0][0]) > HELD // 2:
                        yield passed_on(kind)
        for kind in (0, 1):
            if held[kind]:
                yield passed_on(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0]), pa.array([n_docs])], ["kind", "code", "n"])

    return stage(spark, train.mapInArrow(run, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n")), "lm-counts")


def _top(df: DataFrame, by: str, most: int) -> DataFrame:
    """About the ``most`` rows with the largest ``by`` (positive), never more: whole steps of a logarithmic scale."""
    step = F.floor(F.log2(by) * 16)
    sizes = {r["step"]: r["k"] for r in df.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()}
    total, least = 0, None
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        least = s
    return df.filter(step >= least) if least is not None else df.limit(0)


def _context_mask(d: str) -> Column:
    return F.element_at(F.array(*map(F.lit, CONTEXT_MASKS)), F.col(d) + 1)


def grow_tree(spark: SparkSession, grams: DataFrame, fold: np.ndarray) -> tuple[Tree, DataFrame]:
    """The broadcast states from (code, n) of full-length sequences, and a table (d, ctx, total, kinds, seen) of all other kept contexts."""
    levels = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col("code").bitwiseAND(MASKS[d]).alias("g")) for d in range(DEPTH + 1))))
    level = grams.select(levels.alias("x"), "n").groupBy("x.d", "x.g").agg(F.sum("n").alias("n")).withColumn("ctx", F.shiftright("g", BITS))
    own = level.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("d", "ctx")))
    own = stage(spark, own, "lm-levels")
    masks = F.element_at(F.array(*map(F.lit, [0, *MASKS])), F.col("d") + 1)
    shorter = own.select((F.col("d") + 1).alias("d"), F.col("g").alias("up"), F.col("p").alias("q"))
    tested = own.filter("d > 0").withColumn("up", F.col("g").bitwiseAND(masks)).join(shorter, ["d", "up"])
    gains = tested.groupBy("d", "ctx").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).alias("gain")).filter(F.col("gain") >= MIN_GAIN)
    gains = stage(spark, gains, "lm-gains")

    def closed(kept: DataFrame) -> DataFrame:
        return kept.select("ctx", F.explode(F.expr("sequence(0, d)")).alias("d")).select("d", F.col("ctx").bitwiseAND(_context_mask("d")).alias("ctx")).unionByName(root).distinct()

    root = spark.createDataFrame([(0, 0)], "d int, ctx bigint")
    symbol = F.col("g").bitwiseAND(SYMBOLS - 1).alias("s")
    # bounded by (DEPTH + 1) * HEAD_STATES contexts of SYMBOLS counts
    head = closed(_top(gains, "gain", HEAD_STATES))
    rows = own.join(head, ["d", "ctx"]).select("d", "ctx", symbol, "n").toArrow()
    rest = own.join(closed(gains).join(head, ["d", "ctx"], "left_anti"), ["d", "ctx"]).select("d", "ctx", symbol, "n")
    # at most SYMBOLS entries a context
    rest = rest.groupBy("d", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("seen"))
    return tables_of(*(rows.column(c).to_numpy() for c in ("d", "ctx", "s", "n")), fold), stage(spark, rest, "lm-rest")


def bitmap_of(rest: DataFrame) -> np.ndarray:
    """Bits of the contexts in ``rest``, by their key modulo BITMAP; 8 MB at most, however many there are."""
    bit = F.pmod(F.shiftleft(F.col("d").cast("bigint"), 48).bitwiseOR(F.col("ctx")), F.lit(BITMAP).cast("bigint"))
    cells = rest.select(bit.alias("bit")).groupBy(F.expr("bit div 32").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 32 + 1, np.uint32)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out


def distinct_codes(rows: DataFrame, fold: np.ndarray) -> DataFrame:
    """Sequence codes of the rows, each at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for rb in row_slices(batches):
            held = np.union1d(held, sequence_codes(symbol_stream(rb)[0], fold))
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held)], ["code"])
                held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["code"])

    return rows.mapInArrow(run, "code bigint")


def corrections(spark: SparkSession, codes: DataFrame, tree: Tree, bitmap: np.ndarray, rest: DataFrame) -> DataFrame:
    """(code, delta): what the contexts of ``rest`` add to the score of a sequence from its broadcast state."""
    shared = spark.sparkContext.broadcast((tree, bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bitmap = shared.value
        for rb in batches:
            code = rb.column("code").to_numpy()
            logp, depth = score_codes(tree, code)
            at = np.flatnonzero(maybe_beyond(bitmap, code, depth))
            yield pa.RecordBatch.from_arrays([pa.array(code[at]), pa.array(depth[at].astype(np.int32)), pa.array(logp[at].astype(np.float64))], ["code", "h", "logp"])

    placed = codes.distinct().mapInArrow(run, "code bigint, h int, logp double")
    longer = placed.select("code", "logp", F.explode(F.sequence(F.col("h") + 1, F.lit(DEPTH))).alias("d"))
    longer = longer.withColumn("ctx", F.shiftright("code", BITS).bitwiseAND(_context_mask("d"))).withColumn("s", F.col("code").bitwiseAND(SYMBOLS - 1))
    count = F.coalesce(F.try_element_at("seen", F.col("s")), F.lit(0).cast("bigint")).alias("n")
    # suffixes are kept with a context, so the depths found go on from h without a gap
    step = F.struct("d", count, "kinds", "total")
    own = longer.join(rest, ["d", "ctx"]).groupBy("code").agg(F.first("logp").alias("logp"), F.sort_array(F.collect_list(step)).alias("steps"))
    other = F.when(F.col("code").bitwiseAND(SYMBOLS - 1) == OTHER, F.lit(256.0 - (OTHER - 1))).otherwise(F.lit(1.0))
    p = F.aggregate("steps", F.pow(F.lit(10.0), "logp") * other, lambda p, x: (x["n"] + x["kinds"] * p) / (x["total"] + x["kinds"]))
    return stage(spark, own.select("code", (F.log10(p / other) - F.col("logp")).alias("delta")), "lm-corrections")


def tables_of(d: np.ndarray, ctx: np.ndarray, s: np.ndarray, n: np.ndarray, fold: np.ndarray) -> Tree:
    """Child and probability tables, shorter contexts first."""
    key = (d.astype(np.int64) << 48) | ctx
    states = np.unique(np.r_[0, key])
    at = np.searchsorted(states, key)
    count = np.zeros((len(states), SYMBOLS), np.float32)
    np.add.at(count, (at, s.astype(np.int64)), n)
    depth, context = states >> 48, states & ((1 << 48) - 1)
    child = np.zeros(len(states) * SYMBOLS, np.int32)
    p = np.full((len(states), SYMBOLS), 1.0 / SYMBOLS, np.float32)
    for level in range(DEPTH + 1):
        here = np.flatnonzero(depth == level)
        if not len(here):
            break
        lower = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
        if level:
            parent = np.searchsorted(states, ((level - 1) << 48) | (context[here] & ((1 << (BITS * (level - 1))) - 1)))
            child[parent * SYMBOLS + (context[here] >> (BITS * (level - 1)))] = here
            lower = p[parent]
        kinds = np.maximum((count[here] > 0).sum(1, keepdims=True), 1)
        p[here] = (count[here] + kinds * lower) / (count[here].sum(1, keepdims=True) + kinds)
    logp = np.log10(p, out=p)
    logp[:, OTHER] -= math.log10(256 - (OTHER - 1))
    return Tree(fold, child, logp.ravel())


def score_codes(tree: Tree, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each sequence's symbol given the longest broadcast suffix before it, and the length of that suffix."""
    state = np.zeros(len(code), np.int32)
    live = np.ones(len(code), bool)
    depth = np.zeros(len(code), np.int8)
    for d in range(1, DEPTH + 1):
        nxt = tree.child[state * SYMBOLS + ((code >> (BITS * d)) & (SYMBOLS - 1))]
        live &= nxt > 0
        depth += live
        state = np.where(live, nxt, state)
    return tree.logp[state * SYMBOLS + (code & (SYMBOLS - 1))], depth


def maybe_beyond(bitmap: np.ndarray, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether the context one longer than the broadcast one may be in the table."""
    longer = np.minimum(depth.astype(np.int64) + 1, DEPTH)
    bit = ((longer << 48) | ((code >> BITS) & np.array(CONTEXT_MASKS)[longer])) % BITMAP
    return (depth < DEPTH) & ((bitmap[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 > 0)


def per_row(code: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Per row the distinct codes at the places ``at``, and their counts."""
    row = np.searchsorted(first, at, side="right") - 1
    one, n = np.unique((row << (BITS * (DEPTH + 1))) | code[at], return_counts=True)
    offsets = pa.array(np.searchsorted(one >> (BITS * (DEPTH + 1)), np.arange(len(first))).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (one & MASKS[DEPTH], n.astype(np.int64))]


def score(spark: SparkSession, docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row; the model learns from the rows that the SQL predicate ``held_out`` (over doc_id) does not select."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", F.expr(held_out))
    train = picked.filter("not held_out").select("text")
    fold = byte_fold(train)
    counts = corpus_counts(spark, train, fold)
    tree, rest = grow_tree(spark, counts.filter("kind = 1").select("code", "n"), fold)
    vocabulary = counts.filter("kind = 0").select(F.col("code").alias("h"), "n")
    distinct, n_words = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs = counts.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = n_words + n_docs
    log_all = math.log10(total + distinct + (n_docs > 0) + 1)

    head = _top(vocabulary, "n", HEAD_WORDS).toArrow()
    known, count = head.column("h").to_numpy(), head.column("n").to_numpy()
    order = np.argsort(known)
    bitmap = bitmap_of(rest)
    codes = counts.filter("kind = 1").select("code").unionByName(distinct_codes(picked.filter("held_out is null or held_out").select("text"), fold))
    delta = corrections(spark, codes, tree, bitmap, rest)
    joined = delta.count() > DELTAS
    gained = delta.limit(0 if joined else DELTAS).toArrow()
    by_code = np.argsort(gained.column("code").to_numpy())
    gain = gained.column("code").to_numpy()[by_code], gained.column("delta").to_numpy().astype(np.float32)[by_code]
    shared = spark.sparkContext.broadcast((tree, known[order], count[order], bitmap, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, count, bitmap, (gaining, gain) = shared.value
        value = np.log10(count + 1.0)
        for rb in row_slices(batches):
            data, offsets = utf8(rb.column("text"))
            low = LOWER[data]
            w = words(low, offsets, NON_SPACE)
            h = word_hashes(low, w).view(np.int64)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            sums = np.concatenate([[0.0], np.cumsum(np.where(hit, value[at], 0.0) if len(known) else np.zeros(len(h)))])
            hits = np.concatenate([[0], np.cumsum(hit)])
            rare = [h[a:b][~hit[a:b]] for a, b in zip(w.first.tolist(), w.first[1:].tolist())]
            stream, first, _ = symbol_stream(rb)
            code = sequence_codes(stream, tree.fold)
            logp, depth = score_codes(tree, code)
            far = np.flatnonzero(maybe_beyond(bitmap, code, depth))
            if len(gaining):
                at = np.minimum(np.searchsorted(gaining, code[far]), len(gaining) - 1)
                logp[far] += np.where(gaining[at] == code[far], gain[at], 0)
            each = np.add.reduceat(logp.astype(np.float64), first[:-1]) if rb.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), rb.column("held_out"), pa.array(w.per_row + 1, pa.int64()), pa.array(np.diff(hits[w.first]), pa.int64()),
                 pa.array(np.diff(sums[w.first])), pa.array(each), pa.array(rare, pa.list_(pa.int64())),
                 *per_row(code, far if joined else far[:0], first)],
                ["doc_id", "held_out", "n_tokens", "head_known", "head_sum", "score", "rare", "code", "n"],
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    first = picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_sum double, score double, rare array<bigint>, code array<bigint>, n array<bigint>")
    rows = stage(spark, first.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    # words outside the head: none of them is frequent, so none makes a hot key
    looked = rows.select("row", F.explode("rare").alias("h")).join(vocabulary, "h")
    tail = looked.groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("n") + 1)).alias("tail_sum"))
    far = rows.filter(F.size("code") > 0).select("row", F.inline(F.arrays_zip("code", "n")))
    deeper = far.join(delta, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("delta")).alias("deeper"))
    zero = F.lit(0).cast("bigint")
    return rows.drop("rare", "code", "n").join(tail, "row", "left").join(deeper, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", zero) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(math.log10(n_docs + 1)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"),
    )
