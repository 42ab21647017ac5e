"""Periodic runs: stretches of words that repeat themselves at least four times, found by block convolution.

The words of a slice of documents become one sequence of exact word codes, with a separator of
its own after every document. At scale B = 1, 2, 4, ... the sequence is cut into blocks of B
words. A run of period q, B <= q < 2B, of four periods holds a whole block that occurs again q
words on, so each block is held against the B distances B..2B-1: the sum of squared differences
of codes is zero where it occurs, and all the sums of a block come from one number-theoretic
transform modulo a prime above every possible sum. A zero names a distance, from which exact
comparison extends to both sides. Blocks need no transform if one of their words does not come
again within 2B-1 words, or if they and their window lie in a run already found, as all their
distances are then multiples of its period.

Codes are reduced to keep sums under the prime; equal words keep equal codes, so no occurrence
is missed, and a false zero falls in an exact comparison. Blocks of more than MAX_PATTERN words
look for their first MAX_PATTERN words.

Null and blank texts have no runs. A text is handled whole in one task. One row out per row in;
ids are not looked at, so null and repeated ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.ragged import NON_SPACE, row_slices, utf8, words
from tallyscope.llm.tables import wider

#: An NTT prime (119 * 2**23 + 1) and a primitive root of it.
PRIME, ROOT = 998244353, 3
#: Words of a block that are looked for, and transform cells at once.
MAX_PATTERN, CELLS = 1 << 20, 1 << 19
#: Steps of the extension done for all seeds together; longer ones go on one by one.
SHARED_STEPS = 16

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, PRIME))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step % np.uint64(PRIME)
        have += more
    return out


def _transform(x: np.ndarray) -> np.ndarray:
    """Transform along axis 0 (a power of two), results in bit-reversed order."""
    p = np.uint64(PRIME)
    n, m = x.shape
    half = n // 2
    while half:
        w = _powers(pow(ROOT, (PRIME - 1) // (2 * half), PRIME), half)[None, :, None]
        v = x.reshape(n // (2 * half), 2, half, m)
        a, b = v[:, 0], v[:, 1]
        x = np.stack([(a + b) % p, (a + p - b) * w % p], 1).reshape(n, m)
        half //= 2
    return x


def _inverse(x: np.ndarray) -> np.ndarray:
    """Inverse of ``_transform``: bit-reversed order in, natural order out."""
    p = np.uint64(PRIME)
    n, m = x.shape
    half = 1
    while half < n:
        w = _powers(pow(ROOT, PRIME - 1 - (PRIME - 1) // (2 * half), PRIME), half)[None, :, None]
        v = x.reshape(n // (2 * half), 2, half, m)
        a, b = v[:, 0], v[:, 1] * w % p
        x = np.stack([(a + b) % p, (a + p - b) % p], 1).reshape(n, m)
        half *= 2
    return x * np.uint64(pow(n, -1, PRIME)) % p


def mismatch_sums(patterns: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each pattern (row) and its window at offsets 0..len(pattern)-1.

    ``windows`` rows are twice as long as the patterns. Exact while the sums stay under PRIME.
    """
    size = patterns.shape[1]
    flipped = np.zeros((2 * size, len(patterns)), np.uint64)
    flipped[0] = patterns[:, 0]
    flipped[-1 : -size : -1] = patterns[:, 1:].T  # index -i holds element i: a correlation
    product = _inverse(_transform(flipped) * _transform(np.ascontiguousarray(windows.T).astype(np.uint64)) % np.uint64(PRIME))
    cross = product[:size].T.astype(np.int64)
    squares = np.cumsum(np.pad(windows.astype(np.int64) ** 2, ((0, 0), (1, 0))), 1)
    total = (patterns.astype(np.int64) ** 2).sum(1)[:, None] + squares[:, size : 2 * size] - squares[:, :size]
    return (total - 2 * cross) % PRIME


class _Found:
    """Runs found so far; tells whether one of them covers a stretch."""

    def __init__(self) -> None:
        self.runs: dict[tuple[int, int], int] = {}
        self.start, self.reach = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
            if q < self.runs.get((s, e), q + 1):
                self.runs[s, e] = q
        ends = sorted(self.runs)
        self.start = np.array([s for s, _ in ends], np.int64)
        self.reach = np.maximum.accumulate(np.array([e for _, e in ends], np.int64)) if ends else self.start

    def covers(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        k = np.searchsorted(self.start, start, "right")
        return (k > 0) & (self.reach[np.maximum(k, 1) - 1] >= end)


def _occurrences(seq: np.ndarray, starts: np.ndarray, scale: int, found: _Found) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) where a block of ``scale`` words occurs again scale..2*scale-1 words on.

    Those inside a run already found are left out: their distances are multiples of its period.
    """
    size = min(scale, MAX_PATTERN)
    codes = seq % int(((PRIME - 1) // size) ** 0.5)
    codes = np.pad(codes, (0, 3 * scale))
    at, distance = [], []
    batch = max(1, CELLS // (2 * size))
    inner = np.arange(size)
    for a in range(0, len(starts), batch):
        some = starts[a : a + batch]
        patterns = codes[some[:, None] + inner]
        for first in range(scale, 2 * scale, size):
            windows = codes[some[:, None] + first + np.arange(2 * size)]
            row, offset = np.nonzero(mismatch_sums(patterns, windows) == 0)
            row, offset = some[row], first + offset
            fresh = (row + offset + size <= len(seq)) & ~found.covers(row, row + offset + scale)
            row, offset = row[fresh], offset[fresh]
            for b in range(0, len(row), batch):  # a zero of reduced codes may be false
                i, d = row[b : b + batch], offset[b : b + batch]
                same = (seq[i[:, None] + inner] == seq[(i + d)[:, None] + inner]).all(1)
                at.append(i[same])
                distance.append(d[same])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(distance)


def _matches(seq: np.ndarray, i: int, j: int, step: int) -> int:
    """Number of equal words from i and j on, towards ``step`` (1 or -1)."""
    done, chunk = 0, 64
    room = (len(seq) - max(i, j)) if step > 0 else min(i, j) + 1
    while done < room:
        k = min(chunk, room - done)
        if step > 0:
            same = seq[i + done : i + done + k] == seq[j + done : j + done + k]
        else:
            same = (seq[i - done - k + 1 : i - done + 1] == seq[j - done - k + 1 : j - done + 1])[::-1]
        miss = int(np.argmin(same))
        if not same[miss]:
            return done + miss
        done, chunk = done + k, 4 * chunk
    return done


def _extended(seq: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """For each seed the number of equal words from ``at`` and ``at + distance`` on, towards ``step``."""
    count = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for _ in range(SHARED_STEPS):
        i = at[live] + step * count[live]
        j = i + distance[live]
        inside = (i >= 0) & (j < len(seq))
        live, i, j = live[inside], i[inside], j[inside]
        same = seq[i] == seq[j]
        live = live[same]
        count[live] += 1
        if not len(live):
            return count
    for k in live.tolist():
        i = int(at[k] + step * count[k])
        if i >= 0:
            count[k] += _matches(seq, i, i + int(distance[k]), step)
    return count


def runs_of(seq: np.ndarray, longest: int, least_words: int = 6, least_repeats: int = 4) -> np.ndarray:
    """Rows (start, end, period) of all runs of the codes ``seq``, by start, then period.

    ``longest``: words of the longest document; no run is longer. ``least_repeats`` is 4 at least.
    """
    if least_repeats < 4:
        raise ValueError("blocks find runs of four periods or more")
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    gap = np.full(n, np.iinfo(np.int64).max)
    again = seq[order[1:]] == seq[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    found, scale, widest = _Found(), 1, gap
    while least_repeats * scale <= longest and len(widest):
        starts = np.flatnonzero(widest < 2 * scale) * scale
        starts = starts[~found.covers(starts, starts + 3 * scale - 1)]
        if len(starts):
            at, distance = _occurrences(seq, starts, scale, found)
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            if scale <= MAX_PATTERN and len(at):
                # whole blocks are equal, so the next block of the same stretch adds nothing
                head = np.r_[True, (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + scale)]
                at, distance = at[head], distance[head]
            right = _extended(seq, at, distance, 1)
            left = _extended(seq, at - 1, distance, -1)
            length = left + right + distance
            good = length >= np.maximum(least_words, least_repeats * distance)
            found.add((at - left)[good], (at + right + distance)[good], distance[good])
        even = widest[: len(widest) // 2 * 2]
        widest = np.maximum(even[::2], even[1::2])
        scale *= 2
    rows = np.array([(s, e, q) for (s, e), q in found.runs.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, equal for equal words, and the index of each row's first word."""
    w = words(data, offsets, NON_SPACE)
    packed = data[NON_SPACE[data]]
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), w.first


def batch_runs(data: np.ndarray, offsets: np.ndarray, **least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per row; rows (start, end, period) of the runs, words numbered within their row; the row of each run."""
    codes, first = word_codes(data, offsets)
    per_row = np.diff(first)
    rows = len(per_row)
    seq = np.empty(len(codes) + rows, np.int64)
    begin = first[:-1] + np.arange(rows)  # where rows begin in the sequence
    ends = begin + per_row
    seq[ends] = len(codes) + np.arange(rows)
    inside = np.ones(len(seq), bool)
    inside[ends] = False
    seq[inside] = codes
    runs = runs_of(seq, int(per_row.max(initial=0)), **least)
    row = np.searchsorted(begin, runs[:, 0], "right") - 1
    runs[:, :2] -= begin[row][:, None]
    return per_row, runs, row


def find_runs(docs: DataFrame, column: str = "text", least_words: int = 6, least_repeats: int = 4) -> DataFrame:
    """All columns of ``docs`` and n_words, runs (start, length, period by start, then period), collapsed_text.

    ``collapsed_text`` holds the words joined by one space, without those that a run contains
    after its first period. Columns that have these names are replaced.
    """
    new = ["n_words", "runs", "collapsed_text"]
    rows = docs.drop(*new)
    names = rows.columns
    schema = wider(rows.schema, f"n_words bigint, runs {RUN}, collapsed_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches, column):
            data, offsets = utf8(rb.column(column))
            per_row, runs, row = batch_runs(data, offsets, least_words=least_words, least_repeats=least_repeats)
            raw = data.tobytes()
            cut = np.searchsorted(row, np.arange(rb.num_rows + 1))
            spans, texts = [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                kept = raw[a:b].split()
                own = runs[cut[i] : cut[i + 1]]
                spans.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
                if len(own):
                    edge = np.zeros(len(kept) + 1, np.int64)
                    np.add.at(edge, own[:, 0] + own[:, 2], 1)
                    np.add.at(edge, own[:, 1], -1)
                    kept = compress(kept, (np.cumsum(edge)[:-1] == 0).tolist())
                texts.append(b" ".join(kept).decode())
            cols = [pa.array(per_row.astype(np.int64)), pa.array(spans, _RUN_ARROW), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([rb.column(n) for n in names] + cols, [*names, *new])

    return rows.mapInArrow(run, schema)


#: The words of a text, and of one that repeats itself from word a on with period p (crc32 of the id decides).
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``; documents whose crc32(doc_id) ends in 0 repeat themselves from a word on."""
    h = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id as string) as binary))").alias("h"))
    split = h.select("doc_id", "text", F.expr("h div 10").alias("g"), F.expr(f"if(h % 10 = 0, {_WORDS}, array())").alias("w"))
    placed = split.selectExpr("doc_id", "text", "w", "g", "if(size(w) > 0, g % size(w), 0) as a")
    cycle = placed.selectExpr("doc_id", "text", "w", "a", "1 + (size(w) - a) div (3 + g % 8) as p")
    planted = "array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')"
    return cycle.selectExpr("doc_id", f"if(size(w) > 0, {planted}, text) as text")


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of a ``find_runs`` result: n_runs, the strongest run and the two digests."""
    better = "if(best is null or r.length * best.period > best.length * r.period, r, best)"
    best = found.withColumn("best", F.expr(
        "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (best, r) -> " + better + ")"))
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    return best.selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start as start", "best.length as length", "best.period as period",
        "1000 * best.length div best.period as exponent_milli", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed_text, 256) as collapsed_sha256")
