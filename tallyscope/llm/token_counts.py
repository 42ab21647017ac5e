"""Token counts by rank-synchronous array merging.

A batch of distinct pre-tokens is held as one flat symbol array with sequence starts.
Each round looks up the rank of every adjacent pair, takes the lowest rank of each
sequence, merges all its non-overlapping occurrences in all sequences at once, and
drops the sequences that have no mergeable pair left; their surviving symbols are the
count. A very long pre-token has many rounds that touch few of its symbols, so it is merged by
itself: places wait under their rank, and a round looks only at the places of its rank and
their neighbours. Counts of pre-tokens are kept in a bounded table per Python worker.

Null text counts as empty (0 bytes, 0 tokens). Only ``id_col`` and ``text_col`` are read,
so further columns, whatever their names, and repeated rows do not matter: one row out
per row in.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.ragged import row_slices, utf8

NO_RANK = np.iinfo(np.int64).max
TABLE_WORDS = 1_000_000
#: Bytes from which on a pre-token is merged by itself, and up to which counts are kept in the table.
LONG, KEPT = 512, 64
SPACES = r"\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class MergeCounter:
    """Counts the symbols that survive byte-pair merging, for many pre-tokens at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        code = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int64), made[order]
        self.pair, self.product = code, made  # by rank
        shown = byte_alphabet()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.final = np.array([vocab[c + suffix] for c in shown], np.int64)

    def ranks_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        return np.where(self.code[at] == codes, self.rank[at], NO_RANK)

    def long_count(self, token: str) -> int:
        """Symbols left of one pre-token, by worklists of places under each rank."""
        data = np.frombuffer(token.encode(), np.uint8)
        n = len(data)
        symbol = np.append(self.inner[data], -1)  # the place after the end matches nothing
        symbol[n - 1] = self.final[data[-1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(places: np.ndarray) -> None:
            rank = self.ranks_of((symbol[places] << 32) | symbol[after[places]])
            places, rank = places[rank != NO_RANK], rank[rank != NO_RANK]
            by = np.argsort(rank, kind="stable")
            places, rank = places[by], rank[by]
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rank)]):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(places[a:b])

        wait(np.arange(n - 1))
        while order:
            r = heapq.heappop(order)
            places = np.unique(np.concatenate(waiting.pop(r)))
            first, second = self.pair[r] >> 32, self.pair[r] & 0xFFFFFFFF
            places = places[alive[places] & (symbol[places] == first) & (symbol[after[places]] == second)]
            if not len(places):
                continue
            if first == second:  # of a run every second pair, from the left
                fresh = np.r_[True, after[places[:-1]] != places[1:]]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            gone = after[places]
            symbol[places] = self.product[r]
            alive[gone] = False
            after[places] = after[gone]
            before[after[places]] = places
            left = before[places]
            wait(np.unique(np.r_[left[left >= 0], places[after[places] < n]]))
        return int(alive[:n].sum())

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token."""
        data, offsets = utf8(pa.array(tokens, pa.large_string()))
        symbols = self.inner[data]
        symbols[offsets[1:] - 1] = self.final[data[offsets[1:] - 1]]
        starts, owner = offsets[:-1], np.arange(len(tokens))
        out = np.zeros(len(tokens), np.int64)
        while len(owner):
            n = len(symbols)
            size = np.diff(np.append(starts, n))
            codes = (symbols << 32) | np.append(symbols[1:], 0)
            codes[starts + size - 1] = -1
            at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
            ranks = np.where(self.code[at] == codes, self.rank[at], NO_RANK)
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == NO_RANK
            out[owner[done]] = size[done]
            seq = np.repeat(np.arange(len(owner)), size)
            hit = np.flatnonzero((ranks == lowest[seq]) & ~done[seq])
            # of a run of adjacent hits (a a a) every second one merges, from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = (hit[1:] != hit[:-1] + 1) | (seq[hit[1:]] != seq[hit[:-1]])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            stay = ~done[seq]
            stay[hit + 1] = False
            symbols, seq = symbols[stay], seq[stay]
            left = np.flatnonzero(~done)
            owner = owner[left]
            starts = np.searchsorted(seq, left)
        return out


class WordPieces:
    """Pre-tokens of the lower-casing vocabulary and their counts, with a bounded table."""

    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
    ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")

    def __init__(self, path: str) -> None:
        self.merges = MergeCounter(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.has_special = special
        self.table: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special strings (each is one token)."""
        if any(s in text for s in self.has_special):
            parts = self.special.split(text)
            return [t for p in parts for t in self.pre_tokens(p)[0]], len(parts) - 1
        if text.isascii():
            return self.ASCII.findall(text.lower()), 0
        return self.ANY.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()), 0

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        new = list(set().union(*(p for p, _ in split)) - self.table.keys())
        large = [t for t in new if len(t) > KEPT]
        for t in large:
            if len(t) > LONG:
                self.table[t] = self.merges.long_count(t)
        new = [t for t in new if len(t) <= LONG]
        if new:
            self.table.update(zip(new, self.merges.counts(new).tolist()))
        found = [sum(map(self.table.__getitem__, p)) + extra for p, extra in split]
        for t in large:
            del self.table[t]
        return found


_workers: dict[str, WordPieces] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = WordPieces(path)
        for rb in row_slices(batches):
            n_bytes = np.diff(utf8(rb.column("text"))[1])
            n = np.array(_workers[path].count([t or "" for t in rb.column("text").to_pylist()]), np.int64)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
