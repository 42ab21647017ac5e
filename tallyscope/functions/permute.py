"""Keyed bijections on 0..n-1: a uniformly mixed permutation per key, one index at a time.

Swap-or-not rounds: round r pairs x with (k_r - x) mod n and swaps the two if one bit of a hash of
the larger says so. Every round is its own inverse, so any index has its image without a sort, a
table or cycle walking, for every n. The keys are digits of md5(seed:p:r), and all steps are
64-bit integer arithmetic that any engine repeats (the Spark expression and numpy are below).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 16
#: 30- and 32-bit masks and the multipliers of the hash; products stay below 2**62.
LOW, WORD, FIRST, SECOND = (1 << 30) - 1, (1 << 32) - 1, 0x9E3779B1, 0x85EBCA6B


def keys(seed: int, p: int, n: int) -> tuple[list[int], list[int]]:
    """Pair sums (modulo ``n``) and hash offsets of the rounds of permutation ``p``."""
    digits = [hashlib.md5(f"{seed}:{p}:{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [int(d[:15], 16) % n for d in digits], [int(d[15:22], 16) for d in digits]


def key_arrays(seed: int, first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of permutations first..last-1, one row per round."""
    both = [keys(seed, p, n) for p in range(first, last)]
    return np.array([k for k, _ in both], np.int64).T, np.array([c for _, c in both], np.int64).T


def images(x: np.ndarray, pair: np.ndarray, offset: np.ndarray, n: int, inverse: bool = False) -> np.ndarray:
    """Images of the indexes ``x`` (rows) under each permutation (columns)."""
    if n <= 1 << 31:
        return _narrow_images(x, pair, offset, n, inverse)
    x = np.broadcast_to(np.asarray(x, np.int64)[:, None], (len(x), pair.shape[1]))
    for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        other = pair[r] - x
        other += n * (other < 0)
        h = ((np.maximum(x, other) + offset[r]) & LOW) * FIRST & WORD
        h ^= h >> 16
        h = (h & LOW) * SECOND & WORD
        x = np.where(h >> 17 & 1, other, x)
    return x


def _narrow_images(x: np.ndarray, pair: np.ndarray, offset: np.ndarray, n: int, inverse: bool) -> np.ndarray:
    """``images`` in 32-bit words: sums stay below 2**32, and a product's low word is all that a round reads."""
    word = np.uint32
    x = np.repeat(np.asarray(x).astype(word)[:, None], pair.shape[1], axis=1)
    pair, offset = pair.astype(word), offset.astype(word)
    other, h, held = np.empty_like(x), np.empty_like(x), np.empty_like(x)
    for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        np.subtract(pair[r], x, out=other)
        # what wrapped below 0 is larger than any index, and n brings it back
        np.minimum(other, np.add(other, word(n), out=held), out=other)
        np.add(np.maximum(x, other, out=h), offset[r], out=h)
        np.multiply(np.bitwise_and(h, word(LOW), out=h), word(FIRST), out=h)
        np.bitwise_xor(h, np.right_shift(h, word(16), out=held), out=h)
        np.multiply(np.bitwise_and(h, word(LOW), out=h), word(SECOND), out=h)
        # bit 17 in every bit
        swap = np.left_shift(h, word(14), out=h).view(np.int32)
        np.right_shift(swap, 31, out=swap)
        np.bitwise_xor(x, np.bitwise_and(np.bitwise_xor(other, x, out=other), h, out=other), out=x)
    return x.astype(np.int64)


def image(x: Column, rounds: Column, n: int) -> Column:
    """Image of index ``x``; ``rounds`` is an array of (k, c) structs, in reverse order for the inverse."""

    def step(at: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - at, F.lit(n).cast("bigint"))
        h = (F.greatest(at, other) + key["c"]).bitwiseAND(F.lit(LOW)) * F.lit(FIRST)
        h = h.bitwiseAND(F.lit(WORD))
        h = h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(LOW)) * F.lit(SECOND)
        return F.when(F.shiftright(h, 17).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("bigint"), step)


def rounds_literal(seed: int, p: int, n: int, inverse: bool = False) -> Column:
    """The keys of one permutation as an array literal."""
    pairs = list(zip(*keys(seed, p, n)))
    return F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(c).cast("bigint").alias("c")) for k, c in (reversed(pairs) if inverse else pairs)])
