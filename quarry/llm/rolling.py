"""Vectorised word and window hashes of whole texts in Arrow batches.

A word's hash is a polynomial over its bytes (random 64-bit value per byte, odd
base, modulo 2**64), read off prefix sums; a window's is a Rabin-Karp polynomial
over mixed word hashes. Everything is numpy over the bytes of a slice at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd, 3 modulo 8, so that powers stay apart as far as modulo 2**64 allows.
BASE = 0x9E3779B97F4A7C13
STEP = 0xD6E8FEB86659FD93
assert BASE % 8 == 3 and STEP % 8 == 3

#: Two independent tables: equal words agree in both, different ones in both with probability 2**-128.
_TABLES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n."""
    if len(_powers["up"]) <= n:
        size = 1 << int(n + 1).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.empty(size, U)
            out[0] = 1
            filled, factor = 1, base
            while filled < size:  # doubling: base**filled times what is there
                out[filled : 2 * filled] = out[:filled] * U(factor)
                filled, factor = 2 * filled, factor * factor % (1 << 64)
            _powers[name] = out
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a slice of texts: mixed hashes in order, and each text's first word."""

    hashes: np.ndarray
    first: np.ndarray  # of each text, and the end: len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, second: bool = False) -> Words:
    """Hashes of the words (runs without blank or U+0009..U+000D) of every text; null: none.

    ``second`` takes the other table, for a hash independent of the first.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    if end == begin:
        return Words(np.zeros(0, U), np.zeros(len(texts) + 1, np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end]
    edges = offsets - begin
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = edges[1:-1]
    inner = inner[inner < len(data)]
    start[inner] |= word[inner]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    inner = inner[inner > 0]
    stop[inner - 1] |= word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _grow(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLES[int(second)][data] * up[: len(data)], out=sums[1:])
    return Words(mix((sums[e] - sums[s]) * down[s]), np.searchsorted(s, edges))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that starts at each word, and whether it lies in one text."""
    n = max(0, len(words.hashes) - size + 1)
    h = np.zeros(n, U)
    for k in range(size):
        h *= U(STEP)
        h += words.hashes[k : k + n]
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    return mix(h), text[:n] == text[size - 1 : size - 1 + n]


def sequences(words: Words) -> np.ndarray:
    """Hash of every text's whole word sequence."""
    n = len(words.hashes)
    up, down = _grow(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(words.hashes + U(STEP)) * up[:n], out=sums[1:])
    at = words.first
    return mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + words.counts.astype(U))
