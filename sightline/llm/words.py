"""Hashes of all words of a batch of texts at once.

A word's hash is a polynomial over a table of its bytes, taken for the whole
batch as one sum over each word; no word becomes a Python object. It needs about
30 bytes for each byte of text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(size: int, base: int = _GOLDEN) -> np.ndarray:
    """base**0 to base**(size - 1), modulo 2**64."""
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[bytes], mapped: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and each text's number of words.

    mapped: for each byte, the byte that counts for it; 32 (a space) ends a word.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    # a space after each text keeps words within it
    flat = np.frombuffer(b" ".join(texts).translate(mapped) + b" ", np.uint8)
    inside = np.zeros(len(flat) + 1, bool)
    np.not_equal(flat, 32, out=inside[1:])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    counts = np.diff(np.searchsorted(starts, np.append(0, np.cumsum(sizes + 1)))) if len(texts) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    table = _TABLE.copy()
    table[32] = 0
    # each byte's place in its word; spaces count 0, whatever their place
    flat = flat[starts[0] :]
    lengths = np.diff(np.append(starts, starts[0] + len(flat)))
    place = np.arange(len(flat), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), lengths)
    values = table[flat]
    values *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts - starts[0])), counts
