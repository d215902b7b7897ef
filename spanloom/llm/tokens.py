"""Vectorised word hashing on Arrow string buffers.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters other than Latin-1 and general
punctuation; ASCII and Latin-1 letters are lowercased. Words never cross texts. All work is numpy over the UTF-8 bytes
in slices of about ``SLICE`` bytes (a longer text is its own slice), so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64

_word = np.zeros(256, bool)
for _c in range(256):
    _word[_c] = _c >= 0x80 or chr(_c).isalnum()
_punct = np.array([0x21 <= _c < 0x7F and not chr(_c).isalnum() for _c in range(256)])
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, U), dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def spans(b: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in ``b``, the lowercased bytes, and for each text the number of words before it (n + 1).

    ``punctuation``: maximal runs of other visible ASCII characters count as words too.
    """
    low, w = _lower[b], _word[b]
    high = np.flatnonzero(b >= 0xC2)
    if len(high):
        lead, after = b[high], b[np.minimum(high + 1, len(b) - 1)]
        c3 = high[(lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1
        low[c3] += 0x20
        c2 = high[lead == 0xC2]
        w[c2] = False
        w[np.minimum(c2 + 1, len(b) - 1)] = False
        e2 = high[((lead == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((lead == 0xE3) & (after == 0x80))]
        for k in range(3):
            w[np.minimum(e2 + k, len(b) - 1)] = False
    if punctuation:
        kind = w.astype(np.int8)
        kind[~w & _punct[b]] = 2
        w = kind > 0
        change = kind[1:] != kind[:-1]
    else:
        change = w[1:] != w[:-1]
    begin = w.copy()
    begin[1:] &= change
    cut = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(b))]
    begin[cut] |= w[cut]
    end = w.copy()
    end[:-1] &= change
    end[cut - 1] |= w[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, low, np.searchsorted(starts, offsets)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = low[np.repeat(starts, lens) + pos].astype(U)
    values += U(1)
    values *= _POW[pos & 0xFFFF]
    return mix(np.add.reduceat(values, first))


def word_hashes(column, punctuation: bool = False, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, offsets of the texts in them) for slices of ``column``."""
    data, offsets = buffers(column)
    for i, j in slices(offsets, most):
        b, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(b):
            yield i, np.zeros(0, U), np.zeros(j - i + 1, np.int64)
            continue
        starts, ends, low, of = spans(b, own, punctuation)
        yield i, hash_spans(low, starts, ends), of


def hash_words(words: list[str]) -> np.ndarray:
    """The hash of each of ``words`` as a text would give it (one word each)."""
    out = np.zeros(len(words), U)
    for i, h, of in word_hashes(pa.array(words, pa.large_string())):
        has = np.flatnonzero(np.diff(of) > 0)
        out[i + has] = h[of[:-1][has]]
    return out


def ngrams(h: np.ndarray, of: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, with their offsets; a text of 1 to n - 1 words has one, of all its words."""
    counts = np.diff(of)
    own = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_of = np.concatenate(([0], np.cumsum(own)))
    if not out_of[-1]:
        return np.zeros(0, U), out_of
    base = U((seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = np.concatenate((h, np.zeros(n, U)))
    whole = np.full(len(h), base, U)
    for k in range(n):
        whole = mix((whole ^ x[k : k + len(h)]) + U(k + 1))
    idx = np.arange(out_of[-1]) - np.repeat(out_of[:-1], own) + np.repeat(of[:-1], own)
    out = whole[idx]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        v = base
        for k in range(counts[d]):
            v = mix(np.array([(int(v ^ h[of[d] + k]) + k + 1) & 0xFFFFFFFFFFFFFFFF], U))[0]
        out[out_of[d]] = v
    return out, out_of
