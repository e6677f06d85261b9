"""Word shingles of whole texts as 64-bit hashes.

A-Z count as a-z, words are runs of bytes other than space and 0x09 to 0x0D, and a text of fewer
words than a shingle has one shingle of all of them. A text without words has none.
"""

from __future__ import annotations

import numpy as np

from .bytesio import mix, span_hashes

WORDS = 5


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive rows, their byte offsets, and the words of each row."""
    low = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    dark = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(raw))]
    first[inner] |= dark[inner]
    last[inner - 1] |= dark[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(low, starts, ends), starts, np.diff(np.searchsorted(starts, bounds))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and the shingles of each row (repeats included)."""
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    factors = [np.uint64(f) for f in _FACTORS[:size]]
    if len(words) >= size:
        full = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            full += words[k : k + len(full)] * factors[k]
        full = mix(full)
    else:
        full = np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    begins = ends - counts
    at = np.repeat(begins - (np.cumsum(per_row) - per_row), per_row) + np.arange(int(per_row.sum()))
    short = (counts > 0) & (counts < size)
    out = np.zeros(len(at), np.uint64)
    long_rows = np.repeat(~short, per_row)
    out[long_rows] = full[at[long_rows]]
    if short.any():
        places = np.flatnonzero(~long_rows)
        for place, b, n in zip(places, begins[short], counts[short], strict=True):
            value = np.zeros(1, np.uint64)
            for k in range(n):
                value += words[b + k : b + k + 1] * factors[k]
            out[place] = mix(value + np.uint64(n))[0]
    return out, per_row


_FACTORS = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def shingle_sets(shingles: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, and how many there are."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    order = np.lexsort((shingles, row))
    s, r = shingles[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], np.bincount(r[new], minlength=len(per_row))
