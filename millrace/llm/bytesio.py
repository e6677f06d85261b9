"""Arrow text columns as byte arrays, and vectorised hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw, bounds


def groups_of_rows(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes; a longer row stands alone."""
    n, first = len(bounds) - 1, 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling; kept up to a few megabytes."""
    known = _POWERS.get(int(base))
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.ones(max(n, 1), np.uint64)
    have, top = 1, int(base)
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(top)
        have += take
        top = top * top & _MASK
    if n <= 1 << 22:
        _POWERS[int(base)] = out
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for each span, the same wherever equal bytes stand."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=total[1:])
    value = (total[ends] - total[starts]) * powers(BASE_INVERSE, len(raw) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_table(*values: int) -> np.ndarray:
    """A lookup over all byte values, true at the given ones."""
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def word_spans(raw: np.ndarray, bounds: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``between`` (a table) that stay in a row, and their number in each row."""
    dark = ~between[raw]
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(raw))]
    first[inner] |= dark[inner]
    last[inner - 1] |= dark[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each ``size`` consecutive values."""
    n = max(len(values) - size + 1, 0)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix((total[size:] - total[:n]) * powers(BASE_INVERSE, n + 1)[:n]) if n else np.zeros(0, np.uint64)
