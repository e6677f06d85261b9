"""Runs of repeating words, by uniting suffix classes in order of falling LCP.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``least``
words and ``times`` periods long, that no neighbouring word extends. Documents stay whole in their
row and are worked where they lie, so nothing is shuffled.

1. A run of length n starts at a word whose suffix agrees with the one a period later on n - q words,
   which is at least least * (times - 1) / times. Only words at which as many words stand that stand
   again in the document are sorted.
2. Their suffixes are sorted by prefix doubling (ranks of pairs at growing offsets, settled ones
   leave), from that many words on, rounded down to a power of two; the kept ranks give the LCP of
   neighbours.
3. Neighbouring suffixes are united by falling LCP (Kruskal's order). A class is an interval of the
   suffix order and holds its word positions sorted; the smaller set goes into the larger.
   When two positions become neighbours in a set at LCP l and distance d <= l, the words from the first on
   have smallest period d for d + l words; the seeds that no word extends to the left are the runs.

Words are compared by 64-bit hashes. A task holds one piece of a batch or one document, and arrays
in proportion to it.

Defined cases: null, empty and blank texts have no words, no runs and an empty rest; repeated ids
are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesio import byte_table, groups_of_rows, span_hashes, text_bytes, window_hashes, word_spans

LEAST, TIMES = 24, 3
PIECE_BYTES = 4 << 20
BLANK = byte_table(32, *range(9, 14))
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``id``, ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that lie in a run behind its first period, joined by
    single spaces.
    """
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(_work(least, times), f"_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("_id", id)


def _work(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_bytes(batch.column("_text"))
            for first, last in groups_of_rows(bounds, PIECE_BYTES):
                part, inner = raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
                starts, ends, counts = word_spans(part, inner, BLANK)
                begin = np.concatenate([[0], np.cumsum(counts)])
                start, length, period = word_runs(span_hashes(part, starts, ends), begin, least, times)
                per_row = np.diff(np.searchsorted(start, begin))
                structs = pa.StructArray.from_arrays([pa.array(start - np.repeat(begin[:-1], per_row)), pa.array(length), pa.array(period)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), structs)
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(first, last - first), pa.array(counts, pa.int64()), lists, _joined(part, inner, starts, ends, begin, kept)],
                    ["_id", "n_words", "runs", "collapsed"],
                )

    return run


def _joined(raw: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by single spaces: every word but a row's first follows a blank."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    before = np.concatenate([[0], np.cumsum(kept)])
    first_kept = before[:-1] == np.repeat(before[begin[:-1]], np.diff(begin))
    blanks = starts[kept & ~first_kept] - 1
    out = raw.copy()
    out[blanks] = 32
    take[blanks] = True
    offsets = np.concatenate([[0], np.cumsum(take)])[bounds]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[take])).cast(pa.string())


def word_runs(words: np.ndarray, begin: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in all words), length and period of the runs of rows that lie between ``begin``, by start and period."""
    base = 1 << max(1, -(-least * (times - 1) // times)).bit_length() - 1
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    stop = begin[1:][row]
    at, order, levels = _suffixes(words, row, stop, base)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    edge = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    lcp = _lcp(words, stop, at, at[order[edge]], at[order[edge + 1]], levels, base)
    falling = np.argsort(-lcp, kind="stable")
    i, d, l = _unite(at[order].tolist(), edge[falling].tolist(), lcp[falling].tolist(), least, times)
    free = (i == begin[row[i]]) | (words[i - 1] != words[i + d - 1])
    i, d, l = i[free], d[free], l[free]
    by = np.lexsort((d, i))
    return i[by], (d + l)[by], d[by]


def _suffixes(words: np.ndarray, row: np.ndarray, stop: np.ndarray, base: int):
    """Positions whose next ``base`` words stand again in their row and those ``base`` later, their suffix order, and ranks at base, 2 base, 4 base, ..."""
    near = window_hashes(words, base)
    whole = np.flatnonzero(np.arange(len(near)) + base <= stop[: len(near)])
    by = np.lexsort((near[whole], row[whole]))
    h, r = near[whole][by], row[whole][by]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(words) + 1, bool)
    twice[whole[by][1:][same]] = True
    twice[whole[by][:-1][same]] = True
    hot = np.flatnonzero(twice)
    twice[(hot + base)[hot + base < stop[hot]]] = True
    at = np.flatnonzero(twice)
    m = len(at)
    if not m:
        return at, at, []
    rank = _window_order(words, stop, at, base)
    order = np.lexsort((rank, row[at]))
    head = np.ones(m, bool)
    head[1:] = (rank[order][1:] != rank[order][:-1]) | (row[at][order][1:] != row[at][order][:-1])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(m), 0))
    levels, step = [rank], base
    active = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(active):
        mine = order[active]
        # A window that stands twice reaches another listed position, or the end of its row, which sorts first.
        after = at[mine] + step
        second = np.where(after < stop[at[mine]], rank[np.minimum(np.searchsorted(at, after), m - 1)], -1)
        first = rank[mine]
        by = np.lexsort((second, first))
        mine, first, second = mine[by], first[by], second[by]
        order[active] = mine
        head = np.ones(len(mine), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[mine] = active[np.maximum.accumulate(np.where(head, np.arange(len(mine)), 0))]
        levels.append(rank)
        step *= 2
        active = active[~(head & np.concatenate([head[1:], [True]]))]
    return at, order, levels


def _window_order(words: np.ndarray, stop: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """Ranks of the windows of ``base`` words (a power of two) at the given positions, in an order that extends that of their words."""
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, np.minimum(at + base, stop[at]), -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    rank = np.unique(words[place], return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < base:
        found = np.minimum(np.arange(len(place)) + width, len(place) - 1)
        stands = (place[found] == place + width) & (place + width < stop[place])
        key = (rank << 32) + np.where(stands, rank[found] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank[np.searchsorted(place, at)]


def _lcp(words, stop, at, i, j, levels, base) -> np.ndarray:
    """Common words of the suffixes at i and j: by the kept ranks from the widest down, then word by word."""
    lcp = np.zeros(len(i), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        fa, fb = (np.minimum(np.searchsorted(at, x), len(at) - 1) for x in (a, b))
        same = (at[fa] == a) & (at[fb] == b) & (a < stop[i]) & (b < stop[j]) & (levels[depth][fa] == levels[depth][fb])
        lcp += np.where(same, base << depth, 0)
    left = np.arange(len(i))
    while len(left):
        a, b = i[left] + lcp[left], j[left] + lcp[left]
        inside = (a < stop[i[left]]) & (b < stop[j[left]])
        left, a, b = left[inside], a[inside], b[inside]
        left = left[words[a] == words[b]]
        lcp[left] += 1
    return lcp


def _unite(position: list[int], edges: list[int], lcps: list[int], least: int, times: int):
    """Kruskal over the suffix order: first position, distance and LCP of each pair that becomes adjacent and may be a run."""
    n = len(position)
    start_of, end_of = list(range(n)), list(range(n))  # of the class that ends, or starts, at an index
    sets: dict[int, list[int]] = {}
    seeds: list[tuple[int, int, int]] = []
    more = times - 1
    for t, l in zip(edges, lcps, strict=True):
        s, e = start_of[t], end_of[t + 1]
        large = sets.pop(s, None) or [position[s]]
        small = sets.pop(t + 1, None) or [position[t + 1]]
        start_of[e], end_of[s] = s, e
        if len(small) > len(large):
            small, large = large, small
        last = len(small) - 1
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (k == 0 or small[k - 1] < large[at - 1]):
                d = x - large[at - 1]
                if d * more <= l and d + l >= least:
                    seeds.append((large[at - 1], d, l))
            if at < len(large) and (k == last or small[k + 1] > large[at]):
                d = large[at] - x
                if d * more <= l and d + l >= least:
                    seeds.append((x, d, l))
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        sets[s] = large
    got = np.array(seeds, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]
