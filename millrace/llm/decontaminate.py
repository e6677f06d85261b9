"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item of n words, windows of n words slide over the documents. A window's SimHash
is the sign of its weighted shingle hashes, bit by bit; item fingerprints are indexed by eight blocks
of eight bits. Two fingerprints at most ``RADIUS`` bits apart differ by two bits or fewer in at least
one block, so looking up every block with up to two flipped bits finds all of them. What is found is
confirmed by the exact weighted similarity: shingles counted with their repeats, the sum of the
smaller counts over the sum of the larger.

Only windows that can reach the threshold get a fingerprint: at least that share of their shingles
must stand in some item. Their fingerprints are looked up among the items that may be meant: an item
as similar as the threshold shares that part of its shingles, so it shares one of any few more than the rest,
and its rarest are listed. Windows are taken ``CHUNK_WINDOWS`` at a time. A document that holds many
items thus meets each where it stands, not all items at every window. The benchmark is the query set. It is read in slices of at most
``SLICE_BYTES`` and ``SLICE_ITEMS``, each of which travels to the tasks; a larger benchmark takes more
passes over the documents, never a larger broadcast.

A passage at the threshold lies within the radius with a probability above 0.9999.

Defined cases: null, empty and blank texts match nothing, on either side; items of fewer than five
words have one shingle of all their words; a document shorter than an item is one window; equal items
are each reported; of equally similar windows the first counts; repeated ids are separate texts whose
matches are joined; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bytesio import groups_of_rows, text_bytes
from .keys import document_key
from .shingles import WORDS, shingle_hashes, word_hashes

RADIUS = 23
SIMILARITY = 0.75
SLICE_BYTES = 8 << 20
SLICE_ITEMS = 20_000
CHUNK_BYTES = 1 << 20
CHUNK_WINDOWS = 256
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprints(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of ``width`` shingles, as eight bytes each."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(sums[width:] - sums[:-width] > 0, axis=1)


def weighted_similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    values, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    a = np.bincount(where[: len(left)], minlength=len(values))
    b = np.bincount(where[len(left) :], minlength=len(values))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


class Index:
    """Items of one slice: by number of words, their shingles, fingerprints in blocks, and listed shingles."""

    def __init__(self, texts: list[str], similarity: float):
        self.similarity = similarity
        self.shingles: list[np.ndarray] = []
        self.sizes: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), np.uint8)
            words, _, counts = word_hashes(raw, np.array([0, len(raw)])) if len(raw) else (np.zeros(0, np.uint64), None, np.zeros(1, np.int64))
            found = shingle_hashes(words, counts, min(len(words), WORDS))[0] if len(words) else words
            self.shingles.append(found)
            if len(words):
                self.sizes.setdefault(len(words), []).append(i)
        self.prints = {n: np.concatenate([fingerprints(self.shingles[i], len(self.shingles[i])) for i in own]) for n, own in self.sizes.items()}
        self.known = {k: np.unique(np.concatenate([self.shingles[i] for n, own in self.sizes.items() if min(n, WORDS) == k for i in own])) for k in {min(n, WORDS) for n in self.sizes}}

        values, counts = np.unique(np.concatenate([np.unique(x) for x in self.shingles]), return_counts=True)
        self.listed = {n: self._list_rarest(own, values, counts) for n, own in self.sizes.items()}

    def _list_rarest(self, own: list[int], values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in order, and the places of the items that count on them: one of an item's stands in every window it resembles."""
        found, places = [], []
        for place, i in enumerate(own):
            every = self.shingles[i]
            spare = len(every) - ceil(self.similarity * len(every) - 1e-9) + 1
            rarest = np.unique(every[np.argsort(counts[np.searchsorted(values, every)], kind="stable")[:spare]])
            found.append(rarest)
            places.append(np.full(len(rarest), place))
        shingles, at = np.concatenate(found), np.concatenate(places)
        order = np.argsort(shingles, kind="stable")
        return shingles[order], at[order]

    def meant(self, shingles: np.ndarray, n: int) -> np.ndarray:
        """Places of the items of ``n`` words that windows over these shingles may resemble."""
        listed, places = self.listed[n]
        asked = np.unique(shingles)
        first, last = np.searchsorted(listed, asked), np.searchsorted(listed, asked, side="right")
        return np.unique(np.concatenate([places[a:b] for a, b in zip(first, last, strict=True) if a < b] or [places[:0]]))

    def near(self, prints: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Window and item pairs whose fingerprints lie within the radius, by the block index."""
        found = np.zeros((len(prints), len(own)), bool)
        for block in range(8):
            table = _BITS[np.arange(256, dtype=np.uint8)[:, None] ^ own[None, :, block]] <= RADIUS // 8
            found |= table[prints[:, block]]
        window, item = np.nonzero(found)
        close = _BITS[prints[window] ^ own[item]].sum(1) <= RADIUS
        return np.stack([window[close], item[close]], 1)

    def search(self, words: np.ndarray):
        """Best window for each item that one document (its word hashes) holds: item, similarity, first word, words."""
        best: dict[int, tuple[float, int, int]] = {}
        total = len(words)
        for k, known in self.known.items():
            shingles = shingle_hashes(words, np.array([total]), k)[0] if total >= k else np.zeros(0, np.uint64)
            if not len(shingles):
                continue
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            hits = np.concatenate([[0], np.cumsum(known[at] == shingles)])
            for n, own in self.sizes.items():
                if min(n, WORDS) != k:
                    continue
                width = min(n, total) - k + 1  # a shorter document is one window
                enough = np.flatnonzero(hits[width:] - hits[:-width] >= self.similarity * (n - k + 1))
                if not len(enough):
                    continue
                for run in np.split(enough, np.flatnonzero(np.diff(enough) > 1) + 1):
                    for begin in range(int(run[0]), int(run[-1]) + 1, CHUNK_WINDOWS):
                        part = shingles[begin : min(begin + CHUNK_WINDOWS, int(run[-1]) + 1) + width - 1]
                        meant = self.meant(part, n)
                        if not len(meant):
                            continue
                        for window, place in self.near(fingerprints(part, width), self.prints[n][meant]):
                            start, item = begin + int(window), own[meant[place]]
                            if item in best and best[item][0] == 1:
                                continue
                            value = weighted_similarity(shingles[start : start + width], self.shingles[item])
                            if value >= self.similarity and (item not in best or value > best[item][0]):
                                best[item] = (value, start, min(n, total))
        return [(i, *v) for i, v in sorted(best.items())]


def _slices(items: DataFrame, id_col: str, text_col: str):
    """The items in slices of bounded bytes and rows, each read with its own small query."""
    named = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("length(trim(text)) > 0")
    size = named.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(-(-size["n"] // SLICE_ITEMS), -(-(size["b"] or 0) // SLICE_BYTES))
    if parts > 1:
        parts *= 2  # hashing deals unevenly
    key = F.pmod(F.xxhash64("id", "text"), F.lit(max(parts, 1)))
    for i in range(parts):
        rows = named.filter(key == i).orderBy("id", "text").collect()
        if rows:
            yield [r["id"] for r in rows], [r["text"] for r in rows]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item it holds: both ids, ``similarity``, ``start_word`` and ``n_words``."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null and length(text) > 0")
    kind = items.schema[item_col].dataType
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("item", kind), T.StructField("similarity", T.DoubleType()),
        T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()),
    ])
    found = [base.mapInArrow(_search(ids, texts, similarity, to_arrow_type(kind)), schema) for ids, texts in _slices(items, item_col, item_text_col)]
    if not found:
        found = [base.limit(0).selectExpr("id", "null as item", "0D as similarity", "0L as start_word", "0L as n_words").withColumn("item", F.col("item").cast(kind))]
    every = reduce(DataFrame.unionByName, found)
    first = F.max_by(F.struct("similarity", "start_word", "n_words"), F.struct("similarity", -F.col("start_word")))
    every = every.groupBy("id", "item").agg(first.alias("x"))
    return every.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.*")


def _search(ids: list, texts: list[str], similarity: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, similarity)
        every = np.sort(np.concatenate([*index.known.values()]))
        # A document without a shingle of any item is passed by; a bit map answers for most.
        bitmap = np.zeros(1 << 20, bool)
        bitmap[every >> np.uint64(44)] = True
        for batch in batches:
            raw, bounds = text_bytes(batch.column("text"))
            rows: list[tuple] = []
            for first, last in groups_of_rows(bounds, CHUNK_BYTES):
                words, _, counts = word_hashes(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                ends = np.cumsum(counts)
                touched = np.zeros(last - first, bool)
                for k in index.known:
                    shingles, per_row = shingle_hashes(words, counts, k)
                    maybe = np.flatnonzero(bitmap[shingles >> np.uint64(44)])
                    sure = maybe[np.isin(shingles[maybe], index.known[k])]
                    touched[np.searchsorted(np.cumsum(per_row), sure, side="right")] = True
                for row in np.flatnonzero(touched):
                    rows += [(first + row, *hit) for hit in index.search(words[ends[row] - counts[row] : ends[row]])]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), pa.array([ids[r[1]] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4))],
                ["id", "item", "similarity", "start_word", "n_words"],
            )

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no item, with the columns they came with.

    A document is its id and its text: others without an id, or with the same id, stay.
    """
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    named = docs.select(document_key(own, text).alias("_key"), text.alias("_text"))
    held = find_leaks(named, items, "_key", "_text", item_col).select(F.col("_key").alias("_held")).distinct()
    return docs.join(held, document_key(docs[id_col], docs[text_col]) == held["_held"], "left_anti")
