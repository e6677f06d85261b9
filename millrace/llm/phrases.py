"""Phrases that stand together, by Toivonen's sampling algorithm.

Counts are kept for each language. ``least`` is a fixed count, so

1. a sample of the documents (``share`` of them, by hash) is mined level by level at a lowered count:
   words, then phrases whose two shorter parts were found, up to one word less than the longest;
2. one pass over all documents counts every phrase whose two parts the sample proposed: the proposed
   phrases and their negative border, as far as it occurs; single words are counted all;
3. border phrases that reach ``least`` are failures of the sample. A frequent phrase that pass 2 did not
   count has a part that the sample lacks; the shortest such part was counted and is a failure. So one
   more pass, over every phrase that holds a failure, closes the set whatever the sample;
4. the last pass counts the phrases that reached ``least`` by their text.

Passes 1 to 3 count 61-bit hashes: phrases that share one can only look more frequent than they are, and
the last pass, by text, sets this right (within one piece of ``PIECE_BYTES`` phrases of equal hash are one). Which phrases to count is told to the tasks by a bitmap of
``2 ** BITS`` bits, two to a phrase, whose size does not depend on the data; phrases on the same bits
only make a task count more than it must. Counts are made piece by piece within tasks and combined on
the map side.

Scores are exact decimals. A phrase is dropped when a longer candidate that holds it is nearly as
frequent; the first ``top`` of each language by score remain.

Defined cases: a null text has no words; a null language counts as ``und``; repeated rows count each
time; a language without candidates has no row; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import need
from ..session import materialise
from .bytesio import byte_table, groups_of_rows, mix, span_hashes, text_bytes, word_spans
from .joins import join_hot

LEAST, WORDS, TOP = 30, 4, 2000
SHARE = 0.25
BITS = 26
#: Bytes counted at once, bytes hashed at once, phrases given back at once.
PIECE_BYTES, HASH_BYTES, OUT_ROWS = 3 << 20, 1 << 20, 1 << 17
_STOPS = byte_table(*map(ord, ".,;:!?"), *range(0x0A, 0x0E))
_BETWEEN = _STOPS | byte_table(0x20, 0x09)
_LENGTHS = 7


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, top: int = TOP, cover: int = 80, share: float = SHARE
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l``, ``r`` (of the parts of its weakest cut), ``n`` (words of the language), ``score``.

    A candidate goes when a longer one that holds it has at least ``cover`` percent of its count.
    """
    found = frequent_phrases(docs, text, lang, least, words, share)
    counted = found.filter("n > 0").select("lang", "n", "phrase", "f")
    total = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    return _ranked(counted, total, words, top, cover)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """``lang, n, phrase, f`` of every phrase of ``n`` words, 1 to ``words``, that stands ``least`` times; ``n = 0`` tells all words of a language."""
    need(1 <= words <= _LENGTHS, "INVALID_LENGTH", f"phrases have 1 to {_LENGTHS} words")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = _propose(rows, least, words, share)
    wanted = materialise(_count(rows, range(1, words + 1), bitmap(known), None, least), "phrases")
    # A phrase of the greatest length is no part of another.
    fresh = materialise(wanted.filter(F.col("h").bitwiseAND(_LENGTHS) < words).join(known, "h", "left_anti"), "phrases-fresh")
    if not fresh.isEmpty():
        wanted = wanted.unionByName(materialise(_count(rows, range(2, words + 1), None, bitmap(fresh), least), "phrases"))
    bits = bitmap(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _open(bits)
        for piece in _pieces(batches):
            yield from piece.totals()
            for n, at, h in piece.grams(range(1, words + 1)):
                yield from piece.counted(n, at, h, opened)

    exact = rows.mapInArrow(run, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return materialise(exact.filter(f"n = 0 or f >= {least}"), "phrases-exact")


def _propose(rows: DataFrame, least: int, words: int, share: float) -> DataFrame:
    """Hashes of phrases of fewer than ``words`` words that the sample holds often enough for a lowered count."""
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    mean = least * share
    lowered = max(1, math.floor(mean - math.sqrt(mean)))
    level = materialise(_count(drawn, [1], None, None, lowered), "phrases-sample")
    known = level
    for n in range(2, words):
        level = materialise(_count(drawn, [n], bitmap(level), None, lowered), "phrases-sample")
        known = known.unionByName(level)
    return known


def bitmap(phrases: DataFrame) -> bytes:
    """Two bits for each hash ``h``, in 2 ** BITS; put together from parts of 4 kB, whatever the number of phrases, and compressed."""
    bit = F.explode(F.array(F.col("h").bitwiseAND((1 << BITS) - 1), F.shiftrightunsigned("h", 64 - BITS)))
    part = 1 << 15
    parts = phrases.select(bit.alias("b")).groupBy(F.shiftright("b", 15).alias("p")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(part - 1)).alias("m"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for p, m in parts.collect():  # 2 ** BITS bits in all, at most
        out[p * part // 8 : (p + 1) * part // 8] = np.frombuffer(m, np.uint8)
    return zlib.compress(out, 1)


def _open(bits: bytes | None) -> np.ndarray | None:
    return None if bits is None else np.frombuffer(zlib.decompress(bits), np.uint8)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for b in (h & np.uint64((1 << BITS) - 1), h >> np.uint64(64 - BITS)):
        found &= (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _language_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    each = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()]
    return np.array(each, np.uint64)[coded.indices.to_numpy()]


def _count(rows: DataFrame, lengths, known: bytes | None, fresh: bytes | None, least: int) -> DataFrame:
    """Hashes ``h`` counted ``least`` times, of phrases of these lengths whose two parts of one word less are ``known``, or that hold a shorter ``fresh`` one."""
    lengths = list(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _open(known), _open(fresh)
        for piece in _pieces(batches):
            for _, _, h in piece.grams(lengths, *opened):
                h, f = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.astype(np.int64))], ["h", "f"])

    return rows.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f")).filter(f"f >= {least}").select("h")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    for batch in batches:
        langs = batch.column("lang")
        own = _language_hashes(langs)
        raw, bounds = text_bytes(batch.column("text"))
        for first, last in groups_of_rows(bounds, PIECE_BYTES):
            yield _Piece(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], langs.slice(first, last - first), own[first:last])


class _Piece:
    """Some whole rows, cut into words."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, langs: pa.Array, own: np.ndarray):
        self.low = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
        self.langs = langs
        self.starts, self.ends, self.counts, self.each, self.joined = _words(self.low, bounds)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.salt = own[self.row]

    def totals(self) -> Iterator[pa.RecordBatch]:
        """The number of words of each language, as phrases of no word."""
        coded = self.langs.dictionary_encode()
        sums = np.bincount(coded.indices.to_numpy(), self.counts, len(coded.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(np.zeros(len(sums), np.int32)), pa.array([""] * len(sums), pa.string()), pa.array(sums)], ["lang", "n", "phrase", "f"])

    def _named(self, grams: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of language and words; the low three bits tell the number of words."""
        return mix(grams[at] ^ self.salt[at]) & np.uint64((1 << 64) - 1 - _LENGTHS) | np.uint64(n)

    def grams(self, lengths, known: np.ndarray | None = None, fresh: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the first words of the phrases that stand in one piece of text, and their hashes."""
        grams, whole, holds = self.each, np.ones(len(self.each), bool), None
        for n in range(1, max(lengths) + 1):
            size = len(self.each) - n + 1
            if size <= 0:
                return
            before = grams
            if n > 1:
                # Words n - 1 and n of a phrase must follow each other.
                whole = whole[:size] & self.joined[n - 2 :][:size]
                grams = mix(grams[:size] + self.each[n - 1 :] * np.uint64(0x9E3779B185EBCA87) + np.uint64(n))
            at = np.flatnonzero(whole)
            if fresh is not None:
                inside = holds[:-1] | holds[1:] if n > 1 else np.zeros(size, bool)
                holds = inside.copy()
                holds[at] |= _in(fresh, self._named(grams, at, n))
                at = np.flatnonzero(whole & inside)
            elif n > 1 and known is not None:
                parts = [self._named(before, at + k, n - 1) for k in (0, 1)]
                at = at[_in(known, parts[0]) & _in(known, parts[1])]
            if n in lengths and len(at):
                yield n, at, self._named(grams, at, n)

    def counted(self, n: int, at: np.ndarray, h: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Language, text and count of the phrases that are wanted."""
        stays = _in(wanted, h)
        at = at[stays]
        _, index, f = np.unique(h[stays], return_index=True, return_counts=True)
        at = at[index]
        for k in range(0, len(at), OUT_ROWS):
            some = at[k : k + OUT_ROWS]
            langs = self.langs.take(pa.array(self.row[some])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(some), n, np.int32)), _texts(self.low, self.starts, self.ends, some, n), pa.array(f[k : k + OUT_ROWS].astype(np.int64))], ["lang", "n", "phrase", "f"])


def _words(low: np.ndarray, bounds: np.ndarray):
    """Starts, ends, number by row and hashes of all words, and whether a word's next one follows it in its row with no stop between."""
    parts = []
    for first, last in groups_of_rows(bounds, HASH_BYTES):
        part, inner = low[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        starts, ends, counts = word_spans(part, inner, _BETWEEN)
        stops = np.concatenate([[0], np.cumsum(_STOPS[part], dtype=np.int32)])
        joined = np.zeros(len(starts), bool)
        joined[:-1] = stops[starts[1:]] == stops[ends[:-1]]
        edge = np.cumsum(counts)
        joined[edge[(edge > 0) & (counts > 0)] - 1] = False
        parts.append((starts + bounds[first], ends + bounds[first], counts, span_hashes(part, starts, ends), joined))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _texts(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The ``n`` words from each position on, joined by one space."""
    words = []
    for k in range(n):
        s, e = starts[at + k], ends[at + k]
        size = e - s
        offsets = np.concatenate([[0], np.cumsum(size)])
        bytes_ = low[np.repeat(s - offsets[:-1], size) + np.arange(offsets[-1])]
        words.append(pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(bytes_)))
    out = words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
    return out.cast(pa.string())


def _ranked(counted: DataFrame, total: DataFrame, words: int, top: int, cover: int) -> DataFrame:
    candidates = counted.filter("n > 1")
    size = counted.count()
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cut = cut.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first")).select("*", F.expr("substring(phrase, length(first) + 2)").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        # A part that many candidates share is a hot key.
        uses = cut.groupBy("lang", part).agg(F.count("*").alias("uses"))
        known = uses.join(counted.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
        cut = join_hot(cut, known, ["lang", part], size * (words - 1), "uses")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.select("lang", "phrase", "a", F.struct(F.expr("cast(cast(a as decimal(20,0)) * 2000000 as decimal(38,0)) div (cast(l as decimal(20,0)) + r)").alias("score"), "k", "l", "r").alias("cut"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = [f"slice(w, {i + 1}, {n})" for n in range(2, words) for i in range(words - n + 1)]
    longer = candidates.filter("n > 2").select("lang", "f", "n", F.split("phrase", " ").alias("w"))
    held = longer.select("lang", "f", "n", F.explode(F.expr(f"array({', '.join(inner)})")).alias("s")) if inner else None
    if held is not None:
        # Slices that reach beyond the phrase, and the phrase itself, are no parts of it.
        held = held.filter("size(s) > 1 and size(s) < n").select("lang", F.array_join("s", " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        scored = scored.join(held, ["lang", "phrase"], "left").filter((F.col("most").isNull()) | (exact("most") * 100 < exact("a") * cover))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
