"""Removal of repeated byte strings by grouped anchors of a sparse suffix array.

A byte goes when it lies in a string of ``length`` bytes that also starts in a document with a
smaller id. This stands in for prefix doubling: no pairs of ranks are sorted at growing offsets.
Positions are compared at four widths instead: 16 bytes, then a context of up to 84 bytes around
them, then the 33 bytes that end and the 34 that begin with the 16, then single 50-byte strings; a
position that is alone at a width is carried no further.

Not every suffix is sorted. Of all 16-byte strings inside any 50 bytes the one with the smallest
hash is an anchor, so equal 50-byte strings have an anchor at the same place, and one position in
about eighteen suffices:

1. Anchors of all documents are dealt to buckets by their 16 bytes. Inside a task, anchors with equal
   contexts are settled at once: later documents lose the context, the first one speaks for it.
2. Sorted by (key, context, document): an anchor whose context stands in an earlier document loses
   all of it. A 50-byte string around an anchor holds its left or its right half, so of the first
   holders of different contexts only those go on that share a half with another document. Chance
   repeats of 16 bytes, whose number grows faster than the input, end here; the key has room for
   both halves, so they cost no byte of the shuffle.
3. Contexts that share a rank are compared string by string; the earliest document keeps each.
   Buckets with very many contexts are first combined per string on the map side.

Disk: the anchors' shuffle is deleted once the marks are written, and the texts are shuffled once for
both joins that read them.

Ranks are named by 64-bit hashes instead of counted, contexts by two of them. Defined cases: a null
text is empty; ids are integers, rows that repeat an id are separate texts that never remove each
other; a null id comes after all others; texts shorter than ``length`` stay whole; an empty table
gives an empty result; extra columns are ignored. At most 2 ** 23 rows may share an id, or lack one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .bytesio import BASE, BASE_INVERSE, groups_of_rows, mix, powers, text_bytes

LENGTH = 50
RANK = 16
REACH = LENGTH - RANK
HALF = REACH // 2
MANY = 1 << 16
HOLD = 1 << 20  # first holders of one bucket that are compared by halves; a larger bucket goes on whole
#: A key: the bucket of the rank, then what stands for the left and the right half; 0 is a half that the text cuts off.
SIDE_BITS = 20
SIDE = np.uint64((1 << SIDE_BITS) - 1)
BUCKET_SHIFT = 2 * SIDE_BITS
CHUNK_BYTES = 1 << 18
BATCH_BYTES = 16 << 20
PIECE_BYTES = 2 << 20
COPY = 40  # bits of a position; texts that repeat an id are told apart above them
LAST = (1 << 63) - 1


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best() over every window of ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def anchors(raw: np.ndarray, bounds: np.ndarray, first: int = 0, stop: int | None = None):
    """Anchor positions with their key and context hashes; windows start in [first, stop) only.

    ``bounds`` are the offsets of the texts in ``raw``. A context is what of [p - 34, p + 50) lies
    inside the text, the halves are [p - 17, p + 16) and [p, p + 34).
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(raw)
    if n < LENGTH:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    inverse = powers(BASE_INVERSE, n + 1)
    rank = mix((sums[RANK:] - sums[:-RANK]) * inverse[: n - RANK + 1]) | np.uint64(1)
    least = _slide(rank, REACH + 1, np.minimum)
    whole = np.zeros(len(least), bool)
    starts, sizes = bounds[:-1], np.diff(bounds)
    change = np.zeros(n + 1, np.int32)
    long_enough = sizes >= LENGTH
    change[starts[long_enough]] += 1
    change[bounds[1:][long_enough] - LENGTH + 1] -= 1
    whole = np.cumsum(change)[: len(least)] > 0
    whole[:first] = False
    if stop is not None:
        whole[stop:] = False
    least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), REACH + 1, np.maximum) == rank)
    row = np.searchsorted(bounds, at, side="right") - 1
    lo, hi = np.maximum(at - REACH, bounds[row]), np.minimum(at + LENGTH, bounds[row + 1])
    shape = ((at - lo) * 128 + (hi - at)).astype(np.uint64)
    context = mix((sums[hi] - sums[lo]) * inverse[lo] + shape * np.uint64(0xD6E8FEB86659FD93))

    def half(start, end, inside):
        value = mix((sums[np.where(inside, end, 0)] - sums[np.where(inside, start, 0)]) * inverse[np.where(inside, start, 0)])
        return np.where(inside, np.maximum(value >> np.uint64(64 - SIDE_BITS), np.uint64(1)), np.uint64(0))

    left, right = half(at - HALF, at + RANK, at - HALF >= lo), half(at, at + LENGTH - HALF + 1, at + LENGTH - HALF + 1 <= hi)
    return at, _bucket(rank[at]) << np.uint64(BUCKET_SHIFT) | left << np.uint64(SIDE_BITS) | right, context


def _bucket(rank: np.ndarray) -> np.ndarray:
    """The low bits of a rank, without the one that is always set; an anchor's high bits are low as it is a least one."""
    return rank << np.uint64(BUCKET_SHIFT - 1) >> np.uint64(BUCKET_SHIFT)


def _text_anchors(raw: np.ndarray, bounds: np.ndarray):
    """Row, position in the row, key and context of all anchors of some texts, in order."""
    found = []
    for first, last in groups_of_rows(bounds, CHUNK_BYTES):
        start, stop = int(bounds[first]), int(bounds[last])
        if last - first > 1 or stop - start <= 2 * CHUNK_BYTES:
            inner = bounds[first : last + 1] - start
            at, key, context = anchors(raw[start:stop], inner)
            row = np.searchsorted(inner, at, side="right") - 1
            found.append((row + first, at - inner[row], key, context))
            continue
        parts = []
        for a in range(start, stop, CHUNK_BYTES):  # a very long text in pieces, with what their contexts need
            lo, hi = max(start, a - 2 * LENGTH), min(stop, a + CHUNK_BYTES + 4 * LENGTH)
            at, key, context = anchors(raw[lo:hi], np.array([0, hi - lo]), a - lo, a - lo + CHUNK_BYTES)
            parts.append((at + lo - start, key, context))
        at, keep = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        found.append((np.full(len(at), first), at, *(np.concatenate([p[k] for p in parts])[keep] for k in (1, 2))))
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals of each owner."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    shift = owner.astype(np.int64) - owner.min()
    width = int(end.max()) + 2
    reach = np.maximum.accumulate(end + shift * width)
    new = np.ones(len(owner), bool)
    new[1:] = start[1:] + shift[1:] * width > reach[:-1]
    heads = np.flatnonzero(new)
    return owner[heads], start[heads], reach[np.concatenate([heads[1:], [len(owner)]]) - 1] - shift[heads] * width


#: Rows of the first sort: a key, a context, a document, and a position. A position below zero marks
#: a span that is settled already: it starts at -1 - position and ends at what the context column holds.
ANCHOR = "k long, c long, doc long, pos long"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_bytes(batch.column("text"))
        docs, bases = batch.column("doc").to_numpy(), batch.column("base").to_numpy()
        for first, last in groups_of_rows(bounds, BATCH_BYTES):
            row, pos, key, context = _text_anchors(raw, bounds[first : last + 1])
            if not len(row):
                continue
            row = row + first
            sizes = np.diff(bounds)
            by_doc = np.argsort(docs[row], kind="stable")
            name = (mix(key) ^ (context * np.uint64(0x9E3779B97F4A7C15)))[by_doc]
            order = by_doc[np.argsort(name, kind="stable")]
            row, pos, key, context = row[order], pos[order], key[order], context[order]
            new = np.ones(len(row), bool)
            new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
            later = docs[row] != docs[row[head]]
            texts = bases[row]
            new[1:] |= ~later[1:] & (texts[1:] != texts[:-1])
            own = row[later]
            own, a, b = _merged(own, np.maximum(pos[later] - REACH, 0), np.minimum(pos[later] + LENGTH, sizes[own]))
            a, b = a + bases[own], b + bases[own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[new], mix(docs[own].astype(np.uint64))]).view(np.int64)),
                    pa.array(np.concatenate([context[new].view(np.int64), b])),
                    pa.array(np.concatenate([docs[row[new]], docs[own]])),
                    pa.array(np.concatenate([pos[new] + bases[row[new]], -1 - a])),
                ],
                ["k", "c", "doc", "pos"],
            )


#: What the first sort settles: ``kind`` 0 asks for a comparison of contexts around ``a``; 1 removes the
#: context [a, b) of an anchor; 2 removes a span that a task had settled before; 3 asks as 0 does, in a
#: bucket with more than MANY contexts to compare.
MARK = "doc long, a long, b long, kind int"


def _share_a_half(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row has its left or its right half in common with a row of its bucket from another document."""
    key, n = key.view(np.uint64), np.uint64(SIDE_BITS)
    out = np.zeros(len(key), bool)
    for name in (key >> n, key >> n + n << n | key & SIDE):
        has = np.flatnonzero(name & SIDE)
        if not len(has):
            continue
        order = has[np.argsort(name[has], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        mixed = np.minimum.reduceat(doc[order], cuts) != np.maximum.reduceat(doc[order], cuts)
        out[order] |= np.repeat(mixed, np.diff(np.concatenate([cuts, [len(order)]])))
    return out


def _settle(many: int, hold: int):
    """Rows sorted by (key, context, document) in, marks out; keeps the first holders of one open bucket between batches."""

    def ask(bucket, key, doc, pos, hot):
        """Marks of the holders that go on: those that share a half, and all of the bucket ``hot``."""
        on = (bucket == hot) | _share_a_half(key, doc)
        bucket = bucket[on]
        _, group, sizes = np.unique(bucket, return_inverse=True, return_counts=True)
        crowded = (bucket == hot) | (sizes[group] > many)
        return doc[on], pos[on], np.zeros(len(bucket), np.int64), np.where(crowded, 3, 0).astype(np.int32)

    def marks(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[x] for p in parts])) for x in range(4)], ["doc", "a", "b", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, context and its first document
        waiting, hot = -1, -1  # the open bucket, and the last one with more than ``hold`` first holders
        held: list[tuple[np.ndarray, ...]] = []  # first holders of the open bucket: bucket, key, document, position

        for batch in batches:
            k, c, doc, pos = (batch.column(x).to_numpy() for x in ("k", "c", "doc", "pos"))
            done = pos < 0
            out = [(doc[done], -1 - pos[done], c[done], np.full(int(done.sum()), 2, np.int32))]
            k, c, doc, pos = k[~done], c[~done], doc[~done], pos[~done]
            if len(k):
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                new[0] = last is None or last[0] != k[0] or last[1] != c[0]
                head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                first = np.where(head >= 0, doc[head], last[2] if last else 0)
                last = (k[-1], c[-1], first[-1])
                lost = doc != first
                out.append((doc[lost], pos[lost] - REACH, pos[lost] + LENGTH, np.ones(int(lost.sum()), np.int32)))

                bucket = (k.view(np.uint64) >> np.uint64(BUCKET_SHIFT)).view(np.int64)
                held.append((bucket[~lost], k[~lost], doc[~lost], pos[~lost]))
                if not waiting == bucket[0] == bucket[-1]:
                    waiting = bucket[-1]
                    rows = [np.concatenate([h[x] for h in held]) for x in range(4)]
                    closed = rows[0] != waiting
                    out.append(ask(*(r[closed] for r in rows), hot))
                    held = [tuple(r[~closed] for r in rows)]
                if sum(len(h[0]) for h in held) > hold:
                    hot = waiting
                    out.append(ask(*(np.concatenate([h[x] for h in held]) for x in range(4)), hot))
                    held = []
            yield marks(out)
        if held:
            yield marks([ask(*(np.concatenate([h[x] for h in held]) for x in range(4)), hot)])

    return run


CONTEXT = "k long, doc long, pos long, lead int, body binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the positions that were asked for, with their rank."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            raw = np.frombuffer(unpack.decompress(batch.column("z")[i].as_py()), np.uint8)
            base = batch.column("base")[i].as_py()
            at = np.sort(batch.column("at").slice(i, 1).flatten().to_numpy()) - base
            lo, hi = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(raw))
            sizes = hi - lo
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            body = raw[np.repeat(lo - offsets[:-1], sizes) + np.arange(offsets[-1])]
            value = np.zeros(len(at), np.uint64)
            for j in range(RANK):
                value += (raw[at + j].astype(np.uint64) + np.uint64(1)) * powers(BASE, RANK)[j]
            blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body.tobytes())])
            doc = np.full(len(at), batch.column("doc")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((mix(value) | np.uint64(1)).view(np.int64)), pa.array(doc), pa.array(at + base), pa.array((at - lo).astype(np.int32)), blobs],
                ["k", "doc", "pos", "lead", "body"],
            )


SPAN = "doc long, pos long, a long, b long"


def _compare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by rank in, for each the part that an earlier document holds too."""

    def settled(rows: pa.Table):
        k, doc, pos, lead = (rows.column(x).combine_chunks().to_numpy() for x in ("k", "doc", "pos", "lead"))
        body = rows.column("body").combine_chunks()
        _, buffer, data = body.cast(pa.large_binary()).buffers()
        offsets = np.frombuffer(buffer, np.int64, len(body) + 1)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=sums[1:])
        inverse = powers(BASE_INVERSE, len(raw) + 1)
        low, high = np.full(len(k), LENGTH), np.full(len(k), -1)
        for o in range(REACH + 1):  # strings in which the rank stands o bytes behind the start
            start = offsets[:-1] + lead - o
            has = np.flatnonzero((lead >= o) & (start + LENGTH <= offsets[1:]))
            if not len(has):
                continue
            name = mix(mix((sums[start[has] + LENGTH] - sums[start[has]]) * inverse[start[has]]) + k[has].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(name, kind="stable")
            name, at = name[order], has[order]
            cuts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            earliest = np.repeat(np.minimum.reduceat(doc[at], cuts), np.diff(np.concatenate([cuts, [len(at)]])))
            lost = at[doc[at] > earliest]
            low[lost], high[lost] = np.minimum(low[lost], o), np.maximum(high[lost], o)
        some = high >= 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (doc, pos, pos - high, pos - low + LENGTH)], ["doc", "pos", "a", "b"])

    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        k = table.column("k").to_numpy()
        if held and held[-1].column("k")[-1].as_py() != k[0]:
            yield settled(pa.concat_tables(held))
            held = []
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        if len(change):
            yield settled(pa.concat_tables([*held, table.slice(0, change[-1])]))
            held, table = [], table.slice(change[-1])
        held.append(table)
    if held:
        yield settled(pa.concat_tables(held))


def _compare_many(contexts: DataFrame) -> DataFrame:
    """The same for ranks with too many contexts for a task: one row for each string, combined before the shuffle."""
    strings = contexts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(REACH))))
    strings = strings.filter((F.col("lead") >= F.col("o")) & (F.col("lead") - F.col("o") + LENGTH <= F.octet_length("body")))
    cut = F.expr(f"substring(body, lead - o + 1, {LENGTH})")
    strings = strings.select("doc", "pos", "o", "k", F.xxhash64(cut).alias("h"))
    earliest = strings.groupBy("k", "o", "h").agg(F.min("doc").alias("earliest"))
    lost = strings.join(earliest, ["k", "o", "h"]).filter("doc > earliest").groupBy("doc", "pos").agg(F.max("o").alias("hi"), F.min("o").alias("lo"))
    return lost.select("doc", "pos", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + LENGTH).alias("b"))


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices with a few megabytes of a column each, so what is made of one is small, in Python and in the JVM that reads it."""
    for batch in batches:
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))])
        for first, last in groups_of_rows(bounds, PIECE_BYTES):
            yield batch.slice(first, last - first)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in _pieces(batches, "text"):
        z = [pack.compress(t.as_buffer()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("base"), pa.array(z, pa.binary())], ["doc", "base", "z"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans that go; what a first holder loses, its equal contexts in the same text lose too."""
    unpack = zstandard.ZstdDecompressor()
    for batch in _pieces(batches, "z"):
        spans_out, kept_out, sizes_out = [], [], []
        for i in range(batch.num_rows):
            text = unpack.decompress(batch.column("z")[i].as_py())
            raw = np.frombuffer(text, np.uint8)
            sizes_out.append(len(raw))
            listed = batch.column("lost")[i]
            if not listed.is_valid:
                spans_out.append([]), kept_out.append(text)
                continue
            base = batch.column("base")[i].as_py()
            pos, a, b = (listed.values.field(x).to_numpy() - base for x in ("pos", "a", "b"))
            a, b = np.maximum(a, 0), np.minimum(b, len(raw))
            held = pos >= 0
            if held.any():
                _, at, rank, context = _text_anchors(raw, np.array([0, len(raw)]))
                name = mix(rank) ^ (context * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(name, kind="stable")
                own = name[np.searchsorted(at, pos[held])]
                lo, hi = np.searchsorted(name[order], own), np.searchsorted(name[order], own, side="right")
                n = hi - lo
                twins = at[order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]]
                a = np.concatenate([a, twins + np.repeat(a[held] - pos[held], n)])
                b = np.concatenate([b, twins + np.repeat(b[held] - pos[held], n)])
            _, a, b = _merged(np.zeros(len(a), np.int64), a, b)
            gone = np.zeros(len(raw) + 1, np.int32)
            gone[a] += 1
            gone[b] -= 1
            spans_out.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
            kept_out.append(raw[np.cumsum(gone)[:-1] == 0].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(sizes_out, pa.int64()), pa.array(spans_out, kind), pa.array(kept_out, pa.binary())], ["doc", "n_bytes", "spans", "kept"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``spans`` (removed runs) and ``kept`` (the remaining bytes)."""
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = F.lit(0).cast("long")
    if texts.groupBy("doc").count().filter("count > 1").limit(1).count():
        base = F.shiftleft(F.row_number().over(W.partitionBy("doc").orderBy("text")).cast("long") - 1, COPY)
    texts = texts.withColumn("base", base)
    found = texts.filter(F.octet_length("text") >= LENGTH).select("doc", "base", "text").mapInArrow(_find_anchors, ANCHOR)
    order = ["k", "c", "doc", "pos"]
    dealt = found.repartition(F.shiftrightunsigned("k", BUCKET_SHIFT)).sortWithinPartitions(*order)
    marks = materialise(dealt.mapInArrow(_settle(MANY, HOLD), MARK), "marks", release=True)

    # The filter is what an inner join adds by itself: with it both joins read one shuffle of the texts.
    packed = texts.mapInArrow(_pack, "doc long, base long, z binary").filter("doc is not null and base is not null")
    owner = F.shiftleft(F.shiftright("a", COPY), COPY).alias("base")

    def contexts(kind: int) -> DataFrame:
        asked = marks.filter(f"kind = {kind}").groupBy("doc", owner).agg(F.collect_list("a").alias("at"))
        return packed.join(asked, ["doc", "base"]).mapInArrow(_cut_contexts, CONTEXT)

    parts = contexts(0).repartition("k").sortWithinPartitions("k").mapInArrow(_compare_contexts, SPAN)
    if marks.filter("kind = 3").limit(1).count():
        parts = parts.unionByName(_compare_many(materialise(contexts(3), "contexts", release=True)))
    parts = parts.select("doc", F.col("pos"), "a", "b", F.shiftleft(F.shiftright("pos", COPY), COPY).alias("base"))
    return _removed(marks, parts, packed, id_col)


def _removed(marks: DataFrame, parts: DataFrame, packed: DataFrame, id_col: str) -> DataFrame:
    whole = marks.filter("kind in (1, 2)").withColumn("pos", F.when(F.col("kind") == 1, F.col("a") + REACH).otherwise(F.lit(-1)))
    inside = F.shiftleft(F.shiftright(F.col("b") - 1, COPY), COPY)
    whole = whole.select("doc", "pos", "a", "b", inside.alias("base"))
    lost = whole.unionByName(parts).groupBy("doc", "base").agg(F.collect_list(F.struct("pos", "a", "b")).alias("lost"))
    cut = packed.join(lost, ["doc", "base"], "left").mapInArrow(_cut_texts, "doc long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return cut.select(F.when(F.col("doc") != LAST, F.col("doc")).alias(id_col), "n_bytes", "spans", "kept")
