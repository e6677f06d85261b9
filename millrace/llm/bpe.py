"""Byte-level BPE encoding and decoding of long texts in overlapping chunks.

A text longer than a chunk is cut into overlapping windows, and each window is pre-tokenised alone,
in parallel. A window that starts inside a pre-token reads wrong boundaries first and then falls into
step; so neighbouring windows are stitched at the first boundary in their overlap that both found.
The first window is right from its start, so by induction every stitch is a true boundary. Where an
overlap holds none (a run of one letter, say) the rest of the text is one piece. The pieces between
stitches are encoded alone, in parallel, and their ids concatenated in order. Decoding concatenates
the raw bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; text that looks like a
special token is ordinary text; extra columns are ignored; repeated ids are separate texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024


def read_ranks(path: str) -> bytes:
    """The rank file, read once on the driver: a vocabulary has a fixed size of about a megabyte."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(ranks: bytes, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    enc = encoder(ranks, pattern)
    table = [b""] * enc.n_vocab
    for i in range(enc.n_vocab):
        try:
            table[i] = enc.decode_single_token_bytes(i)
        except KeyError:
            pass
    sizes = np.array([len(t) for t in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def encode_piece(text: str, ranks: bytes, pattern: str) -> np.ndarray:
    """Ids of a piece that starts and ends at pre-token boundaries."""
    return np.asarray(encoder(ranks, pattern).encode_to_numpy(text, disallowed_special=()), np.uint32)


def decode_ids(ids: np.ndarray, ranks: bytes, pattern: str) -> bytes:
    """Raw bytes of the ids, concatenated."""
    blob, starts, sizes = _token_bytes(ranks, pattern)
    if not len(ids):
        return b""
    n = sizes[ids]
    ends = np.cumsum(n)
    return blob[np.arange(int(ends[-1])) + np.repeat(starts[ids] - (ends - n), n)].tobytes()


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens of the text start and the text may be cut.

    Not at the last one, since the text itself may end inside it, and not after white space: how a
    run of white space is split depends on what follows it.
    """
    starts = [m.start() for m in regex.finditer(pattern, text)][:-1]
    return [b for b in starts if b == 0 or not text[b - 1].isspace()]


def _rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


WINDOW = pa.schema([("key", pa.string()), ("part", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
CUT = pa.schema([("key", pa.string()), ("part", pa.int32()), ("body", pa.string())])


def _windows(chunk: int, overlap: int):
    """Each long text as overlapping windows, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for first in range(0, -(-len(text) // chunk), 64):
                    parts = range(first, min(first + 64, -(-len(text) // chunk)))
                    bodies = [text[i * chunk : (i + 1) * chunk + overlap] for i in parts]
                    yield _rows({"key": [key] * len(parts), "part": list(parts), "body": bodies}, CUT)

    return run


def _marks(pattern: str, chunk: int, overlap: int):
    """Pre-tokenise windows; only boundaries inside their two overlaps can become stitches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist(), strict=True):
                found = boundaries(body, pattern)
                heads.append([part * chunk + b for b in found if 0 < b < overlap])
                tails.append([part * chunk + b for b in found if b > chunk])
            yield _rows({"key": batch.column("key"), "part": batch.column("part"), "head": heads, "tail": tails}, WINDOW)

    return run


def _pieces(chunk: int):
    """Cut a text at its stitches. After windows that never agreed, the rest is one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "cuts")), strict=True):
                whole = []
                for i, cut in enumerate(cuts, 1):
                    if cut is None:
                        break
                    whole.append((i, cut))
                ends = [c for _, c in whole[1:]] + [len(text)]
                for (i, a), b in zip(whole, ends, strict=True):
                    yield _rows({"key": [key], "part": [i], "body": [text[a:b]]}, CUT)

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: its id, ``ids`` (little-endian unsigned 32-bit) and ``raw`` (the decoded bytes).

    Texts of at most one chunk are one piece. Windows and pieces of longer texts are rows of their
    own, dealt over all tasks; equal long texts are cut and encoded once.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    kind = docs.schema[id_col].dataType
    named = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                ids = [encode_piece(t, ranks, pattern) for t in some.column("text").to_pylist()]
                raw = [decode_ids(i, ranks, pattern) for i in ids]
                arrays = [some.column("id"), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "ids", "raw"])

    short = base.filter(F.length("text") <= chunk).mapInArrow(whole, named)
    long = base.filter(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    once = long.groupBy("key").agg(F.first("text").alias("text"))

    pieces = _stitched(once, pattern, chunk, overlap)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = encode_piece(batch.column("body")[row].as_py(), ranks, pattern)
                arrays = [[batch.column("key")[row].as_py()], [batch.column("part")[row].as_py()], [ids.astype("<u4").tobytes()], [decode_ids(ids, ranks, pattern)]]
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0]), pa.array(arrays[1], pa.int32()), pa.array(arrays[2], pa.binary()), pa.array(arrays[3], pa.binary())], ["key", "part", "ids", "raw"])

    done = pieces.repartition("key", "part").mapInArrow(encoded, "key string, part int, ids binary, raw binary")
    done = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "ids", "raw"))).alias("all"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts = batch.column("all")[row].as_py()
                arrays = [pa.array([b"".join(p[c] for p in parts)], pa.binary()) for c in ("ids", "raw")]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(row, 1), *arrays], ["key", "ids", "raw"])

    done = done.mapInArrow(joined, "key string, ids binary, raw binary")
    back = long.select("id", "key").join(done, "key").select("id", "ids", "raw")
    return short.unionByName(back).withColumnRenamed("id", id_col)


def _stitched(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``key``, ``part``, ``body``: pieces of each text that start and end at true pre-token boundaries."""
    windows = texts.mapInArrow(_windows(chunk, overlap), "key string, part int, body string").repartition("key", "part")
    marks = windows.mapInArrow(_marks(pattern, chunk, overlap), "key string, part int, head array<bigint>, tail array<bigint>")
    after = marks.select("key", (F.col("part") + 1).alias("part"), "tail")
    cuts = marks.select("key", "part", "head").join(after, ["key", "part"], "left")
    # A boundary that window part-1 and window part both found: from there on they read alike.
    cut = F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("tail", "head")))
    cuts = cuts.select("key", "part", cut.alias("cut")).groupBy("key")
    cuts = cuts.agg(F.array_sort(F.collect_list(F.struct("part", "cut"))).alias("list")).select("key", F.col("list.cut").alias("cuts"))
    return texts.join(cuts, "key").mapInArrow(_pieces(chunk), "key string, part int, body string")


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The frame with ``raw``: the bytes of each row's ids. A null stays null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (None if b is None else np.frombuffer(b, "<u4") for b in batch.column(ids_col).to_pylist())
            raw = pa.array([None if i is None else decode_ids(i, ranks, pattern) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, "raw"])

    return encoded.mapInArrow(run, schema)
