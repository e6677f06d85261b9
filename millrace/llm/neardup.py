"""Near-duplicate groups by min-max hashing.

Under each random permutation both the smallest and the largest shingle are kept, so half the hash
evaluations give as many values; the estimate stays unbiased and its variance falls, because the two
ends of a permutation rarely agree by the same chance. Sixteen bits of each value are stored, four
values make a band, and texts that agree on a band are candidates.

Pairs are not emitted for a whole bucket. First every member meets the smallest document of its
bucket; links confirmed on full shingle sets give components. A bucket inside one component can add
nothing. In the others, only documents of different components are paired, when their sizes and
signatures allow the threshold; large buckets are split into blocks that meet two by two. These
pairs are confirmed on full sets as well, and the components are joined.

A link between texts at the threshold is missed with a probability below 1e-4 (bands: 5e-6).
Texts with equal shingle sets are one node from the start, whatever their number.

A document is named by its id and a 128-bit digest of its text, so texts that share an id, or have
none, are documents of their own. Smallest means by id, null last, then by digest.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; fewer words
than a shingle make one shingle of all; rows that repeat an id and a text are one document and share
its lot; a component of documents without an id has none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .bytesio import groups_of_rows, mix, text_bytes
from .components import connected_components
from .keys import document_key, key_type
from .shingles import WORDS, shingle_hashes, shingle_sets, word_hashes

PERMUTATIONS = 128
BANDS = 32
THRESHOLD = 75  # percent
SMALL = 64
BLOCK = 512
CHUNK_BYTES = 1 << 20


def _codes(keys: pa.StructArray) -> np.ndarray:
    """A number for each row, the same where the keys are the same."""
    codes = np.zeros(len(keys), np.int64)
    for part in keys.flatten():
        own = part.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        codes = np.unique(codes * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return codes


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    flips, factors = rng.integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64)
    return mix(flips), mix(factors) | np.uint64(1)


def signatures(distinct: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row 2 x PERMUTATIONS values of 16 bits: the ends of its shingles under each permutation."""
    flips, factors = _permutations()
    out = np.zeros((len(sizes), 2 * PERMUTATIONS), np.uint16)
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    for j in range(PERMUTATIONS if len(starts) else 0):
        value = (distinct ^ flips[j]) * factors[j]
        for end, least in ((0, np.minimum), (1, np.maximum)):
            out[some, 2 * j + end] = (mix(least.reduceat(value, starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def _sets_of(batch: pa.RecordBatch, words: int):
    """Chunks of a batch as first row, last row, distinct shingles and their number in each row."""
    raw, bounds = text_bytes(batch.column("text"))
    for first, last in groups_of_rows(bounds, CHUNK_BYTES):
        part, inner = raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        hashes, _, counts = word_hashes(part, inner)
        yield first, last, *shingle_sets(*shingle_hashes(hashes, counts, words))


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, distinct, sizes in _sets_of(batch, words):
                sig = signatures(distinct, sizes).view(np.int64)
                ends = np.cumsum(sizes)
                sums = [np.concatenate([[0], np.cumsum(mix(distinct ^ np.uint64(k)))]).astype(np.uint64) for k in (1, 2)]
                keys = [(s[ends] - s[ends - sizes]).view(np.int64) for s in sums]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, sig.shape[1], dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.array(sizes, pa.int64()), *map(pa.array, keys), lists], ["id", "n", "k1", "k2", "sig"])

    return run


def _shingle_arrays(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, distinct, sizes in _sets_of(batch, words):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(distinct.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), lists], ["id", "set"])

    return run


def _may_link(values: np.ndarray, size: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, percent: int):
    """Pairs (i, j) of different components whose sizes and signatures allow the threshold.

    A pair is reported in its first common band only. The bound on the estimate lies four standard
    deviations below the threshold.
    """
    p = percent / 100
    least = (p - 4 * np.sqrt(p * (1 - p) / values.shape[1])) * values.shape[1]
    bands = values.view(np.uint64)
    step = max(1, (1 << 24) // max(1, len(right) * values.shape[1]))
    for at in range(0, len(left), step):
        i, j = np.meshgrid(left[at : at + step], right, indexing="ij")
        ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            close = (values[a] == values[b]).sum(1) >= least
            a, b = a[close], b[close]
            new = ~(bands[a, :band] == bands[b, :band]).any(1)
            yield a[new], b[new]


class _Joined:
    """Links confirmed inside a block pair; components that have been linked are compared no more."""

    def __init__(self, sets: pa.ListArray, percent: int):
        self.values, self.bounds, self.percent = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())]), percent
        self.parent: dict[int, int] = {}

    def _root(self, code: int) -> int:
        while (up := self.parent.get(code, code)) != code:
            code = up
        return code

    def confirm(self, a: np.ndarray, b: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        true = []
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self._root(int(codes[i])), self._root(int(codes[j]))
            if x == y:
                continue
            left, right = self.values[self.bounds[i] : self.bounds[i + 1]], self.values[self.bounds[j] : self.bounds[j + 1]]
            both = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * both >= self.percent * (len(left) + len(right) - both):
                self.parent[max(x, y)] = min(x, y)
                true.append(k)
        return a[true], b[true]


def _cross_pairs(percent: int):
    """Rows sorted by bucket and block pair in, pairs out; one block pair is held at a time.

    Where rows carry their sets the pairs are confirmed links, otherwise candidates.
    """

    def block(rows: pa.Table):
        ids, comp, size = (rows.column(c).combine_chunks() for c in ("id", "comp", "n"))
        values = rows.column("sig").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(len(ids), -1)
        codes, side = _codes(comp), rows.column("own").to_numpy()
        lo, hi, band = rows["lo"][0].as_py(), rows["hi"][0].as_py(), rows["band"][0].as_py()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        sets = rows.column("set").combine_chunks() if "set" in rows.column_names else None
        links = _Joined(sets, percent) if sets is not None else None
        for a, b in _may_link(values, size.to_numpy(), codes, left, right, band, percent):
            if lo == hi:
                a, b = a[a < b], b[a < b]
            if links is not None:
                a, b = links.confirm(a, b, codes)
            if len(a):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = [table.column(c).to_numpy() for c in ("band", "key", "lo", "hi")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(("band", "key", "lo", "hi"), keys, strict=True)):
                yield from block(pa.concat_tables(held))
                held = []
            for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                yield from block(pa.concat_tables([*held, table.slice(a, b - a)]))
                held = []
            held.append(table.slice(cuts[-1] if len(cuts) else 0))
        if held:
            yield from block(pa.concat_tables(held))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    return joined.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """One row per document: its key ``id``, its number of shingles ``n`` and ``lead``, the key of the smallest of its component."""
    kind = key_type(docs.schema[id_col].dataType)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    texts = docs.select(document_key(own, text).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    id_field = T.StructField("id", kind)
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    signed = T.StructType([id_field, T.StructField("n", long), T.StructField("k1", long), T.StructField("k2", long), T.StructField("sig", longs)])
    rows = materialise(texts.mapInArrow(_sign(words), signed), "signed")

    # Equal sets are one node: the smallest id stands for them.
    owners = rows.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"))
    nodes = rows.join(owners, ["n", "k1", "k2"]).filter("id = rep").dropDuplicates(["id"]).select("id", "n", "sig")
    nodes = materialise(nodes, "nodes")
    members = nodes.select("id", F.posexplode(F.slice("sig", 1, BANDS)).alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1")
    members = materialise(members.join(buckets, ["band", "key"]), "members")

    sets_type = T.StructType([id_field, T.StructField("set", longs)])
    wanted = members.select("id").distinct()
    sets = materialise(texts.join(wanted, "id", "left_semi").mapInArrow(_shingle_arrays(words), sets_type), "sets")

    stars = members.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(_confirmed(stars, sets, percent), "links")
    comps = connected_components(links)

    placed = members.join(comps, members["id"] == comps["node"], "left").select("band", "key", "id", "size", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("band", "key")
    open_ = placed.join(mixed, ["band", "key"]).join(nodes, "id")
    pair_type = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    keys = ["band", "key", "lo", "hi"]

    def crossed(rows_: DataFrame) -> DataFrame:
        return rows_.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cross_pairs(percent), pair_type).distinct()

    columns = ["own", "id", "comp", "n", "sig"]
    small = open_.filter(F.col("size") <= SMALL).select("band", "key", *[F.lit(0).alias(c) for c in ("lo", "hi", "own")], *columns[1:])
    large = open_.filter(F.col("size") > SMALL).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, "id")
    large = large.select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *columns, "set")
    more = _confirmed(materialise(crossed(small), "pairs"), sets, percent).unionByName(materialise(crossed(large), "links"))
    comps = connected_components(links.unionByName(more))

    labelled = rows.select("id", "n", "k1", "k2").join(owners, ["n", "k1", "k2"], "left")
    labelled = labelled.join(comps, labelled["rep"] == comps["node"], "left")
    return labelled.select("id", "n", F.coalesce("component", "rep", "id").alias("lead"))


def group_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``kept``."""
    return _labelled(docs, id_col, text_col, words, percent).select(
        F.col("id.id").alias(id_col), F.col("n").alias("n_shingles"), F.col("lead.id").alias("component_id"), (F.col("id") == F.col("lead")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their group, with the columns they came with."""
    gone = _labelled(docs, id_col, text_col).filter("id <> lead").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, document_key(docs[id_col], docs[text_col]) == gone["_gone"], "left_anti")
