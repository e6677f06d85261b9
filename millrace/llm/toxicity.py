"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The smallest sentences that carry an insult are single words, so words are the strings compared. Two
words are alike as far as they share subsequences of three characters, gaps counting less the wider
they are; a letter put in, left out or replaced by a digit, a full stop between letters or letters
spaced apart leave most subsequences standing. The kernel against a few hundred landmark words gives
each word a Nyström vector, and a linear machine on these vectors separates words that mark toxic
documents from others. Since the machine is linear in the landmarks and the kernel in its
subsequences, the trained model is one weight for each subsequence, and scoring reads a text once.
A document's three largest margins and its number of insults give the score, by logistic regression.

Only documents are labelled. Words of toxic documents count as insults where two parts of them,
four or five characters long, are marks; if one word makes up most uses of a mark, it counts for
that word only. A mark follows at least ``LEAST_USES`` different words in sampled toxic documents (and as many as
``LEAST_SHARE`` of these) and is far more frequent there than in clean ones. Words of clean documents
are negatives: those with such parts, a draw of all, and twice the ones a first machine mistakes.

The training sample is bounded: at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` documents, ``WORDS`` words
of each kind. Scores read every whole text.

Defined cases: a null or empty text is scored like any other, by a document without words; repeated
label rows count as toxic if one says so; labels that are null or without a document teach nothing;
with no toxic or no clean training document every score is 0; extra columns are ignored; repeated ids
are separate texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .bytesio import groups_of_rows, text_bytes

TOXIC_DOCS = 1500
CLEAN_DOCS = 3000
WORDS = 6000
LANDMARKS = 192
LEAST_USES = 10
LEAST_SHARE = 0.015
MINING = 2
LEAST_ODDS = 2.5
SPAN = 6
DECAY = 0.6
CHUNK_BYTES = 1 << 20

_START, _DROP, _GAP = 63, 254, 255


def _alphabet() -> np.ndarray:
    """Byte to letter: a-z, digits that stand for letters, 32 classes of other letters' last bytes."""
    table = np.full(256, _DROP, np.uint8)
    for k in range(26):
        table[97 + k] = table[65 + k] = 1 + k
    for digit, letter in zip("013457", "oieast", strict=True):
        table[ord(digit)] = table[ord(letter)]
    table[0x80:0xC0] = 30 + (np.arange(0x80, 0xC0) & 31)
    table[[32, 9, 10, 11, 12, 13]] = _GAP
    return table


ALPHABET = _alphabet()
#: Offsets of the second and third character of a subsequence.
SHAPES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _stream(raw: np.ndarray, bounds: np.ndarray):
    """Letters of all words behind a start mark, the word of each, and the row of each word."""
    code = ALPHABET[raw]
    at = np.flatnonzero(code < 64)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    row = np.searchsorted(bounds, at, side="right") - 1
    token = np.cumsum(code == _GAP)[at] + row
    first = np.ones(len(at), bool)
    first[1:] = token[1:] != token[:-1]
    heads = np.flatnonzero(first)
    single = np.diff(np.concatenate([heads, [len(at)]])) == 1
    joined = np.zeros(len(heads), bool)  # letters spaced apart are one word
    joined[1:] = single[1:] & single[:-1] & (row[heads[1:]] == row[heads[:-1]])
    first[heads[joined]] = False
    word = np.cumsum(first) - 1
    place = np.arange(len(at)) + word + 1
    letters = np.full(len(at) + int(word[-1]) + 1, _START, np.int32)
    letters[place] = code[at]
    words = np.zeros(len(letters), np.int32)
    words[place] = word
    words[place[first] - 1] = word[first]
    return letters, words, row[first]


def _occurrences(letters: np.ndarray, words: np.ndarray):
    """For each shape: where it fits into a word, the code of the subsequence, and its weight."""
    for a, b in SHAPES:
        if len(letters) > b:
            fits = words[b:] == words[:-b]
            yield fits, letters[:-b] * 4096 + letters[a : len(letters) - b + a] * 64 + letters[b:], DECAY ** (b - 2)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each subsequence
    bias: float
    scale: np.ndarray  # mean and deviation of the document features
    slopes: np.ndarray  # of the document features, and their constant


def margins(raw: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every word from the separating plane, and the words of each row."""
    letters, words, row = _stream(raw, bounds)
    total, norm = np.zeros(len(letters), np.float32), np.full(len(letters), 1e-9, np.float32)
    for fits, code, weight in _occurrences(letters, words):
        total[: len(code)] += np.where(fits, weights[code], np.float32(0)) * np.float32(weight)
        norm[: len(code)] += fits * np.float32(weight * weight)
    if not len(row):
        return np.zeros(0, np.float32), np.zeros(len(bounds) - 1, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    value = np.add.reduceat(total, heads) / np.sqrt(np.add.reduceat(norm, heads)) + np.float32(bias)
    return value, np.bincount(row, minlength=len(bounds) - 1)


def features(raw: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Of each row: its three largest margins, and logarithms of its insults and words."""
    value, sizes = margins(raw, bounds, weights, bias)
    n = len(sizes)
    out = np.full((n, 5), -1.5)
    starts, some = np.cumsum(sizes) - sizes, sizes > 0
    row = np.repeat(np.arange(n), sizes)
    rest = np.clip(value, -1.5, 1.5)
    for k in range(3 if len(value) else 0):
        top = np.maximum.reduceat(rest, starts[some])
        out[some, k] = top
        best = np.flatnonzero(rest == np.repeat(top, sizes[some]))
        _, at = np.unique(row[best], return_index=True)
        rest[best[at]] = -1.5
    out[:, 3] = np.log1p(np.bincount(row, weights=value > 0, minlength=n)) if len(value) else 0.0
    out[:, 4] = np.log1p(sizes)
    return out


def _kernel(words: list[str], compact: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Normalised kernel of words against landmarks, whose subsequence weights are the columns."""
    raw = np.frombuffer("\n".join(words).encode(), np.uint8)
    letters, index, _ = _stream(raw, np.array([0, len(raw)]))
    n, width = len(words), len(columns)
    out, norm = np.zeros((n, columns.shape[1]), np.float32), np.full(n, 1e-9)
    found = []
    for fits, code, weight in _occurrences(letters, index):
        own = index[: len(code)]
        norm += np.bincount(own[fits], minlength=n) * weight * weight
        use = fits & (compact[code] >= 0)
        found.append((own[use], compact[code[use]], weight))
    for first in range(0, n, 1000):  # words in rows, subsequences in columns, for some words at a time
        last = min(first + 1000, n)
        cells, weights = [], []
        for own, code, weight in found:
            a, b = np.searchsorted(own, [first, last])
            cells.append((own[a:b] - first).astype(np.int64) * width + code[a:b])
            weights.append(np.full(b - a, weight))
        counts = np.bincount(np.concatenate(cells), np.concatenate(weights), minlength=(last - first) * width)
        out[first:last] = counts.reshape(last - first, width).astype(np.float32) @ columns
    return out / np.sqrt(norm)[:, None].astype(np.float32)


def train_words(insults: list[str], others: list[str], penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weight of every subsequence and the bias, from two lists of words (letters a machine can read)."""
    half = LANDMARKS // 2
    spread = lambda words: words[:: max(1, len(words) // half)][:half]
    landmarks = sorted({*spread(insults), *spread(others)})
    raw = np.frombuffer("\n".join(landmarks).encode(), np.uint8)
    letters, index, _ = _stream(raw, np.array([0, len(raw)]))
    found = [(index[: len(c)][f], c[f], w) for f, c, w in _occurrences(letters, index)]
    codes = np.unique(np.concatenate([c for _, c, _ in found]))
    compact = np.full(64**3, -1, np.int32)
    compact[codes] = np.arange(len(codes))
    columns, norm = np.zeros((len(codes), len(landmarks)), np.float32), np.full(len(landmarks), 1e-9)
    for word, code, weight in found:
        np.add.at(columns, (compact[code], word), weight)
        np.add.at(norm, word, weight * weight)
    columns /= np.sqrt(norm)[None, :].astype(np.float32)

    values, vectors = np.linalg.eigh(columns.T.astype(float) @ columns)
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])  # kernel row to Nyström vector
    x = np.hstack([np.concatenate([_kernel(insults, compact, columns), _kernel(others, compact, columns)]) @ root, np.ones((len(insults) + len(others), 1))])
    y = np.concatenate([np.ones(len(insults)), -np.ones(len(others))])
    cost = np.where(y > 0, penalty * len(others) / max(1, len(insults)), penalty).clip(penalty, 10 * penalty)
    plane, active = np.zeros(x.shape[1]), None
    for _ in range(50):  # Newton steps of the squared hinge: its active set settles after a few
        now = y * (x @ plane) < 1
        if active is not None and (now == active).all():
            break
        active = now
        part = x[active] * cost[active, None]
        plane = np.linalg.solve(np.eye(x.shape[1]) + part.T @ x[active], part.T @ y[active])
    weights = np.zeros(64**3, np.float32)
    weights[codes] = columns @ (root @ plane[:-1])
    return weights, float(plane[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.stack([x.mean(0), x.std(0) + 1e-6])
    z = np.hstack([(x - scale[0]) / scale[1], np.ones((len(x), 1))])
    slopes, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ slopes))
        slopes += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ slopes)
    return scale, slopes


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``toxic`` and ``text`` of a bounded number of labelled documents with different texts."""
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    drawn = [known.filter(F.col("toxic") == kind).orderBy("h", "doc_id").limit(most).select("doc_id", "toxic") for kind, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most TOXIC_DOCS + CLEAN_DOCS rows
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(drawn, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def _word_lists(sample: DataFrame, least: int) -> tuple[list[str], list[str], DataFrame]:
    """Insults and other words. Parts of words are counted by the words that they follow, so that
    near copies of a text, which repeat their neighbours too, count once."""
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", "")
    tokens = sample.select("toxic", F.split(plain, r"\s+").alias("w")).filter("size(w) > 1")
    follows = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.col("w")[i - 1].alias("before"), F.col("w")[i].alias("word")))
    uses = tokens.select("toxic", F.explode(follows).alias("x")).select("toxic", "x.*").filter("length(word) between 3 and 60").distinct()
    words = uses.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    words = materialise(words, "words")
    totals = words.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    marked = F.concat(F.lit("^"), "word")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n)))
    parts = F.array_distinct(F.when(F.length("word") > 3, F.concat(cut(4), cut(5))).otherwise(cut(4)))
    grams = words.withColumn("gram", F.explode(parts))
    counts = grams.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (totals["p"] + 1)) - F.log((F.col("n") + 0.5) / (totals["n"] + 1))
    marks = counts.filter((F.col("p") >= least) & (odds >= LEAST_ODDS)).orderBy(F.desc(odds), "gram").limit(WORDS).select("gram")
    held = grams.join(F.broadcast(marks), "gram")
    tops = held.groupBy("gram").agg(F.max_by("word", F.struct("p", "word")).alias("top"), (F.max("p") > 0.5 * F.sum("p")).alias("one"))
    found = held.join(F.broadcast(tops), "gram").filter("not one or word = top").groupBy("word", "p", "n").count().filter("count > 1")
    order = [F.xxhash64("word"), "word"]
    drawn = lambda df, n: [r["word"] for r in df.select("word").orderBy(*order).limit(n).collect()]
    clean = {*drawn(found.filter("n > 0"), WORDS), *drawn(words.filter("n > 0"), 2 * WORDS)}
    return [w for w in drawn(found.filter("p > 0"), WORDS) if w not in clean], sorted(clean, key=hash_order), words


def _hardest(words: DataFrame, weights: np.ndarray, bias: float) -> list[str]:
    """Words of clean documents that the machine takes for insults, or nearly so; the worst first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_bytes(batch.column("word"))
            value, sizes = margins(raw[bounds[0] : bounds[-1]], bounds - bounds[0], weights, bias)
            found = np.full(len(sizes), -9.0)
            found[sizes > 0] = np.maximum.reduceat(value, (np.cumsum(sizes) - sizes)[sizes > 0]) if len(value) else -9.0
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found)], ["word", "margin"])

    scored = words.filter("n > 0").select("word").mapInArrow(run, "word string, margin double").filter("margin > -0.5")
    return [r["word"] for r in scored.orderBy(F.desc("margin"), "word").limit(WORDS // 2).collect()]


def hash_order(word: str) -> int:
    value = 0xCBF29CE484222325
    for b in word.encode():
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from the given labels (``doc_id``, ``toxic`` 0 or 1); None where one kind is missing."""
    sample = materialise(_sample(docs, labels, id_col, text_col), "sample")
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    insults, others, words = _word_lists(sample, max(LEAST_USES, round(LEAST_SHARE * counts[1])))
    if not insults or not others:
        return None
    weights, bias = train_words(insults, others)
    for _ in range(MINING):
        hard = _hardest(words, weights, bias)
        others = sorted({*others, *hard}, key=hash_order)
        weights, bias = train_words(insults, others)
    shaped = sample.select("toxic", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_featured(weights, bias), "toxic int, f array<double>")
    rows = shaped.collect()  # five numbers for each sampled document
    x, y = np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    scale, slopes = _logistic(x, y)
    return Model(weights, bias, scale, slopes)


def _feature_chunks(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> np.ndarray:
    raw, bounds = text_bytes(batch.column("text"))
    parts = [features(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], weights, bias) for a, b in groups_of_rows(bounds, CHUNK_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, 5))


def _featured(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _feature_chunks(batch, weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["toxic", "f"])

    return run


def _scored(docs: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """``row`` (all columns of a document) and its ``score``."""
    payload = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    if model is None:
        return docs.select(payload.alias("row"), F.lit(0.0).alias("score"))
    shaped = docs.select(payload.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([shaped.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _feature_chunks(batch, model.weights, model.bias)
            z = ((found - model.scale[0]) / model.scale[1]) @ model.slopes[:-1] + model.slopes[-1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["row", "score"])

    return shaped.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "_score") -> DataFrame:
    """The documents with their toxicity (0 to 1) in ``out``, which replaces a column of that name."""
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != out]
    return _scored(docs, model, text_col).select(*columns, F.col("score").alias(out))


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The documents that score below the bound, with the columns they came with."""
    return _scored(docs, model, text_col).filter(F.col("score") < below).select("row.*")
