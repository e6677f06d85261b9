"""Language identification by compression.

Each language gets a raw-content zstandard dictionary: lines of its training texts, drawn by hash.
A text is compressed with every dictionary; the language whose dictionary leaves the fewest bytes
wins. ``score`` turns the margin over the runner-up into a confidence, and ``rejected`` marks
margins below a bound, for callers that prefer no answer.

The training sample is bounded: at most ``sample_texts`` different texts and ``dictionary_bytes`` bytes
of lines for each language, however its rows are copied. A language with a training text is never
without a dictionary. Predictions read every whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; ties go to
the language that sorts first; rows without a language teach nothing; with no training rows every
text is ``und``; extra columns are ignored; repeated ids are separate texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DICTIONARY_BYTES = 96 * 1024
SAMPLE_TEXTS = 400
LEVEL = 3
MARGIN = 0.01


def train_dictionaries(docs: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text",
                       dictionary_bytes: int = DICTIONARY_BYTES, sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Raw dictionary content for each language of the rows where ``training`` holds.

    The number of different texts comes first, so the share drawn by hash falls as the table grows; it is
    twice what is needed, and the first ``sample_texts`` in hash order stay. Lines are then taken in
    hash order until the dictionary is full, which is at most some megabytes for all languages.
    """
    rows = docs.filter(training).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter("lang is not null and text is not null and length(trim(text)) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2 * sample_texts / max(n, 1)))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003
    drawn = rows.filter(draw).distinct()
    first = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    drawn = drawn.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample_texts)
    lines = drawn.select("lang", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter("length(line) > 0").select("lang", "line", F.xxhash64("line").alias("h")).distinct()
    order = W.partitionBy("lang").orderBy("h", "line").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(order), F.lit(0))
    taken = lines.withColumn("before", before).filter(F.col("before") < dictionary_bytes).orderBy("lang", "h", "line").collect()
    out: dict[str, list[str]] = {}
    for row in taken:
        out.setdefault(row["lang"], []).append(row["line"])
    return {lang: "\n".join(v).encode()[:dictionary_bytes] for lang, v in sorted(out.items())}


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
                     level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """One row per document: the id, ``lang_pred``, ``score`` in [0, 1] and ``rejected``."""
    langs = sorted(dictionaries)
    text = F.col(f"`{text_col}`")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for lang in langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            preds, scores, rejects = [], [], []
            for value, letters in zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True):
                if not letters or not langs:
                    preds.append("und"), scores.append(0.0), rejects.append(True)
                    continue
                raw = value.as_buffer()
                sizes = np.array([len(c.compress(raw)) for c in coders], float)
                best = int(np.argmin(sizes))
                gap = (np.partition(sizes, 1)[1] - sizes[best]) / sizes[best] if len(langs) > 1 else 1.0
                preds.append(langs[best]), scores.append(float(1 - 0.5 * np.exp(-gap / 0.05))), rejects.append(bool(gap < margin))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejects, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return base.mapInArrow(run, schema)
