"""Line dedup by winnowing over line hashes.

Every line has a hash; of any ``run`` neighbouring lines the one with the smallest hash (the leftmost
of equals) is a fingerprint, so a run of that many lines that stands in two places has the same
fingerprint in both. Fingerprints that occur once are dropped. The others are extended both ways by
the hashes around them, which gives the strings of ``run`` lines through them; a string that already
stands earlier (by document id, then line) is a repeat, overlapping repeats join into longer runs,
and their lines are deleted. Strings are judged on the input, not on what is left.

With ``alone`` given, a line of more than that many words is a string by itself, whatever stands around
it: its later repeats go between different neighbours and in one-line documents too. Without it, a
repeated line stays wherever no neighbour repeats with it.

Hot lines: counts and earliest places are aggregates that combine before the shuffle, and the joins
back are ordinary ones that Spark splits; no task sees all places of a line.

Defined cases: lines end at a line feed, a null text is one empty line, a text of fewer than ``run``
lines stays whole but for its long lines; words are parted by ASCII white space; blank lines count like others; rows that repeat an id and a text are one
document and come out each; a null id comes after all others; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 2
#: Words above which a line counts by itself, where this is asked for.
LONG = 50


def _lanes(line) -> list:
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(5), line).alias("b")]


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Rows ``doc``, ``line``, ``print`` and ``around`` (hashes of the lines up to run - 1 away) with ``lead`` of them before.

    ``docs`` has ``doc``, a struct that orders documents, and ``text``.
    """
    hashed = F.transform(F.split("text", "\n"), lambda x: F.struct(*_lanes(x)))
    rows = docs.select("doc", hashed.alias("h")).filter(F.size("h") >= run)

    def least(i):
        window = F.transform(F.slice("h", i + 1, run), lambda s: s["a"])
        return (i + F.array_position(window, F.array_min(window)) - 1).cast("int")

    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), least))
    rows = rows.withColumn("line", F.explode(places))
    first = F.greatest(F.col("line") - (run - 1), F.lit(0))
    last = F.least(F.col("line") + run, F.size("h"))
    return rows.select("doc", "line", F.get("h", F.col("line"))["a"].alias("print"), F.slice("h", first + 1, last - first).alias("around"), (F.col("line") - first).alias("lead"))


def repeated_strings(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc`` and ``start`` of every string of ``run`` lines that stands earlier too."""
    prints = fingerprints(docs, run)
    common = prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    prints = prints.join(common, "print")
    starts = F.sequence(F.greatest(F.lit(0), F.col("lead") - (run - 1)), F.least(F.col("lead"), F.size("around") - run))
    strings = prints.select("doc", "line", "around", "lead", F.explode(starts).alias("at"))
    named = F.slice("around", F.col("at") + 1, run)
    lanes = [F.xxhash64(F.transform(named, lambda s: s["a"])).alias("x"), F.xxhash64(F.transform(named, lambda s: s["b"])).alias("y")]
    strings = strings.select("doc", (F.col("line") - F.col("lead") + F.col("at")).alias("start"), *lanes)
    return _later(strings)


def _later(strings: DataFrame) -> DataFrame:
    """``doc`` and ``start`` of the strings (hashes ``x``, ``y``) that stand earlier too."""
    earliest = strings.groupBy("x", "y").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = F.struct("doc", "start") > F.col("first")
    return strings.join(earliest, ["x", "y"]).filter(later).select("doc", "start")


def repeated_long_lines(docs: DataFrame, words: int = LONG) -> DataFrame:
    """``doc`` and ``start`` of every line of more than ``words`` words that stands earlier too."""
    long = rf"^\s*+(?:\S++\s++){{{words}}}\S"
    hashed = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(long), F.struct(*_lanes(x))))
    lines = docs.select("doc", F.posexplode(hashed).alias("start", "h")).filter("h is not null").select("doc", "start", F.col("h.a").alias("x"), F.col("h.b").alias("y"))
    return _later(lines)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, alone: int | None = None) -> DataFrame:
    """One row per document: its id, ``n_lines``, ``runs`` (deleted [start, end) lines) and ``kept`` (the text that remains).

    ``alone``: lines of more words than this are deleted as repeats by themselves, too.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.col(f"`{id_col}`")
    order = F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64(text).alias("tag"))
    rows = docs.select(order.alias("doc"), text.alias("text"))
    gone = repeated_strings(rows, run).select("doc", "start", F.lit(run).alias("size"))
    if alone is not None:
        gone = gone.unionByName(repeated_long_lines(rows, alone).select("doc", "start", F.lit(1).alias("size")))
    gone = gone.groupBy("doc").agg(F.collect_set(F.struct("start", "size")).alias("gone"))
    joined = rows.join(gone, "doc", "left").select(F.col("doc.id").alias("id"), "text", F.col("gone.start").alias("starts"), F.col("gone.size").alias("sizes"))
    kind = docs.schema[id_col].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_lines", T.LongType()), T.StructField("runs", T.ArrayType(span)), T.StructField("kept", T.StringType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for value, starts, counts in zip(batch.column("text"), batch.column("starts"), batch.column("sizes"), strict=True):
                lines = value.as_py().split("\n")
                sizes.append(len(lines))
                lost = np.zeros(len(lines) + 2, np.int64)
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    np.add.at(lost, at + 1, 1)
                    np.add.at(lost, np.minimum(at + counts.values.to_numpy() + 1, len(lines) + 1), -1)
                    lost = np.cumsum(lost)
                lost = (lost > 0).astype(np.int8)
                edges = np.diff(lost[: len(lines) + 1], append=0)
                begin, end = np.flatnonzero(edges[:-1] > 0), np.flatnonzero(edges < 0)
                runs.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)])
                kept.append("\n".join(x for x, g in zip(lines, lost[1:], strict=False) if not g) if starts.is_valid else value.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(runs, arrow_span), pa.array(kept, pa.string())], ["id", "n_lines", "runs", "kept"])

    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
