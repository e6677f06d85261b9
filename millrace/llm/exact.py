"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over the leading characters of their text and, where
many texts begin alike, a digest (Spark's own range partitioner; splitters stay short however long
the texts are). Ranges are sorted externally by the whole text, and neighbours that compare equal in
full form a group; the windows need no further shuffle. A text that fills more than a
partition's share is found by a count beforehand; its rows are spread over several ranges by a salt
and their keeper comes from one map-side combined aggregate, so no task meets a whole hot group.

Defined cases: a null text equals an empty one; rows that repeat an id and a text form one group and
exactly one of them is kept; null ids lose to any other id; an empty table gives an empty result;
extra columns pass through untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITTER_CHARS = 64


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """``_row`` (all columns), ``_text``, ``_keep``, ``_size`` and ``_kept`` for each row."""
    spark = docs.sparkSession
    best = {"min": F.min, "max": F.max}[keep]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
    )
    digest = F.xxhash64("_text")
    counts = named.groupBy(digest.alias("_digest")).agg(F.count("*").alias("_n"))
    total = docs.count()
    # At most ``parts`` digests can exceed a share of 1 / parts, so this list is bounded.
    hot = {r["_digest"]: r["_n"] for r in counts.filter(F.col("_n") * parts > total).filter("_n > 1").collect()}
    if hot:
        shares = F.create_map(*[F.lit(v) for k, n in hot.items() for v in (k, -(-n * parts // total) + 1)])
        salt = F.coalesce(F.pmod(F.xxhash64("_id"), shares[digest]), F.lit(0)).cast("int")

    laid = named.withColumn("_lead", F.substring("_text", 1, SPLITTER_CHARS)).withColumn("_digest", digest)
    order = ["_lead", "_digest"]
    if hot:
        laid, order = laid.withColumn("_salt", salt), [*order, "_salt"]
    laid = laid.repartitionByRange(*order)
    run = W.partitionBy(*order, "_text")
    first = F.col("_id").asc_nulls_last() if keep == "min" else F.col("_id").desc_nulls_last()
    found = laid.withColumn("_rank", F.row_number().over(run.orderBy(first)))
    found = found.withColumn("_keep", best("_id").over(run)).withColumn("_size", F.count(F.lit(1)).over(run))
    if hot:
        spread = named.filter(digest.isin(list(hot))).groupBy("_text").agg(best("_id").alias("_hot_keep"), F.count("*").alias("_hot_size"))
        spread = spread.select(F.sha2("_text", 256).alias("_hot_sha"), "_hot_keep", "_hot_size")
        found = found.join(F.broadcast(spread), F.sha2("_text", 256) == F.col("_hot_sha"), "left")
        found = found.withColumn("_keep", F.when(F.col("_hot_sha").isNull(), F.col("_keep")).otherwise(F.col("_hot_keep")))
        found = found.withColumn("_size", F.coalesce("_hot_size", "_size"))
    return found.withColumn("_kept", (F.col("_rank") == 1) & F.col("_id").eqNullSafe(F.col("_keep")))


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    return _grouped(docs, id_col, text_col, keep).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.col("_kept").alias("kept"),
        _sha(F.col("_text")).alias("text_sha256"),
    )


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents that stay, with the columns they came with."""
    return _grouped(docs, id_col, text_col, keep).filter("_kept").select("_row.*")
