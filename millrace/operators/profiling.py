"""Column profiles over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import need


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, value, n`` for every distinct trimmed text value; blank counts as null.

    Values combine on the map side, so a dominant value travels as one row per task.
    """
    need(bool(columns), "MISSING_COLUMNS", "profile needs columns")
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns]
    )
    rows = df.select(F.explode(cells).alias("c")).select("c.column_name", F.when(F.col("c.value") != "", F.col("c.value")).alias("value"))
    return rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


#: Longer values are told apart by length and digest, so that whole texts are never shuffled.
DIGEST_FROM = 64


def _cell(column: str, declared: str) -> Column:
    """What a profile needs of one value: itself or its digest, its length, whether it fits its declared type."""
    text = F.trim(F.col(f"`{column}`").cast("string"))
    value = F.when(text != "", text)
    short = F.when(F.length(value) > DIGEST_FROM, F.sha2(value, 256)).otherwise(value)
    valid = F.lit(True) if declared == "string" else F.coalesce(value.try_cast(declared).isNotNull(), F.lit(False))
    return F.struct(F.lit(column).alias("column_name"), short.alias("value"), F.length(value).alias("size"), valid.alias("valid"))


def profile(df: DataFrame, declared: Mapping[str, str] | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Per column: rows, nulls, distinct values, longest text, share valid for its declared type, top value."""
    names = list(columns) or df.columns
    need(bool(names), "MISSING_COLUMNS", "profile needs columns")
    types = {c: (declared or {}).get(c, "string") for c in names}
    cells = [_cell(c, types[c]) for c in names]
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("column_name", "value", "size", "valid").agg(F.count(F.lit(1)).alias("n"))
    given, valid = F.col("value").isNotNull(), F.col("valid")
    out = counts.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~given, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("max_length"),
        F.coalesce(F.sum(F.when(given & valid, F.col("n"))), F.lit(0)).alias("valid_count"),
        F.coalesce(F.max(F.when(given, F.col("n"))), F.lit(0)).alias("top_count"),
    )
    return out.select(
        "*",
        F.round(F.try_divide(F.col("null_count"), F.col("row_count")), 6).alias("null_rate"),
        F.round(F.try_divide(F.col("valid_count"), F.col("row_count") - F.col("null_count")), 6).alias("valid_share"),
    )


def top_values(df: DataFrame, columns: Sequence[str] = (), top: int = 3) -> DataFrame:
    """The most frequent values per column; ties go to the smaller text."""
    counts = value_counts(df, list(columns) or df.columns).filter("value IS NOT NULL")
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)


# Fixed limits for profile warnings.
NULL_RATE_LIMIT = 0.8
DOMINANT_LIMIT = 0.9


def profile_flags(profiled: DataFrame) -> DataFrame:
    """One row per column and warning: mostly null, dominated by one value, values off the declared type."""
    warnings = F.filter(
        F.array(
            F.when(F.col("null_rate") >= NULL_RATE_LIMIT, F.lit("mostly_null")),
            F.when(F.col("top_count") >= DOMINANT_LIMIT * F.col("row_count"), F.lit("dominant_value")),
            F.when(F.col("valid_count") < F.col("row_count") - F.col("null_count"), F.lit("type_mismatch")),
        ),
        lambda x: x.isNotNull(),
    )
    return profiled.select("column_name", F.explode(warnings).alias("warning"))


def empty_rows(df: DataFrame) -> DataFrame:
    """Rows in which every column is null or blank."""
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & (F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == "")
    return df.filter(blank)
