"""Load patterns over any source frame: snapshots, incremental polls, backfills, readiness."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import need, need_columns
from ..operators.columns import Split
from ..operators.merge import high_water, newer_than


def snapshot_extract(rows: DataFrame, as_of: str, partition: str = "ds") -> Split:
    """Full extract stamped by its as-of; rows without one are rejected.

    Written with a dynamic overwrite of ``ds``, the same as-of run again replaces itself.
    """
    need_columns(rows, [as_of])
    stamped = rows.withColumn(partition, F.col(as_of).cast("date"))
    return Split(stamped.filter(F.col(as_of).isNotNull()).distinct(), rows.filter(F.col(as_of).isNull()))


class Poll(NamedTuple):
    rows: DataFrame
    mark: object


def poll(source: DataFrame, column: str, mark: object) -> Poll:
    """Rows beyond the mark, and the new mark: the largest value seen, or the old one if none."""
    fresh = newer_than(source, column, mark)
    return Poll(fresh, high_water(fresh, column, default=mark))


def plan_chunks(spark: SparkSession, start: date, end: date, days: int) -> DataFrame:
    """``chunk_id, chunk_start, chunk_end`` (inclusive) covering the range in steps of ``days``."""
    need(days > 0 and start <= end, "INVALID_RANGE", f"{start}..{end} by {days}")
    starts = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_dt_interval(F.lit(days)))
    rows = spark.range(1).select(F.posexplode(starts).alias("chunk_id", "chunk_start"))
    return rows.withColumn(
        "chunk_end", F.least(F.date_add("chunk_start", days - 1), F.lit(end).cast("date"))
    )


def with_chunk(rows: DataFrame, day: str, start: date, end: date, days: int) -> DataFrame:
    """Rows of the range with their chunk number: arithmetic on the date, one filtered scan."""
    d = F.col(day).cast("date")
    inside = rows.filter(d.between(F.lit(start), F.lit(end)))
    return inside.withColumn("chunk_id", F.floor(F.datediff(d, F.lit(start)) / days).cast("int"))


def missing_periods(rows: DataFrame, period: Column, expected: Sequence[str]) -> DataFrame:
    """Expected periods (for example months ``yyyy-MM``) without a single row."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(p,) for p in expected], "period string")
    return wanted.join(rows.select(period.alias("period")).distinct(), "period", "left_anti")


def duplicate_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def count_gate(rows: DataFrame, minimum: int = 1, maximum: int | None = None, day: str | None = None, on: date | None = None) -> DataFrame:
    """Readiness by row count, optionally for one date: one verdict row."""
    if day is not None:
        need(on is not None, "MISSING_BUSINESS_DATE", "a dated gate needs its date")
        rows = rows.filter(F.col(day).cast("date") == F.lit(on))
    n = F.count(F.lit(1))
    ready = n >= minimum
    if maximum is not None:
        ready = ready & (n <= maximum)
    return rows.agg(n.alias("row_count"), ready.alias("is_ready"))


def first_arrivals(log: DataFrame, contract: Sequence[str], arrived_at: str) -> DataFrame:
    """First arrival per dataset contract from an append-only log, and how many followed."""
    need_columns(log, [*contract, arrived_at])
    others = [c for c in log.columns if c not in contract]
    first = F.min_by(F.struct(*others), F.struct(F.col(arrived_at), *[F.col(c) for c in others]))
    return log.groupBy(*contract).agg(first.alias("__first"), F.count(F.lit(1)).alias("arrival_count")).select(
        *contract, "__first.*", "arrival_count"
    )


def file_name(pattern: str, business_date: date) -> str:
    """Fill ``{yyyyMMdd}``, ``{yyyy-MM-dd}``, ``{yyyy}``, ``{MM}``, ``{dd}`` in a name pattern."""
    parts = {
        "{yyyyMMdd}": "%Y%m%d", "{yyyy-MM-dd}": "%Y-%m-%d", "{yyyy}": "%Y", "{MM}": "%m", "{dd}": "%d",
    }
    for token, fmt in parts.items():
        pattern = pattern.replace(token, business_date.strftime(fmt))
    return pattern


PATTERN_KINDS = ("template", "glob", "regex")


def match_files(
    files: DataFrame,
    prefix: str,
    pattern: str,
    *,
    kind: str = "template",
    business_date: date | None = None,
    min_bytes: int = 0,
    max_age_minutes: int | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Listed files (``path, length, modificationTime``) directly below the prefix that match."""
    need(kind in PATTERN_KINDS, "INVALID_PATTERN_KIND", kind)
    if business_date is not None:
        pattern = file_name(pattern, business_date)
    head = prefix.rstrip("/") + "/"
    at = F.instr(F.col("path"), head)
    base = F.element_at(F.split("path", "/"), -1)
    directory = F.regexp_replace(F.col("path"), "[^/]*$", "")
    if kind == "regex":
        hit = base.rlike(f"^(?:{pattern})$")
    elif kind == "glob":
        escaped = "".join({"*": "[^/]*", "?": "[^/]"}.get(ch, f"\\{ch}" if not ch.isalnum() else ch) for ch in pattern)
        hit = base.rlike(f"^{escaped}$")
    else:
        hit = base == pattern
    out = files.filter((at > 0) & directory.endswith(head) & hit & (F.col("length") >= min_bytes))
    if max_age_minutes is not None:
        need(now is not None, "MISSING_NOW", "an age limit needs the current time")
        age = F.lit(now).cast("timestamp").cast("long") - F.col("modificationTime").cast("timestamp").cast("long")
        out = out.filter(age <= max_age_minutes * 60)
    return out


def file_readiness(matched: DataFrame, mode: str = "one") -> DataFrame:
    """One verdict row: ``one`` wants exactly one file, ``many`` at least one."""
    need(mode in ("one", "many"), "INVALID_MODE", mode)
    n = F.count(F.lit(1))
    return matched.agg(
        n.alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), (n == 1 if mode == "one" else n >= 1).alias("is_ready")
    )


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Path, length and modification time of landed files; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", "modificationTime")
