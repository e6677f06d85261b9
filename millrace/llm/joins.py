"""A join whose hot keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many of all rows is hot; there are fewer hot keys than this.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], n: int, weight: str) -> DataFrame:
    """Left join of ``n`` rows to a table with one row for each key, which tells in ``weight`` how many rows have it.

    Hot keys are met by a broadcast of their rows of the table, fewer than ``HOT_SHARE``; the others by a shuffle.
    """
    hot = F.col(weight) * HOT_SHARE > n
    got = [c for c in table.columns if c not in on and c != weight]
    few = table.filter(hot).select(*on, *[F.col(c).alias(f"_hot_{c}") for c in got], F.lit(True).alias("_hot"))
    first = rows.join(F.broadcast(few), on, "left")
    rest = first.filter("_hot is null").select(*rows.columns).join(table.filter(~hot).drop(weight), on, "left")
    return first.filter("_hot").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in got]).unionByName(rest.select(*rows.columns, *got))
