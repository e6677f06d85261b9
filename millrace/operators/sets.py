"""Sort, limit, sample, set operations and chained SQL steps."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import need, need_columns
from ..functions.keys import hash_share
from .windows import order_columns, order_name, row_fallback


def sort(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Total order. The row fingerprint ends the key, so equal keys still spread over partitions."""
    need(bool(order), "MISSING_ORDER", "sort needs columns")
    need_columns(df, [order_name(o) for o in order])
    return df.orderBy(*order_columns(order), row_fallback(df))


def limit(df: DataFrame, rows: int = 1000, order: Sequence[str] = ()) -> DataFrame:
    """First rows; with an order Spark keeps only the top rows of every partition."""
    need(rows >= 0, "INVALID_LIMIT", str(rows))
    return (sort(df, order) if order else df).limit(rows)


def sample(df: DataFrame, fraction: float, *, key: str | None = None, seed: int = 42) -> DataFrame:
    """Share of the rows (a number above 1 is a percentage).

    With a key the choice depends on the key alone: repeatable over any layout.
    """
    share = fraction / 100.0 if fraction > 1 else fraction
    need(0 <= share <= 1, "INVALID_FRACTION", str(fraction))
    if key:
        need_columns(df, [key])
        return df.filter(hash_share(key) < share)
    return df.sample(withReplacement=False, fraction=share, seed=seed)


def union_all(frames: Sequence[DataFrame], *, positional: bool = True, allow_missing: bool = False) -> DataFrame:
    """All rows under the first input's names: columns meet by position, as in SQL, or by name.

    ``allow_missing`` joins by name and fills columns that an input lacks with nulls.
    """
    need(bool(frames), "MISSING_INPUT", "union needs inputs")
    positional = positional and not allow_missing
    widths = {len(f.columns) for f in frames}
    need(not positional or len(widths) == 1, "COLUMN_COUNT_DIFFERS", f"{sorted(widths)}")
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f) if positional else out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def union_distinct(frames: Sequence[DataFrame], *, positional: bool = True) -> DataFrame:
    return union_all(frames, positional=positional).distinct()


def sql_chain(df: DataFrame, steps: Sequence[tuple[str, str]], extra: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Named SQL steps over the relation ``input`` and the steps before; the last one is the result."""
    steps = [(n, q) for n, q in steps if q and q.strip()]
    if not steps:
        return df
    relations = {"input": df, **(extra or {})}
    views, ctes = [], []
    for name, frame in relations.items():
        views.append(f"chain_{uuid.uuid4().hex}")
        frame.createOrReplaceTempView(views[-1])
        ctes.append(f"{name} AS (SELECT * FROM {views[-1]})")
    last = "input"
    for name, query in steps:
        last = re.sub(r"\W+", "_", name).lower()
        body = query.strip().rstrip(";")
        ctes.append(f"{last} AS ({body})")
    out = df.sparkSession.sql(f"WITH {', '.join(ctes)} SELECT * FROM {last}")
    for view in views:  # the analysed plan no longer needs the names
        df.sparkSession.catalog.dropTempView(view)
    lowered = [c.lower() for c in out.columns]
    need(len(set(lowered)) == len(lowered), "DUPLICATE_OUTPUT", f"output names repeat: {out.columns}")
    unnamed = [c for c in out.columns if "(" in c]
    need(not unnamed, "UNNAMED_OUTPUT", f"alias these columns: {unnamed}")
    return out
