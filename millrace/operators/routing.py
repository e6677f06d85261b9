"""Conditional routing of rows to named outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import need


def _matched(expression: str) -> Column:
    return F.coalesce(F.expr(expression), F.lit(False))


def split_routes(df: DataFrame, routes: Mapping[str, str], default: str = "default") -> dict[str, DataFrame]:
    """Independent filters plus a default of rows that matched none; null conditions do not match."""
    need(bool(routes), "MISSING_ROUTES", "routing needs at least one route")
    need(default not in routes, "ROUTE_CONFIG_INVALID", f"{default} is the default output")
    out = {name: df.filter(_matched(e)) for name, e in routes.items()}
    rest = F.lit(True)
    for e in routes.values():
        rest = rest & ~_matched(e)
    out[default] = df.filter(rest)
    return out


def label_routes(df: DataFrame, routes: Sequence[tuple[str, str]], column: str = "route") -> DataFrame:
    """First matching route wins; exactly one route carries the predicate ``default``."""
    defaults = [n for n, e in routes if e.strip().lower() == "default"]
    need(len(defaults) == 1, "ROUTE_CONFIG_INVALID", "exactly one default route is needed")
    label: Column | None = None
    for name, e in routes:
        if e.strip().lower() == "default":
            continue
        label = F.when(_matched(e), F.lit(name)) if label is None else label.when(_matched(e), F.lit(name))
    label = F.lit(defaults[0]) if label is None else label.otherwise(F.lit(defaults[0]))
    return df.withColumn(column, label)


def route_tags(df: DataFrame, routes: Mapping[str, str], default: str = "default", column: str = "route") -> DataFrame:
    """All outputs of an independent split in one pass: one row per (input row, matching route)."""
    marks = F.array(*[F.when(_matched(e), F.lit(n)) for n, e in routes.items()])
    hits = F.filter(marks, lambda x: x.isNotNull())
    tags = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))
    return df.withColumn(column, F.explode(tags))
