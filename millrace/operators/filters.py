"""Row filters. All of them are plain predicates, so Catalyst pushes them into the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import need, need_columns
from ..functions.dates import mnemonic


def filter_sql(df: DataFrame, predicate: str) -> DataFrame:
    need(bool(predicate and predicate.strip()), "MISSING_PREDICATE", "filter needs a predicate")
    return df.filter(F.expr(predicate))


COMPARISONS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "not_like": lambda c, v: ~c.like(v),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def condition(spec: Mapping[str, object]) -> Column:
    op = str(spec["operator"]).lower()
    need(op in COMPARISONS, "INVALID_FILTER_OPERATOR", f"unsupported filter operator: {op}")
    value = spec.get("value")
    if op in ("in", "not_in") and isinstance(value, str):
        value = [v.strip() for v in value.split(",")]
    return COMPARISONS[op](F.col(str(spec["column"])), value)


def filter_conditions(df: DataFrame, conditions: Sequence[Mapping[str, object]]) -> DataFrame:
    """Conditions chained as written, without parentheses: AND binds tighter than OR."""
    if not conditions:
        return df
    need_columns(df, [str(c["column"]) for c in conditions])
    groups: list[Column] = [condition(conditions[0])]
    for spec in conditions[1:]:
        if str(spec.get("logic", "AND")).upper() == "OR":
            groups.append(condition(spec))
        else:
            groups[-1] = groups[-1] & condition(spec)
    predicate = groups[0]
    for g in groups[1:]:
        predicate = predicate | g
    return df.filter(predicate)


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    need(bool(columns), "MISSING_COLUMNS", "needs the columns that must be present")
    return df.dropna(subset=need_columns(df, columns))


CLAUSE_OPS = {
    "=": "eq", "<>": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte",
    "IN": "in", "NOT_IN": "not_in", "LIKE": "like", "IS_NULL": "is_null", "IS_NOT_NULL": "is_not_null",
}


def clause(spec: Mapping[str, object], business_date: date | None = None) -> Column:
    op = CLAUSE_OPS.get(str(spec["op"]).upper())
    if op is None:
        return F.lit(False)
    column = F.col(str(spec["column"]))
    if "date_relative" in spec:
        need(business_date is not None, "MISSING_BUSINESS_DATE", "relative dates need a business date")
        value = mnemonic(str(spec["date_relative"]), F.lit(business_date))
    else:
        value = spec.get("values", spec.get("value"))
    result = COMPARISONS[op](column, value)
    return result | column.isNull() if spec.get("allow_null") else result


def filter_clauses(
    df: DataFrame,
    clauses: Sequence[Mapping[str, object]],
    join_kind: str = "AND",
    business_date: date | None = None,
) -> DataFrame:
    """Independent clauses joined by one connective; an unknown operator matches nothing."""
    need(join_kind.upper() in ("AND", "OR"), "INVALID_JOIN_KIND", join_kind)
    if not clauses:
        return df
    parts = [clause(c, business_date) for c in clauses]
    predicate = parts[0]
    for p in parts[1:]:
        predicate = predicate & p if join_kind.upper() == "AND" else predicate | p
    return df.filter(predicate)


def filter_partition(df: DataFrame, column: str, start: object, end: object | None = None) -> DataFrame:
    """One business date, or an inclusive range of them; prunes partitions when the column is one."""
    need_columns(df, [column])
    if end is None:
        return df.filter(F.col(column) == F.lit(start))
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))
