"""Applying changes to a current-state table. Every merge is one shuffle on the key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import ConfigError, need, need_columns
from .windows import dedupe, descending, order_columns, order_name


class MergeResult(NamedTuple):
    state: DataFrame
    report: DataFrame


def upsert(
    target: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    *,
    strategy: str = "upsert",
) -> DataFrame:
    """Newest delta row per key replaces the target row; ``append`` keeps both.

    ``delete_insert`` replaces the target rows of a key by all its delta rows.
    """
    need(strategy in ("upsert", "delete_insert", "append"), "INVALID_STRATEGY", strategy)
    need_columns(target, keys)
    need_columns(delta, [*keys, *[order_name(o) for o in order]])
    if strategy == "append":
        return target.unionByName(delta.select(*target.columns))
    newest = dedupe(delta, keys, order) if strategy == "upsert" else delta
    kept = target.join(delta.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(newest.select(*target.columns))


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    op: str,
    order: Sequence[str],
    *,
    upsert_values: Sequence[str] = ("UPSERT",),
    delete_values: Sequence[str] = ("DELETE",),
    truncate_values: Sequence[str] = ("TRUNCATE",),
    deletes: str = "hard_delete",
    deleted_flag: str = "is_deleted",
) -> MergeResult:
    """Last change per key wins; the report names every inserted, updated and deleted key.

    ``deletes``: ``hard_delete`` removes the row, ``soft_delete`` marks it, ``ignore`` keeps it.
    A truncation needs no key: it deletes every row of the target and every change up to it, in
    ``order``; changes at the same place in the order are before it.
    """
    need(deletes in ("hard_delete", "soft_delete", "ignore"), "INVALID_DELETE_HANDLING", deletes)
    need(bool(order), "MISSING_ORDER", "changes need an order")
    need_columns(target, keys)
    need_columns(changes, [*keys, op, *[order_name(o) for o in order]])
    known = (*upsert_values, *delete_values, *truncate_values)
    unknown = changes.filter(~F.col(op).isin(*known) | F.col(op).isNull())
    need(unknown.isEmpty(), "INVALID_MERGE_OPERATION", f"changes use operations outside {known}")
    newest_first = [o if " " in o.strip() else f"{o} desc" for o in order]
    truncations = changes.filter(F.col(op).isin(*truncate_values))
    changes = changes.filter(~F.col(op).isin(*truncate_values))
    mark = None if deletes == "ignore" else truncations.orderBy(*order_columns(newest_first)).select(*map(order_name, order)).first()
    cleared = mark is not None
    if cleared:
        changes = changes.filter(_comes_first(newest_first, mark))

    fields = [c for c in target.columns if c != deleted_flag]
    present = [c for c in fields if c in changes.columns]
    last = dedupe(changes, keys, newest_first)
    ks = [f"__k{i}" for i in range(len(keys))]
    left = target.select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], F.struct(*target.columns).alias("old"))
    right = last.select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)],
        F.col(op).isin(*delete_values).alias("__delete"),
        F.struct(*present).alias("new"),
    )
    both = left.join(right, ks, "full_outer")
    has_old, has_new, delete = F.col("old").isNotNull(), F.col("new").isNotNull(), F.coalesce("__delete", F.lit(cleared))
    put = has_new & ~delete

    def value(c: str) -> Column:
        kind = target.schema[c].dataType
        if c not in present:
            return F.when(~(put & F.lit(cleared)), F.col("old")[c])
        return F.when(put, F.col("new")[c].cast(kind)).otherwise(F.col("old")[c])

    out = [value(c).alias(c) for c in fields]
    if deletes == "soft_delete":
        was = F.coalesce(F.col("old")[deleted_flag], F.lit(False)) if deleted_flag in target.columns else F.lit(False)
        out.append(F.when(put, F.lit(False)).when(delete, F.lit(True)).otherwise(was).alias(deleted_flag))
    elif deleted_flag in target.columns:
        out.append(F.coalesce(F.col("old")[deleted_flag], F.lit(False)).alias(deleted_flag))
    keep = has_old | put
    if deletes == "hard_delete":
        keep = keep & ~delete
    state = both.filter(keep).select(*out)

    kind = (
        F.when(put & ~has_old, F.lit("inserted"))
        .when(put & has_old, F.lit("updated"))
        .when(delete & has_old & F.lit(deletes != "ignore"), F.lit("deleted"))
    )
    report = both.select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], kind.alias("action"))
    return MergeResult(state, report.filter(F.col("action").isNotNull()))


def _comes_first(order: Sequence[str], mark: Row) -> Column:
    """Rows that stand before ``mark`` in the order; nulls stand last where it descends, else first."""
    before, equal = F.lit(False), F.lit(True)
    for item, value in zip(order, mark, strict=True):
        c, v = F.col(order_name(item)), F.lit(value)
        if descending(item):
            ahead = c.isNotNull() if value is None else F.coalesce(c > v, F.lit(False))
        else:
            ahead = F.lit(False) if value is None else F.coalesce(c < v, F.lit(True))
        before = before | (equal & ahead)
        equal = equal & c.eqNullSafe(v)
    return before


def bootstrap_or_apply(
    target: DataFrame, snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], op: str, order: Sequence[str], **options
) -> DataFrame:
    """An empty target is loaded from the snapshot; afterwards only changes are applied."""
    base = snapshot.select(*target.columns) if target.isEmpty() else target
    return apply_changes(base, changes, keys, op, order, **options).state


def high_water(target: DataFrame, column: str, default: object = datetime(1970, 1, 1)) -> object:
    """Largest value loaded so far: a single state value, used as a literal so scans can skip."""
    need_columns(target, [column])
    top = target.agg(F.max(column).alias("top")).first()
    return default if top is None or top["top"] is None else top["top"]


def newer_than(source: DataFrame, column: str, mark: object) -> DataFrame:
    return source.filter(F.col(column) > F.lit(mark))


class LateSplit(NamedTuple):
    accepted: DataFrame
    quarantined: DataFrame
    recompute: DataFrame


LATE_POLICIES = ("recompute", "flag_only", "quarantine", "ignore")


def late_policy(
    df: DataFrame,
    event_time: str,
    processing_time: str,
    policy: str = "recompute",
    *,
    threshold_hours: int = 72,
    flag: str = "is_late",
) -> LateSplit:
    """Rows that arrive more than ``threshold_hours`` after their event.

    ``recompute`` accepts them and lists the event days to rebuild, ``flag_only`` accepts them
    with a flag, ``quarantine`` sets them aside, ``ignore`` treats them as on time.
    """
    if policy not in LATE_POLICIES:
        raise ConfigError("INVALID_LATE_POLICY", policy)
    need_columns(df, [event_time, processing_time])
    late = F.col(processing_time) > F.col(event_time) + F.expr(f"INTERVAL {int(threshold_hours)} HOURS")
    tagged = df.withColumn(flag, F.coalesce(late, F.lit(False)))
    nothing = tagged.filter(F.lit(False))
    days = tagged.filter(F.col(flag)).select(F.col(event_time).cast("date").alias("ds")).distinct()
    if policy == "quarantine":
        return LateSplit(tagged.filter(~F.col(flag)), tagged.filter(F.col(flag)), days.filter(F.lit(False)))
    if policy == "ignore":
        return LateSplit(tagged.withColumn(flag, F.lit(False)), nothing, days.filter(F.lit(False)))
    return LateSplit(tagged, nothing, days if policy == "recompute" else days.filter(F.lit(False)))
