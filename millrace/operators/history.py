"""History: type-2 versions, dated snapshots, bi-temporal corrections, periodic copies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import need, need_columns
from ..functions.keys import surrogate_key
from .windows import dedupe, lag_lead, rank_family

VERSION_COLUMNS = ("valid_from", "valid_to", "version_id", "updated_at")


def start_history(source: DataFrame, keys: Sequence[str], effective: Column) -> DataFrame:
    """First load: one open version per row."""
    need(bool(keys), "MISSING_BUSINESS_KEY", "history needs a business key")
    shaped = source.withColumns({"valid_from": effective.cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    return shaped.withColumns(
        {"version_id": surrogate_key([*keys, "valid_from"]), "updated_at": F.col("valid_from")}
    )


def track_history(
    history: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    run_time: datetime | Column,
    *,
    strategy: str = "check",
    updated_at: str | None = None,
    invalidate_hard_deletes: bool = False,
) -> DataFrame:
    """Next state of a type-2 history with half-open validity.

    ``check`` opens a version when a tracked value changed (null-safe); ``timestamp`` when the
    source row's ``updated_at`` is later than the open version's start. Open versions and source
    meet in one full outer join on the key; closed versions are only carried along.
    """
    need(bool(keys), "MISSING_BUSINESS_KEY", "history needs a business key")
    need(strategy in ("check", "timestamp"), "INVALID_STRATEGY", strategy)
    need(strategy == "check" or bool(updated_at), "MISSING_UPDATED_AT", "timestamp strategy needs a column")
    need_columns(source, [*keys, *tracked, *([updated_at] if updated_at else [])])
    now = (run_time if isinstance(run_time, Column) else F.lit(run_time)).cast("timestamp")
    business = [c for c in history.columns if c not in VERSION_COLUMNS]
    need(set(business) <= set(source.columns), "UNKNOWN_COLUMN", "source lacks history columns")

    open_rows = history.filter(F.col("valid_to").isNull())
    closed = history.filter(F.col("valid_to").isNotNull())
    left = open_rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*history.columns).alias("old"))
    right = source.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*business).alias("new"))
    both = left.join(right, [f"__k{i}" for i in range(len(keys))], "full_outer")

    old, new = F.col("old"), F.col("new")
    has_old, has_new = old.isNotNull(), new.isNotNull()
    if strategy == "check":
        differs = F.lit(False)
        for c in tracked:
            differs = differs | ~old[c].eqNullSafe(new[c])
        effective = now
    else:
        effective = new[str(updated_at)].cast("timestamp")
        differs = F.coalesce(effective > old["valid_from"], F.lit(False))
    changed = has_old & has_new & differs
    gone = has_old & ~has_new if invalidate_hard_deletes else F.lit(False)
    end = F.when(changed, effective).when(gone, now).otherwise(old["valid_to"])
    touched = F.when(changed | gone, now).otherwise(old["updated_at"])
    kept = F.struct(
        *[old[c].alias(c) for c in business],
        old["valid_from"].alias("valid_from"), end.alias("valid_to"),
        old["version_id"].alias("version_id"), touched.alias("updated_at"),
    )
    opened = F.struct(
        *[new[c].alias(c) for c in business],
        effective.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        surrogate_key([*[new[k] for k in keys], effective]).alias("version_id"), now.alias("updated_at"),
    )
    rows = F.array(F.when(has_old, kept), F.when((has_new & ~has_old) | changed, opened))
    current = both.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
    return closed.select(*business, *VERSION_COLUMNS).unionByName(current)


def effective_history(
    snapshots: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    effective: str,
    *,
    close_offset_days: int = 1,
    slice_by: str | None = "year",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Inclusive ``[effective_start, effective_end]`` periods from dated snapshots.

    Of several snapshots of a key on one day the last counts: by time, then by ``tie_break``
    (descending), then by the tracked values, so the choice never depends on row order.

    A period ends the day before the next change; the current one has no end. Repeated equal
    snapshots collapse. ``slice_by`` is the calendar unit hot keys are cut by.
    """
    need(bool(keys) and all(keys), "MISSING_BUSINESS_KEY", "history needs a business key")
    need_columns(snapshots, [*keys, *tracked, effective, *tie_break])
    latest = F.struct(F.col(effective).alias("__at"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(tie_break)], F.struct(*tracked).alias("__values"))
    days = snapshots.groupBy(*keys, F.col(effective).cast("date").alias("effective_start")).agg(F.max(latest).alias("__last"))
    base = days.select(*keys, F.col("__last.__values").alias("__values"), "effective_start")
    unit = F.trunc("effective_start", slice_by) if slice_by else None
    seen = lag_lead(base, keys, ["effective_start"], {"__before": ("__values", 1)}, slice_by=unit)
    changes = seen.filter(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col("__values")))
    ends = lag_lead(
        changes.drop("__before"), keys, ["effective_start"], leads={"__next": ("effective_start", 1)}, slice_by=unit
    )
    return ends.select(
        *keys,
        "__values.*",
        "effective_start",
        F.date_sub("__next", close_offset_days).alias("effective_end"),
        F.col("__next").isNull().alias("is_current"),
    )


def check_run_keys(run: DataFrame, keys: Sequence[str]) -> None:
    """Refuse a run with a missing or repeated business key."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull() | (F.col(k).cast("string") == "")
    need(run.filter(missing).isEmpty(), "MISSING_BUSINESS_KEY", "a row has no business key")
    repeated = run.groupBy(*keys).count().filter("count > 1")
    need(repeated.isEmpty(), "DUPLICATE_BUSINESS_KEY_IN_RUN", "a business key occurs twice in one run")


def bitemporal_history(
    rows: DataFrame,
    keys: Sequence[str],
    effective: str,
    source_updated: str,
    *,
    slice_by: str | None = "year",
) -> DataFrame:
    """History over business time from all rows received so far.

    The latest source update of a (key, effective time) wins, so a late correction lands in the
    middle, versions are renumbered and a repeated run adds nothing. Half-open validity.
    """
    need_columns(rows, [*keys, effective, source_updated])
    facts = dedupe(rows, [*keys, effective], [f"{source_updated} desc"])
    unit = F.trunc(F.col(effective).cast("date"), slice_by) if slice_by else None
    ended = lag_lead(facts, keys, [effective], leads={"valid_to": (effective, 1)}, slice_by=unit)
    numbered = rank_family(ended, keys, [effective], {"version": "row_number"}, slice_by=unit)
    return numbered.withColumns(
        {"valid_from": F.col(effective), "current_flag": F.col("valid_to").isNull()}
    )


def periodic_snapshot(df: DataFrame, business_date: date | Column, run_id: str, partition: str = "ds") -> DataFrame:
    """Full copy stamped with its date; write it with a dynamic overwrite of that partition."""
    day = business_date if isinstance(business_date, Column) else F.lit(business_date)
    return df.withColumns({partition: day.cast("date"), "snapshot_run_id": F.lit(run_id)})


def retain_snapshots(df: DataFrame, business_date: date, days: int, partition: str = "ds") -> DataFrame:
    return df.filter(F.col(partition) > F.date_sub(F.lit(business_date), days))


def snapshot_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str], compare: Sequence[str], change: str = "change"
) -> DataFrame:
    """Keys added, removed or changed between two snapshots: one full outer join."""
    need_columns(before, [*keys, *compare])
    need_columns(after, [*keys, *compare])
    old = before.select(*keys, F.struct(*compare).alias("__old"))
    new = after.select(*keys, F.struct(*compare).alias("__new"))
    both = old.join(new, list(keys), "full_outer")
    kind = (
        F.when(F.col("__old").isNull(), F.lit("added"))
        .when(F.col("__new").isNull(), F.lit("removed"))
        .when(~F.col("__old").eqNullSafe(F.col("__new")), F.lit("changed"))
    )
    return both.select(*keys, kind.alias(change)).filter(F.col(change).isNotNull())
