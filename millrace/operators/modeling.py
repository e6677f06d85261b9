"""Facts, marts, reference tables, data vault, hierarchies and the date dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, need, need_columns
from ..functions.dates import period_end, period_start
from ..functions.keys import row_hash, surrogate_key
from ..session import cut_lineage
from .columns import Split
from .joins import join_temporal, with_unknown_member
from .windows import dedupe, lag_lead, running


def reject_duplicates(df: DataFrame, keys: Sequence[str]) -> Split:
    """Rows whose key occurs once, and all rows of keys that occur more often.

    The count per key combines on the map side; only the repeated keys travel to the second join.
    """
    need_columns(df, keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    marks = repeated.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return Split(df.join(marks, cond, "left_anti"), df.join(marks, cond, "left_semi"))


class Dimension(NamedTuple):
    frame: DataFrame
    on: Sequence[str | tuple[str, str]]
    columns: Sequence[str]


def build_fact(
    lines: DataFrame,
    grain: Sequence[str],
    dimensions: Sequence[Dimension],
    measures: Mapping[str, str],
    *,
    unknown: str = "UNKNOWN",
    duplicates: str = "reject",
) -> Split:
    """Fact at a declared grain: dimension attributes with UNKNOWN members and computed measures.

    A repeated grain key is rejected (all its rows); ``duplicates="allow"`` skips the check.
    """
    need(bool(grain), "MISSING_GRAIN", "a fact needs its grain")
    split = reject_duplicates(lines, grain) if duplicates == "reject" else Split(lines, lines.filter(F.lit(False)))
    out = split.accepted
    for d in dimensions:
        out = with_unknown_member(out, d.frame, d.on, d.columns, unknown)
    # Measures may build on earlier measures.
    for name, expression in measures.items():
        out = out.withColumn(name, F.expr(expression))
    return Split(out, split.rejected)


def fact_with_late_dimension(
    new_events: DataFrame,
    unresolved: DataFrame,
    dimension: DataFrame,
    natural_key: str,
    event_time: str,
    event_key: Sequence[str],
    dimension_key: str,
    business_date: date,
    *,
    run_time: datetime | None = None,
    max_lookback_days: int = 30,
    giveup_days: int = 7,
) -> DataFrame:
    """Today's facts and earlier unresolved ones, looked up against the dimension again.

    The fact key hashes event key and original date, so a retry gives the same key; facts that
    stay unresolved for ``giveup_days`` are flagged.
    """
    day = F.lit(business_date)
    retry = unresolved.filter(
        F.col("dim_resolved_at").isNull() & (F.col("ds") >= F.date_sub(day, max_lookback_days))
    )
    base = [c for c in new_events.columns]
    pending = new_events.select(*base).unionByName(retry.select(*base))
    resolved = join_temporal(
        pending, dimension, [natural_key], event_time, "valid_from", "valid_to", [dimension_key]
    )
    done = F.lit(run_time or business_date).cast("timestamp")
    waiting = F.datediff(day, F.col("ds"))
    return resolved.withColumns(
        {
            "fact_pk": surrogate_key([*event_key, "ds"]),
            "date_sk": F.date_format(event_time, "yyyyMMdd"),
            "dim_resolved_at": F.when(F.col(dimension_key).isNotNull(), done),
            "gave_up": F.col(dimension_key).isNull() & (waiting >= giveup_days),
        }
    )


def wide_mart(
    lines: DataFrame,
    grain: Sequence[str],
    required: Sequence[Dimension],
    optional: Sequence[Dimension],
    measures: Mapping[str, str],
    *,
    unknown: str = "UNKNOWN",
) -> Split:
    """Denormalised lines: required dimensions give UNKNOWN, optional ones null.

    A dimension with a repeated key is refused before anything is published.
    """
    from .joins import enrich

    for d in [*required, *optional]:
        keys = [k if isinstance(k, str) else k[1] for k in d.on]
        repeated = d.frame.groupBy(*keys).count().filter("count > 1")
        need(repeated.isEmpty(), "DUPLICATE_DIMENSION_KEY", f"dimension repeats {keys}")
    split = build_fact(lines, grain, required, {}, unknown=unknown)
    out = split.accepted
    for d in optional:
        out = enrich(out, d.frame, d.on, d.columns)
    for name, expression in measures.items():
        out = out.withColumn(name, F.expr(expression))
    return Split(out, split.rejected)


def publish_reference(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    as_of: date,
    *,
    active: str | None = None,
    order: Sequence[str] = (),
    id_column: str = "reference_id",
) -> DataFrame:
    """Latest active row per key, with a surrogate id and the as-of date."""
    need_columns(df, [*key, *columns])
    rows = df.dropna(subset=list(key))
    if active:
        rows = rows.filter(F.expr(active))
    latest = dedupe(rows, key, order)
    return latest.select(
        surrogate_key(key).alias(id_column), *key, *[c for c in columns if c not in key], F.lit(as_of).alias("as_of_date")
    )


def publish_reference_validity(
    published: DataFrame, incoming: DataFrame, key: Sequence[str], start: str, end: str, reason: str = "reject_reason"
) -> Split:
    """Add reference rows; an incoming key already published, repeated, or overlapping is rejected.

    Rows that only start in the future are published.
    """
    need_columns(incoming, [*key, start, end])
    # A row clashes with an earlier one that is still open (largest end so far), or the next one.
    forever = F.lit("9999-12-31").cast("date")
    year = F.trunc(F.col(start).cast("date"), "year")
    ends = incoming.withColumn("__end", F.coalesce(F.col(end).cast("date"), forever))
    ordered = [start, "__end"]
    reached = running(ends, key, ordered, {"__reach": ("max", F.col("__end"))}, slice_by=year)
    ahead = lag_lead(
        reached, key, ordered, {"__before": ("__reach", 1)}, {"__next_start": (start, 1)}, slice_by=year
    )
    clash = F.coalesce(F.col("__before") >= F.col(start), F.lit(False)) | F.coalesce(
        F.col("__end") >= F.col("__next_start"), F.lit(False)
    )
    known = published.select(*key, F.lit(True).alias("__known")).distinct()
    tagged = ahead.join(known, list(key), "left").withColumn(
        reason,
        F.when(clash, F.lit("overlapping-validity")).when(F.col("__known"), F.lit("duplicate-key")),
    ).drop("__end", "__reach", "__before", "__next_start", "__known")
    good = tagged.filter(F.col(reason).isNull()).drop(reason)
    return Split(published.unionByName(good.select(*published.columns)), tagged.filter(F.col(reason).isNotNull()))


def content_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive checksum of a table: one row ``row_count, checksum``."""
    h = row_hash(columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).alias("checksum"))


def publish_version(versions: DataFrame | None, current: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """A new version of a reference table, or None when its content equals the last version."""
    if versions is None:
        return current.select(*columns, F.lit(1).alias("version"))
    top = versions.agg(F.max("version").alias("v")).first()["v"]
    if top is None:
        return current.select(*columns, F.lit(1).alias("version"))
    last = versions.filter(F.col("version") == top).select(*columns)
    before, after = content_fingerprint(last, columns).first(), content_fingerprint(current, columns).first()
    if before == after:
        # A checksum can only suggest equality; the rows decide.
        same = last.exceptAll(current.select(*columns)).isEmpty()
        if same:
            return None
    return current.select(*columns, F.lit(int(top) + 1).alias("version"))


def hierarchy_depth(df: DataFrame, node: str, parent: str, out: str = "depth", max_rounds: int = 40) -> DataFrame:
    """Distance of every node from its root. Jumps double each round: log2(depth) joins."""
    need_columns(df, [node, parent])
    links = df.select(F.col(node).alias("__n"), F.col(parent).alias("__p")).dropDuplicates(["__n"])
    known = links.select(F.col("__n").alias("__id"))
    # A parent outside the table counts as no parent.
    jump = links.join(known, F.col("__p") == F.col("__id"), "left").select(
        "__n", F.col("__id").alias("__p"), F.when(F.col("__id").isNotNull(), 1).otherwise(0).cast("long").alias("__d")
    )
    jump = cut_lineage(jump)
    for _ in range(max_rounds):
        if jump.filter("__p IS NOT NULL").isEmpty():
            return df.join(jump.select(F.col("__n").alias(node), F.col("__d").alias(out)), node, "left")
        ahead = jump.select(F.col("__n").alias("__p"), F.col("__p").alias("__pp"), F.col("__d").alias("__dd"))
        jump = cut_lineage(
            jump.join(ahead, "__p", "left").select(
                "__n", F.col("__pp").alias("__p"), (F.col("__d") + F.coalesce("__dd", F.lit(0))).alias("__d")
            )
        )
    raise ConfigError("CYCLIC_HIERARCHY", "parents do not end at a root")


class Vault(NamedTuple):
    hub: DataFrame
    link: DataFrame
    satellite: DataFrame


def hub(df: DataFrame, name: str, key: Sequence[str], load_date: Column, source: str) -> DataFrame:
    return df.select(*key).distinct().select(
        surrogate_key(key).alias(f"{name}_hk"), *key, load_date.alias("load_date"), F.lit(source).alias("record_source")
    )


def link(df: DataFrame, name: str, hubs: Mapping[str, Sequence[str]], load_date: Column, source: str) -> DataFrame:
    keys = [c for cols in hubs.values() for c in cols]
    rows = df.select(*dict.fromkeys(keys)).distinct()
    return rows.select(
        surrogate_key(keys).alias(f"{name}_hk"),
        *[surrogate_key(cols).alias(f"{h}_hk") for h, cols in hubs.items()],
        load_date.alias("load_date"), F.lit(source).alias("record_source"),
    )


def satellite(
    df: DataFrame, name: str, key: Sequence[str], attributes: Sequence[str], changed_at: str, *, slice_by: str | None = "year"
) -> DataFrame:
    """Attribute rows per key, kept only where a value differs from the row before."""
    packed = df.select(*key, F.struct(*attributes).alias("__v"), F.col(changed_at).alias("load_date"))
    rows = dedupe(packed, [*key, "load_date"], ["__v"])
    unit = F.trunc(F.col("load_date").cast("date"), slice_by) if slice_by else None
    seen = lag_lead(rows, key, ["load_date"], {"__before": ("__v", 1)}, slice_by=unit)
    changes = seen.filter(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col("__v")))
    return changes.select(
        surrogate_key(key).alias(f"{name}_hk"), "load_date", F.sha2(F.to_json("__v"), 256).alias("hash_diff"), "__v.*"
    )


def date_dimension(spark: SparkSession, start: str = "1900-01-01", end: str = "2100-12-31") -> DataFrame:
    """One row per day with calendar attributes; its size depends on the two dates only."""
    d = F.col("calendar_date")
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("calendar_date")
    )
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d,
        F.date_format(d, "yyyy-MM-dd").alias("iso_date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofweek(d).alias("day_of_week"),
        F.date_format(d, "E").alias("day_name_short"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("iso_week"),
        period_start(d, 1).alias("month_start_date"),
        period_end(d, 1).alias("month_end_date"),
        period_start(d, 3).alias("quarter_start_date"),
        period_end(d, 3).alias("quarter_end_date"),
        period_start(d, 12).alias("year_start_date"),
        period_end(d, 12).alias("year_end_date"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )
