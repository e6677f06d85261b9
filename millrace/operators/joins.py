"""Joins. Strategy is left to Catalyst and AQE; hints are given only behind a checked size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import need, need_columns
from ..functions.sizes import BROADCAST_ROWS, broadcast_if_small, fits

# Fixed join names.
JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full_outer": "full_outer"}


def _pairs(on: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    need(bool(on), "MISSING_JOIN_KEYS", "join needs key pairs")
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in on]


def _condition(on: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for lk, rk in on:
        cond = cond & (F.col(f"l.{lk}") == F.col(f"r.{rk}"))
    return cond


def _both_sides(left: DataFrame, right: DataFrame) -> list[Column]:
    """All left then all right columns; a right name that collides becomes ``right_<name>``."""
    taken = {c.lower() for c in left.columns}
    out = [F.col(f"l.`{c}`") for c in left.columns]
    for c in right.columns:
        name = f"right_{c}" if c.lower() in taken else c
        need(name.lower() not in taken or name == c, "NAME_COLLISION", name)
        taken.add(name.lower())
        out.append(F.col(f"r.`{c}`").alias(name))
    return out


def join_equi(
    left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], how: str = "inner"
) -> DataFrame:
    need(how in JOIN_TYPES, "INVALID_JOIN_TYPE", how)
    pairs = _pairs(on)
    need_columns(left, [a for a, _ in pairs])
    need_columns(right, [b for _, b in pairs])
    joined = left.alias("l").join(right.alias("r"), _condition(pairs), JOIN_TYPES[how])
    return joined.select(*_both_sides(left, right))


def join_theta(left: DataFrame, right: DataFrame, condition: str, how: str = "inner") -> DataFrame:
    """Free condition over aliases ``l`` and ``r``; equalities in it still drive a hash join."""
    need(how in JOIN_TYPES, "INVALID_JOIN_TYPE", how)
    need(bool(condition.strip()), "MISSING_JOIN_CONDITION", "theta join needs a condition")
    joined = left.alias("l").join(right.alias("r"), F.expr(condition), JOIN_TYPES[how])
    return joined.select(*_both_sides(left, right))


def join_cross(left: DataFrame, right: DataFrame, max_rows: int = 1_000) -> DataFrame:
    """Every left row with every row of the right side, which is broadcast where it is proven small."""
    side = F.broadcast(right) if fits(right, max_rows) else right
    joined = left.alias("l").crossJoin(side.alias("r"))
    return joined.select(*_both_sides(left, right))


def join_projected(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str | tuple[str, str]],
    select: Mapping[str, str],
    *,
    how: str = "inner",
    left_filter: str | None = None,
    right_filter: str | None = None,
) -> DataFrame:
    """Filter each side, join, and project ``{output name: expression over l and r}``."""
    if left_filter:
        left = left.filter(F.expr(left_filter))
    if right_filter:
        right = right.filter(F.expr(right_filter))
    joined = left.alias("l").join(right.alias("r"), _condition(_pairs(on)), JOIN_TYPES[how])
    return joined.select(*[F.expr(e).alias(n) for n, e in select.items()])


def one_per_key(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Lookup side with at most one row per key, as an aggregate that combines on the map side."""
    packed = F.min(F.struct(*[F.col(v) for v in values])).alias("__v")
    return df.groupBy(*keys).agg(packed).select(*keys, "__v.*")


def enrich(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str | tuple[str, str]],
    columns: Sequence[str],
    *,
    flag: str | None = None,
    max_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left lookup that keeps every left row once, with an optional match flag."""
    pairs = _pairs(on)
    keys = [b for _, b in pairs]
    side = one_per_key(lookup, keys, columns).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *columns, F.lit(True).alias("__hit")
    )
    cond = F.lit(True)
    for i, (lk, _) in enumerate(pairs):
        cond = cond & (F.col(lk) == F.col(f"__k{i}"))
    joined = left.join(broadcast_if_small(side, max_broadcast), cond, "left")
    if flag:
        joined = joined.withColumn(flag, F.col("__hit").isNotNull())
    return joined.drop("__hit", *[f"__k{i}" for i in range(len(keys))])


def with_unknown_member(
    left: DataFrame,
    dimension: DataFrame,
    on: Sequence[str | tuple[str, str]],
    columns: Sequence[str],
    unknown: str = "UNKNOWN",
) -> DataFrame:
    """Dimension attributes by key; a missing member reads ``UNKNOWN``, a null attribute stays null."""
    joined = enrich(left, dimension, on, columns, flag="__known")
    filled = {
        c: F.when(F.col("__known"), F.col(c)).otherwise(F.lit(unknown)) for c in columns
    }
    return joined.withColumns(filled).drop("__known")


def join_star(
    fact: DataFrame,
    dimensions: Sequence[tuple[str, DataFrame, Sequence[str | tuple[str, str]], Sequence[str]]],
    how: str = "left",
) -> DataFrame:
    """Fold ``(prefix, dimension, keys, columns)`` onto the fact.

    No hints: Spark broadcasts a dimension below its own size threshold (from file statistics, or
    measured at run time by AQE) and shuffles it beyond.
    """
    out = fact
    for prefix, dim, on, columns in dimensions:
        pairs = _pairs(on)
        side = dim.select(
            *[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)],
            *[F.col(c).alias(f"{prefix}{c}") for c in columns],
        )
        cond = F.lit(True)
        for i, (lk, _) in enumerate(pairs):
            cond = cond & (F.col(lk) == F.col(f"__k{i}"))
        out = out.join(side, cond, how).drop(*[f"__k{i}" for i in range(len(pairs))])
    return out


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    hot_rows: int = 1_000_000,
    salts: int = 32,
) -> DataFrame:
    """Inner or left join for a left side with hot keys: their rows are spread over ``salts`` tasks.

    Hot keys are those with more than ``hot_rows`` rows, so there are at most
    ``rows / hot_rows`` of them; only their right rows are repeated.
    """
    need(how in ("inner", "left"), "INVALID_JOIN_TYPE", how)
    need_columns(left, on)
    need_columns(right, on)
    hot = (
        left.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > hot_rows)
    ).select(*on, F.lit(salts).alias("__salts"))
    hot = broadcast_if_small(hot)
    row_salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    # Rows with a null key match nothing; salting them keeps them out of one task.
    no_key = F.lit(False)
    for k in on:
        no_key = no_key | F.col(k).isNull()
    salted = left.join(hot, list(on), "left").withColumn(
        "__salt", F.when(F.col("__salts").isNotNull() | no_key, row_salt).otherwise(F.lit(0))
    )
    copies = F.sequence(F.lit(0).cast("long"), (F.coalesce("__salts", F.lit(1)) - 1).cast("long"))
    spread = right.join(hot, list(on), "left").withColumn("__salt", F.explode(copies))
    return salted.drop("__salts").join(spread.drop("__salts"), [*on, "__salt"], how).drop("__salt")


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", max_broadcast: int = BROADCAST_ROWS
) -> DataFrame:
    """Join to one row (or few) per key: broadcast when proven small, else salted against hot keys."""
    if fits(right, max_broadcast):
        return left.join(F.broadcast(right), list(on), how)
    return salted_join(left, right, on, how)


def join_temporal(
    facts: DataFrame,
    versions: DataFrame,
    key: Sequence[str],
    event_time: str,
    valid_from: str,
    valid_to: str,
    columns: Sequence[str],
    *,
    how: str = "left",
    slice_by: str = "month",
    max_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """Dimension version valid at the fact's time: the latest that began by then, unless it has closed.

    A small dimension is broadcast. Otherwise facts and versions are laid in one time order per
    key and the last version is carried forward; keys are cut into calendar slices (see
    ``windows``), so no task holds a whole hot key. Both ways give the same answer: a later version
    ends the ones before it, of versions that begin together one is taken by its content, and null
    keys or times match nothing.
    """
    need(how in ("left", "inner"), "INVALID_JOIN_TYPE", how)
    need_columns(facts, [*key, event_time])
    need_columns(versions, [*key, valid_from, valid_to, *columns])
    payload = F.struct(
        F.col(valid_to).alias("__to"), *[F.col(c).alias(f"__c_{c}") for c in columns]
    )
    known = versions.dropna(subset=[*key, valid_from]).withColumn("__v", payload)
    versions = known.groupBy(*key, valid_from).agg(F.max_by("__v", F.xxhash64(F.to_json("__v"))).alias("__v"))
    payload = F.col("__v")
    if fits(versions, max_broadcast):
        later = Window.partitionBy(*key).orderBy(valid_from)
        side = versions.withColumn("__next", F.lead(valid_from).over(later)).select(
            *[F.col(k).alias(f"__k_{k}") for k in key], F.col(valid_from).alias("__from"), "__next", "__v"
        )
        time = F.col(event_time)
        cond = (time >= F.col("__from")) & (F.col("__next").isNull() | (time < F.col("__next")))
        cond = cond & (F.col("__v.__to").isNull() | (time < F.col("__v.__to")))
        for k in key:
            cond = cond & (F.col(k) == F.col(f"__k_{k}"))
        joined = facts.join(F.broadcast(side), cond, how)
    else:
        joined = _carry_version(facts, versions, key, event_time, valid_from, payload, slice_by)
        alive = F.col("__v.__to").isNull() | (F.col(event_time) < F.col("__v.__to"))
        joined = joined.withColumn("__v", F.when(alive, F.col("__v")))
        if how == "inner":
            joined = joined.filter(F.col("__v").isNotNull())
    return joined.select(
        *[F.col(f"`{c}`") for c in facts.columns], *[F.col(f"__v.__c_{c}").alias(c) for c in columns]
    )


def _carry_version(
    facts: DataFrame,
    versions: DataFrame,
    key: Sequence[str],
    event_time: str,
    valid_from: str,
    payload: Column,
    unit: str,
) -> DataFrame:
    def slice_of(c: str) -> Column:
        return F.trunc(F.col(c).cast("date"), unit)

    dim = versions.select(
        *key, F.col(valid_from).alias("__t"), slice_of(valid_from).alias("__s"), payload.alias("__v")
    )
    marked = facts.select(
        *key, F.col(event_time).alias("__t"), slice_of(event_time).alias("__s"),
        F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("__fact"),
    )
    # Last version of every slice, then of all slices before each slice that holds facts.
    ends = dim.groupBy(*key, "__s").agg(F.max_by("__v", "__t").alias("__v"))
    slots = ends.unionByName(marked.select(*key, "__s").distinct(), allowMissingColumns=True)
    per_slice = slots.groupBy(*key, "__s").agg(F.first("__v", ignorenulls=True).alias("__v"))
    earlier = Window.partitionBy(*key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.withColumn("__v", F.last("__v", ignorenulls=True).over(earlier))
    rows = (
        carry.withColumn("__kind", F.lit(0))
        .unionByName(dim.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(marked.withColumn("__kind", F.lit(2)), allowMissingColumns=True)
    )
    w = Window.partitionBy(*key, "__s").orderBy(F.col("__t").asc_nulls_first(), "__kind")
    carried = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__kind = 2")
    return carried.select("__fact.*", "__v")


def join_point_in_time(
    entities: DataFrame, events: DataFrame, key: Sequence[str], cutoff: str, event_time: str
) -> DataFrame:
    """Events of each entity at or before its cut-off; entities without any are absent."""
    need_columns(entities, [*key, cutoff])
    side = entities.select(*key, cutoff).distinct()
    joined = lookup_join(events, side, key)
    return joined.filter(F.col(event_time) <= F.col(cutoff))


VALIDITY_STEPS = {"week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}


def join_validity(
    left: DataFrame,
    periods: DataFrame,
    on: Sequence[str | tuple[str, str]],
    day: str,
    start: str,
    end: str,
    columns: Sequence[str],
    *,
    slice_by: str = "month",
    max_broadcast: int = BROADCAST_ROWS,
    hot_rows: int = 1_000_000,
    salts: int = 32,
) -> DataFrame:
    """Left join to the period whose inclusive ``[start, end]`` covers the business date.

    Few periods are broadcast. Otherwise periods are cut into calendar slices, up to the last date
    there is, and joined by key and slice: a row lies in one slice, so it meets a period once. The rows
    of a key and slice beyond ``hot_rows`` are spread over ``salts`` tasks, as are rows without a key.
    Spark sizes the cut periods by the file of the uncut ones, so they are kept from being broadcast.
    """
    pairs = _pairs(on)
    need(slice_by in VALIDITY_STEPS, "INVALID_SLICE", slice_by)
    names = [f"__k{i}" for i in range(len(pairs))]
    side = periods.select(
        *[F.col(b).alias(k) for k, (_, b) in zip(names, pairs, strict=True)],
        F.col(start).alias("__start"), F.col(end).alias("__end"), *columns,
    )
    cond = (F.col(day) >= F.col("__start")) & (F.col("__end").isNull() | (F.col(day) <= F.col("__end")))
    for k, (lk, _) in zip(names, pairs, strict=True):
        cond = cond & (F.col(lk) == F.col(k))
    if fits(side, max_broadcast):
        return left.join(F.broadcast(side), cond, "left").drop("__start", "__end", *names)

    slice_of = lambda c: F.trunc(F.col(c).cast("date"), slice_by)
    last = left.agg(F.max(F.col(day).cast("date")).alias("last")).scalar()
    cut = side.withColumn("__last", last).select("*", slice_of("__start").alias("__from"), F.trunc(F.least(F.coalesce(F.col("__end").cast("date"), "__last"), "__last"), slice_by).alias("__to"))
    spans = F.when(F.col("__from") <= F.col("__to"), F.expr(f"sequence(__from, __to, INTERVAL {VALIDITY_STEPS[slice_by]})"))
    cut = cut.withColumn("__slice", F.explode(spans)).drop("__last", "__from", "__to")

    marked = left.withColumn("__day_slice", slice_of(day))
    own = [F.col(lk).alias(f"__h{i}") for i, (lk, _) in enumerate(pairs)]
    hot = marked.groupBy(*own, F.col("__day_slice").alias("__hs")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = broadcast_if_small(hot.select(*[f"__h{i}" for i in range(len(pairs))], "__hs", F.lit(salts).alias("__salts")))

    def is_hot(keys: Sequence[str], slice_: str) -> Column:
        same = F.col(slice_) == F.col("__hs")
        for i, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"__h{i}"))
        return same

    gone = [f"__h{i}" for i in range(len(pairs))] + ["__hs", "__salts"]
    void = F.col("__day_slice").isNull()
    for lk, _ in pairs:
        void = void | F.col(lk).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    marked = marked.join(hot, is_hot([lk for lk, _ in pairs], "__day_slice"), "left")
    marked = marked.withColumn("__salt", F.when(F.col("__salts").isNotNull() | void, spread).otherwise(F.lit(0))).drop(*gone)
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)).cast("long") - 1)
    cut = cut.join(hot, is_hot(names, "__slice"), "left").withColumn("__copy", F.explode(copies)).drop(*gone)
    joined = marked.join(cut.hint("merge"), cond & (F.col("__day_slice") == F.col("__slice")) & (F.col("__salt") == F.col("__copy")), "left")
    return joined.drop("__start", "__end", "__slice", "__day_slice", "__salt", "__copy", *names)


def anti_orphans(child: DataFrame, parent: DataFrame, on: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Child rows whose key is given but absent from the parent."""
    pairs = _pairs(on)
    given = F.lit(True)
    for lk, _ in pairs:
        given = given & F.col(lk).isNotNull()
    keys = parent.select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)]).distinct()
    cond = F.lit(True)
    for i, (lk, _) in enumerate(pairs):
        cond = cond & (F.col(lk) == F.col(f"__k{i}"))
    return child.filter(given).join(keys, cond, "left_anti")


def semi_pending(
    rows: DataFrame, needed: DataFrame, on: Sequence[str], loaded: DataFrame | None = None, loaded_on: Sequence[str] = ()
) -> DataFrame:
    """Rows whose key is wanted (semi) and whose partition is not loaded yet (anti)."""
    out = rows.join(needed.select(*on).distinct(), list(on), "left_semi")
    if loaded is not None:
        out = out.join(loaded.select(*loaded_on).distinct(), list(loaded_on), "left_anti")
    return out
