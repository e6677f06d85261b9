"""Grouped aggregates. Hot groups are reduced by map-side partial aggregation before any shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, need, need_columns
from ..functions.dates import fiscal_start
from ..session import materialise
from .columns import Split, reject_by

COLLECT_LIMIT = 100_000


def aggregate_column(fn: str, column: str | None, order: str | None = None, argument: object = None) -> Column:
    """One aggregate by name. ``first``/``last`` need an order column so that they are repeatable."""
    fn = fn.lower()
    if column in (None, "", "*"):
        need(fn == "count", "MISSING_COLUMN", f"{fn} needs a column")
        return F.count(F.lit(1))
    c = F.col(column)
    if fn == "count_distinct":
        return F.count_distinct(c)
    if fn in ("first", "last"):
        need(bool(order), "MISSING_ORDER", f"{fn} needs an order column")
        return (F.min_by if fn == "first" else F.max_by)(c, F.col(str(order)))
    if fn == "percentile_approx":
        return F.percentile_approx(c, argument if argument is not None else 0.5, 100_000)
    if fn in ("collect_list", "collect_set"):
        return F.sort_array(getattr(F, fn)(c))
    need(hasattr(F, fn), "UNKNOWN_AGGREGATE", fn)
    return getattr(F, fn)(c)


def group_aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    aggregates: Sequence[Mapping[str, object]],
    *,
    having: str | None = None,
    contract_types: bool = False,
    collect_limit: int = COLLECT_LIMIT,
    part_rows: int | None = None,
) -> DataFrame:
    """Group columns, then ``{function, column, alias, order, argument}`` in the order given.

    With ``part_rows``, lists and sets of any size come in numbered parts of so many values: a group
    has one row for each ``part``, from 0, on which its other aggregates repeat. Without, one list
    holds all, so they are only built after a count has shown that every group is small.
    """
    need(bool(aggregates), "MISSING_AGGREGATES", "needs at least one aggregate")
    need_columns(df, [*group_by, *[str(a["column"]) for a in aggregates if a.get("column") not in (None, "", "*")]])
    lists = [a for a in aggregates if str(a["function"]).lower() in ("collect_list", "collect_set")]
    if lists and part_rows is not None:
        return _with_parts(df, group_by, aggregates, lists, having, contract_types, part_rows)
    if lists:
        oversized = df.groupBy(*group_by).count().filter(F.col("count") > collect_limit)
        need(oversized.isEmpty(), "GROUP_TOO_LARGE", f"a group exceeds {collect_limit} rows; give part_rows")
    made = []
    for a in aggregates:
        fn, column = str(a["function"]).lower(), a.get("column")
        name = _name(a)
        value = aggregate_column(fn, column, a.get("order"), a.get("argument"))  # type: ignore[arg-type]
        if contract_types:
            value = value.cast(result_type(df, fn, column))  # type: ignore[arg-type]
        made.append(value.alias(name))
    out = df.groupBy(*group_by).agg(*made)
    return out.filter(F.expr(having)) if having else out


def _name(a: Mapping[str, object]) -> str:
    column = a.get("column")
    return str(a.get("alias") or f"{str(a['function']).lower()}_{column if column not in (None, '', '*') else 'all'}")


def _with_parts(df, group_by, aggregates, lists, having, contract_types, part_rows) -> DataFrame:
    others = [a for a in aggregates if a not in lists]
    base = group_aggregate(df, group_by, others, having=having, contract_types=contract_types) if others else df.select(*group_by).distinct()
    found = None
    for a in lists:
        one = collect_parts(df, group_by, str(a["column"]), distinct=str(a["function"]).lower() == "collect_set", part_rows=part_rows, alias=_name(a))
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    names = [_name(a) for a in lists]
    found = found.groupBy(*group_by, "part").agg(*[F.coalesce(F.first(n, ignorenulls=True), F.array().cast(found.schema[n].dataType)).alias(n) for n in names])
    keys = {c: f"__g{i}" for i, c in enumerate(group_by)}
    side = found.withColumnsRenamed(keys)
    same = F.lit(True)
    for c, g in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(g))
    return base.join(side, same).select(*group_by, "part", *[_name(a) for a in aggregates])


def collect_parts(
    df: DataFrame, group_by: Sequence[str], column: str, *, distinct: bool = False, part_rows: int = COLLECT_LIMIT, alias: str = "values"
) -> DataFrame:
    """Sorted values of each group, null ones left out, in lists of ``part_rows``: groups, ``part`` (from 0) and the list.

    Equal values are counted first (combined on the map side), so a hot group costs its distinct values.
    Those are range-partitioned by group and value; the counts of the ranges before, carried per
    group, give every value its place, and its place the parts. No task holds a whole group. A group
    without values has one empty part.
    """
    need(part_rows > 0, "INVALID_PART_ROWS", str(part_rows))
    need_columns(df, [*group_by, column])
    keys = [f"__g{i}" for i in range(len(group_by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(group_by, keys, strict=True)], F.col(column).alias("__v"))
    some = F.count("__v")
    counted = rows.groupBy(*keys, "__v").agg((F.least(some, F.lit(1)) if distinct else some).alias("__n"))
    ranged = materialise(counted.repartitionByRange(*keys, "__v").withColumn("__p", F.spark_partition_id()), "values")
    ahead = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each group and range.
    shares = ranged.groupBy("__p", *keys).agg(F.sum("__n").alias("__n"))
    carried = shares.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"{k}q") for k in keys], ahead(Window.partitionBy(*keys).orderBy("__p")).alias("__carried"))
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}q"))
    placed = ranged.withColumn("__before", ahead(Window.partitionBy("__p", *keys).orderBy("__v"))).join(carried, same)
    placed = placed.withColumn("__first", F.col("__before") + F.col("__carried")).withColumn("__end", F.col("__first") + F.col("__n"))
    size = F.lit(part_rows).cast("long")
    # A value that stands for nothing only sees to it that its group has a part.
    spans = F.when(F.col("__n") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.expr(f"sequence(__first div {part_rows}, (__end - 1) div {part_rows})"))
    cut = placed.select(*keys, "__v", "__n", "__first", "__end", F.explode(spans).alias("part"))
    take = F.least("__end", (F.col("part") + 1) * size) - F.greatest("__first", F.col("part") * size)
    pieces = F.when(F.col("__n") > 0, F.struct(F.col("__v").alias("v"), take.cast("int").alias("n")))
    made = cut.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(pieces)).alias("x"))
    values = F.flatten(F.transform("x", lambda x: F.array_repeat(x["v"], x["n"])))
    return made.select(*[F.col(k).alias(c) for c, k in zip(group_by, keys, strict=True)], "part", values.alias(alias))


def result_type(df: DataFrame, fn: str, column: str | None) -> T.DataType:
    """Contract types: counts long, averages double, min/max as the source, sums long or double."""
    if fn in ("count", "count_distinct"):
        return T.LongType()
    if fn == "avg":
        return T.DoubleType()
    source = df.schema[str(column)].dataType
    if fn in ("min", "max"):
        return source
    if fn == "sum":
        return T.LongType() if isinstance(source, T.IntegralType) else T.DoubleType()
    return T.DoubleType()


BUCKETS = ("hour", "day", "week", "month", "quarter", "year")


def time_bucket(column: str | Column, unit: str, fiscal_offset: int = 0) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    if unit == "fiscal_quarter":
        return fiscal_start(c.cast("date"), 3, fiscal_offset)
    if unit == "fiscal_year":
        return fiscal_start(c.cast("date"), 12, fiscal_offset)
    if unit == "hour":
        return F.date_trunc("hour", c)
    if unit == "day":
        return c.cast("date")
    need(unit in BUCKETS, "INVALID_BUCKET", unit)
    return F.trunc(c.cast("date"), unit)


def bucket_aggregate(
    df: DataFrame,
    time: str,
    unit: str,
    dimensions: Sequence[str],
    measures: Mapping[str, Sequence[str]],
    *,
    distinct: Sequence[str] = (),
    fiscal_offset: int = 0,
    bucket: str = "period_bucket",
) -> DataFrame:
    """Measures by time bucket and dimensions: ``<column>_<function>``, distinct counts, row count."""
    need_columns(df, [time, *dimensions, *measures, *distinct])
    made = [
        aggregate_column(fn, c).alias(f"{c}_{fn}") for c, fns in measures.items() for fn in fns
    ]
    made += [F.count_distinct(d).alias(f"{d}_distinct_count") for d in distinct]
    made.append(F.count(F.lit(1)).alias("row_count"))
    return df.groupBy(time_bucket(time, unit, fiscal_offset).alias(bucket), *dimensions).agg(*made)


def incremental_buckets(
    source: DataFrame, published: DataFrame, time: str, unit: str, start: object, end: object, aggregate
) -> DataFrame:
    """Published buckets outside the run window, plus the window's buckets computed afresh.

    Only source rows inside the window are read; write the result's window back with a dynamic
    partition overwrite on the bucket.
    """
    bucket = "period_bucket"
    low, high = time_bucket(F.lit(start), unit), time_bucket(F.lit(end), unit)
    in_window = source.filter(time_bucket(time, unit).between(low, high))
    fresh = aggregate(in_window)
    return published.filter(~F.col(bucket).between(low, high)).unionByName(fresh)


def net_measures(
    df: DataFrame, entity: str, time: str, gross: str, refund: str, units: str, order_id: str
) -> Split:
    """Gross, refund, net, units and orders per entity and event day; invalid amounts rejected.

    A late refund row counts on its own event day.
    """
    need_columns(df, [entity, time, gross, refund, units, order_id])
    bad = F.col(gross).isNull() | (F.col(gross) < 0) | F.col(refund).isNull() | (F.col(refund) < 0)
    split = reject_by(df, {"invalid-gross-amount": bad})
    rollup = split.accepted.groupBy(F.col(entity), F.col(time).cast("date").alias("business_date")).agg(
        F.sum(gross).alias("gross_revenue"),
        F.sum(refund).alias("refund_amount"),
        (F.sum(gross) - F.sum(refund)).alias("net_revenue"),
        F.sum(units).alias("units"),
        F.count_distinct(order_id).alias("order_count"),
    )
    return Split(rollup, split.rejected)


def line_rules(
    df: DataFrame,
    group_by: Sequence[str],
    quantity: str,
    price: str,
    line_type: str,
    return_value: str = "return",
) -> Split:
    """Quantity and revenue per group; returns may be negative, a negative sale is rejected."""
    need_columns(df, [*group_by, quantity, price, line_type])
    bad = (F.col(quantity) < 0) & (F.col(line_type) != return_value)
    split = reject_by(df, {"negative-sale-quantity": bad})
    rollup = split.accepted.groupBy(*group_by).agg(
        F.sum(quantity).alias("sum_quantity"),
        F.sum(F.col(quantity) * F.col(price)).alias("sum_revenue"),
        F.count(F.lit(1)).alias("line_count"),
        F.min(price).alias("min_unit_price"),
        F.max(price).alias("max_unit_price"),
    )
    return Split(rollup, split.rejected)


def pre_aggregate_star(fact: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], dimensions) -> DataFrame:
    """Reduce the fact to the dimension keys first, then join: the join moves groups, not rows."""
    from .joins import join_star

    reduced = fact.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    return join_star(reduced, dimensions)


def windowed_features(
    entities: DataFrame,
    events: DataFrame,
    key: Sequence[str],
    cutoff: str,
    event_time: str,
    features: Mapping[str, tuple[str, int, Column | None]],
    *,
    excluded: Sequence[str] = (),
    default: object = 0,
) -> DataFrame:
    """Features per entity and cut-off: ``{name: (function, days, value or condition)}``.

    ``count`` counts rows where the condition holds (all rows when it is None); the window is
    ``(cutoff - days, cutoff]``, a day being 24 hours. Entities without events get the default.
    Excluded (leaking) columns are dropped before any expression sees them.

    Events are read twice and never meet the cut-offs as rows. Once they are reduced to panes, one
    row for each entity and day (combined on the map side); once the days at the two ends of a window
    are swept in time order. Cut-offs are put into that order as probes, which read the running
    aggregate before them, so the work is linear in events and cut-offs, however many an entity has.
    """
    need_columns(entities, [*key, cutoff])
    safe = events.drop(*excluded)
    need_columns(safe, [*key, event_time])
    parts: dict[str, tuple[str, int, Column]] = {}  # helper -> merge function, days, value of one event
    finish: dict[str, Column] = {}
    for i, (name, (fn, days, value)) in enumerate(features.items()):
        need(days > 0, "INVALID_DAYS", str(days))
        h = f"__f{i}"
        if fn == "count":
            hit = F.lit(True) if value is None else value
            parts[h] = ("sum", days, F.when(hit, F.lit(1).cast("long")))
        else:
            need(value is not None and fn in ("sum", "max", "min", "avg"), "INVALID_FEATURE", name)
            parts[h] = ("sum" if fn == "avg" else fn, days, value)  # type: ignore[assignment]
            if fn == "avg":
                parts[f"{h}n"] = ("sum", days, F.when(value.isNotNull(), F.lit(1).cast("long")))  # type: ignore[union-attr]
        finish[name] = F.try_divide(h, f"{h}n") if fn == "avg" else F.col(h)
    lengths = sorted({days for _, days, _ in parts.values()})
    day = 86_400_000_000
    base = entities.select(*key, cutoff).distinct()
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    points = base.dropna().select(*key, cutoff, micros(cutoff).alias("__c"))
    times = safe.dropna(subset=[*key, event_time]).select(*key, micros(event_time).alias("__t"), *[v.alias(h) for h, (_, _, v) in parts.items()])
    times = times.withColumn("__s", F.floor(F.col("__t") / day))

    # The first and last day of a window, swept event by event; a head serves windows of every length.
    begun = points.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("__days"))
    heads = points.select(*key, cutoff, F.lit(None).cast("int").alias("__days"), F.col("__c").alias("__t"), F.lit(1).alias("__kind"))
    tails = begun.select(*key, cutoff, "__days", (F.col("__c") - F.col("__days").cast("long") * day).alias("__t"), F.lit(2).alias("__kind"))
    ends = heads.unionByName(tails).withColumn("__s", F.floor(F.col("__t") / day))
    edge = times.join(ends.select(*key, "__s").distinct(), [*key, "__s"], "left_semi")
    met = _sweep(edge, ends, [*key, "__s"], parts)

    # The whole days between: panes in slices as wide as they are many, so a window ends in one slice and begins in the one before.
    inner = [n for n in lengths if n > 1]
    if inner:
        panes = times.groupBy(*key, "__s").agg(*[getattr(F, fn)(h).alias(h) for h, (fn, _, _) in parts.items()])
        wide = F.col("__days") - 1
        panes = panes.withColumn("__days", F.explode(F.array(*[F.lit(n) for n in inner])))
        panes = panes.select(*key, "__days", F.col("__s").alias("__t"), F.floor(F.col("__s") / wide).alias("__s"), *parts)
        last = F.floor(F.col("__c") / day) - 1
        asked = begun.filter("__days > 1").select(*key, cutoff, "__days", F.explode(F.array(F.struct(last.alias("t"), F.lit(1).alias("kind")), F.struct((last - wide).alias("t"), F.lit(2).alias("kind")))).alias("x"))
        asked = asked.select(*key, cutoff, "__days", F.col("x.t").alias("__t"), F.col("x.kind").alias("__kind"), F.floor(F.col("x.t") / wide).alias("__s"))
        met = met.unionByName(_sweep(panes, asked, [*key, "__days", "__s"], parts))
    fits_window = lambda days: F.col("__days").isNull() | (F.col("__days") == days)
    rollup = met.groupBy(*key, cutoff).agg(*[getattr(F, fn)(F.when(fits_window(days), F.col(h))).alias(h) for h, (fn, days, _) in parts.items()])
    made = rollup.select(*key, cutoff, *[c.alias(n) for n, c in finish.items()])
    filled = {n: F.coalesce(F.col(n), F.lit(default)) for n in features}
    return base.join(made, [*key, cutoff], "left").withColumns(filled)


def _sweep(data: DataFrame, probes: DataFrame, by: Sequence[str], parts: Mapping[str, tuple[str, int, Column]]) -> DataFrame:
    """Probes with the aggregate of the data in their slice: up to their time (kind 1), or after it (kind 2).

    Each kind is swept by itself, so every row is sorted once, and a probe carries one null for all the values.
    """
    own = [c for c in probes.columns if c not in ("__t", "__s", "__kind")]
    packed = data.select(*by, "__t", F.lit(0).alias("__kind"), F.struct(*parts).alias("__v"))
    swept = []
    for kind, order in ((1, ("__t", "__kind")), (2, (F.desc("__t"), F.desc("__kind")))):
        rows = packed.unionByName(probes.filter(F.col("__kind") == kind), allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = {h: getattr(F, fn)(F.col("__v")[h]).over(w) for h, (fn, _, _) in parts.items()}
        swept.append(rows.withColumns(seen).filter("__kind > 0").select(*own, *parts))
    return swept[0].unionByName(swept[1])


def join_features(entities: DataFrame, key: Sequence[str], features: Sequence[DataFrame], default: object = 0) -> DataFrame:
    """One aggregate frame per feature set, joined to the entity list so that no entity is lost."""
    out = entities.select(*key).distinct()
    for frame in features:
        names = [c for c in frame.columns if c not in key]
        out = out.join(frame, list(key), "left").withColumns(
            {n: F.coalesce(F.col(n), F.lit(default)) for n in names}
        )
    return out


def downsample(
    df: DataFrame, time: str, unit: str, series: Sequence[str], value: str, method: str = "average"
) -> DataFrame:
    """One value per series and bucket: average, first or last by time; of equal times the least or greatest value."""
    need_columns(df, [time, value, *series])
    place = F.when(F.col(time).isNotNull(), F.struct(time, value))
    how = {
        "average": F.avg(value),
        "first": F.min_by(value, place),
        "last": F.max_by(value, place),
    }
    if method not in how:
        raise ConfigError("INVALID_METHOD", method)
    return df.groupBy(*series, time_bucket(time, unit).alias("period_bucket")).agg(how[method].alias(value))


def derived_metrics(df: DataFrame, formulas: Mapping[str, str], digits: int = 4) -> DataFrame:
    """Metric formulas over aggregated columns, rounded for output."""
    need(bool(formulas), "MISSING_FORMULAS", "needs at least one formula")
    return df.select("*", *[F.round(F.expr(e), digits).alias(n) for n, e in formulas.items()])
