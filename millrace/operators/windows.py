"""Ordered operators per key that keep no whole key in one task.

A plain window sends every row of a key to one task, so a key with a third of the rows stalls
the job. Here each key is cut into *slices*: ``slice_by`` is an expression that never decreases
along the leading order column (a day, a month, a value band). Windows run per (key, slice);
what a slice needs from its neighbours arrives as a few extra rows:

* running totals and ranks: one row per slice holding what came before,
* row frames, lag and lead: the last (first) n rows of the slices before (after),
* time frames: running aggregates of a slice and of the one before (see ``rolling_days``).

The rows are shuffled once, by (key, slice): side tables are computed on that same exchange (Spark
reuses it), and the extra rows are placed by the same partitioning, so the union above needs no
further shuffle. ``slice_by=None`` runs a plain window, for keys known to be small.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need, need_columns
from ..functions.sizes import sort_pieces

SLICE, MAIN = "__slice", "__main"


# -- ordering -----------------------------------------------------------------


def order_name(item: str) -> str:
    return item.split()[0]


def descending(item: str) -> bool:
    return item.strip().lower().endswith(" desc")


def order_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(order_name(o)).desc() if descending(o) else F.col(order_name(o)).asc() for o in order]


def reversed_order(order: Sequence[str]) -> list[Column]:
    return [
        F.col(order_name(o)).asc_nulls_last() if descending(o) else F.col(order_name(o)).desc_nulls_last()
        for o in order
    ]


def flipped(order: Sequence[str]) -> list[str]:
    """The order from the other end; nulls change ends with it."""
    return [order_name(o) if descending(o) else f"{order_name(o)} desc" for o in order]


def row_fallback(df: DataFrame) -> Column:
    """Last tie-break: a fingerprint of the whole row, so the survivor never depends on layout."""
    usable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in usable])


# -- one row per key ----------------------------------------------------------


def dedupe(
    df: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = (),
    method: str = "row_number",
    top: int = 1,
) -> DataFrame:
    """First ``top`` rows per key; without keys, distinct rows.

    Spark prunes each map task to the leading rows of a key before the shuffle, so hot keys
    arrive already reduced. A large input is pruned behind a shuffle instead, where the rows of a
    key that one task has read meet, and both sorts are cut into tasks by the size of the input:
    a task that scans sorts nothing, and small partitions are not joined into large ones.
    """
    if not keys:
        return df.distinct()
    need(method in ("row_number", "rank", "dense_rank"), "INVALID_METHOD", method)
    need_columns(df, [*keys, *[order_name(o) for o in order]])
    ordering = order_columns(order)
    if method == "row_number":
        ordering.append(row_fallback(df).asc())
    need(bool(ordering), "MISSING_ORDER", f"{method} needs an order")

    def leading(rows: DataFrame, *by: str) -> DataFrame:
        ranked = rows.withColumn("__rank", getattr(F, method)().over(Window.partitionBy(*by).orderBy(*ordering)))
        return ranked.filter(F.col("__rank") <= top).drop("__rank")

    if pieces := sort_pieces(df):
        read = df.withColumn("__task", F.spark_partition_id()).repartition(pieces, *keys, "__task")
        df = leading(read, *keys, "__task").drop("__task").repartition(pieces, *keys)
    return leading(df, *keys)


def dedupe_priority(
    df: DataFrame, keys: Sequence[str], source: str, priority: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """The source listed first wins; unlisted sources come last."""
    need(bool(priority), "MISSING_PRIORITY", "needs the sources in order of priority")
    position = F.lit(len(priority))
    for i, name in reversed(list(enumerate(priority))):
        position = F.when(F.col(source) == name, F.lit(i)).otherwise(position)
    ranked = df.withColumn("__source", position)
    return dedupe(ranked, keys, ["__source", *order]).drop("__source")


def dedupe_quarantine(
    df: DataFrame, key: Sequence[str], version: str, order: Sequence[str] = (), reason: str = "reason"
) -> tuple[DataFrame, DataFrame]:
    """Latest version per key; null keys and conflicting latest versions go to quarantine.

    A conflict is two rows of the same key and latest version that differ in any value column.
    Everything per (key, version) is a min/max aggregate, so copies collapse before the shuffle.
    """
    need_columns(df, [*key, version])
    no_key = F.lit(False)
    for k in key:
        no_key = no_key | F.col(k).isNull()
    skip = {*key, version, *[order_name(o) for o in order]}
    values = F.struct(*[F.col(c) for c in df.columns if c not in skip])
    keyed = df.filter(~no_key)
    per_version = keyed.groupBy(*key, version).agg(
        F.min(values).alias("__low"), F.max(values).alias("__high")
    )
    latest = dedupe(per_version, key, [f"{version} desc"])
    conflict = latest.filter(~F.col("__low").eqNullSafe(F.col("__high"))).select(*key)
    best = dedupe(keyed, key, [f"{version} desc", *order])
    accepted = best.join(conflict, list(key), "left_anti")
    quarantine = df.filter(no_key).withColumn(reason, F.lit("null-key")).unionByName(
        keyed.join(conflict, list(key), "left_semi").withColumn(reason, F.lit("same-timestamp-conflict"))
    )
    return accepted.select(*df.columns), quarantine


# -- slices -------------------------------------------------------------------


def _slice_order(order: Sequence[str]) -> Column:
    return F.col(SLICE).desc_nulls_last() if descending(order[0]) else F.col(SLICE).asc_nulls_first()


def _per_key(keys: Sequence[str], order: Sequence[str]):
    """Window over the slices of a key: one row per slice, so its size is the number of slices."""
    return Window.partitionBy(*keys).orderBy(_slice_order(order))


def with_halo(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, before: int = 0, after: int = 0
) -> DataFrame:
    """Rows with their slice, plus up to ``before``/``after`` neighbour rows marked ``__main = false``."""
    need(bool(order), "MISSING_ORDER", "ordered windows need an order")
    base = df.withColumn(SLICE, slice_by).repartition(*keys, SLICE)
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = base.withColumn(MAIN, F.lit(True))
    per_key = _per_key(keys, order)
    for n, backwards in ((before, True), (after, False)):
        if n <= 0:
            continue
        edge_order = reversed_order(order) if backwards else order_columns(order)
        edge = Window.partitionBy(*keys, SLICE).orderBy(*edge_order)
        edges = base.withColumn("__pos", F.row_number().over(edge)).filter(F.col("__pos") <= n)
        # At most n rows per slice; sorted nearest first.
        lists = edges.groupBy(*keys, SLICE).agg(
            F.sort_array(F.collect_list(F.struct(F.col("__pos"), packed.alias("__row")))).alias("__near")
        )
        # A slice sends its edge rows to the slices beyond it until n rows lie between; the window
        # over a key's slices sees their sizes, never their rows.
        frame = per_key.rowsBetween(1, n) if backwards else per_key.rowsBetween(-n, -1)
        beyond = F.collect_list(F.struct(F.col(SLICE).alias("to"), F.size("__near").alias("rows"))).over(frame)
        lists = lists.withColumn("__beyond", beyond if backwards else F.reverse(beyond))

        def left(place: Column, n: int = n) -> Column:
            between = F.aggregate(F.slice("__beyond", 1, place), F.lit(0), lambda total, x: total + x["rows"])
            return F.lit(n) - between

        targets = F.transform("__beyond", lambda x, i: F.struct(x["to"].alias("to"), left(i).alias("rows")))
        halo = (
            lists.select("__near", F.explode(F.filter(targets, lambda x: x["rows"] > 0)).alias("__target"))
            .select(F.col("__target.to").alias(SLICE), F.explode(F.slice("__near", 1, F.col("__target.rows"))).alias("__item"))
            .select(SLICE, "__item.__row.*")
            .withColumn(MAIN, F.lit(False))
        )
        out = out.unionByName(halo.repartition(*keys, SLICE))
    return out


def _finish(df: DataFrame) -> DataFrame:
    return df.filter(F.col(MAIN)).drop(SLICE, MAIN)


def rolling_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggregates: Mapping[str, Column],
    preceding: int,
    *,
    slice_by: Column | None = None,
) -> DataFrame:
    """Aggregates over the ``preceding`` rows before the current one, and itself."""
    need_columns(df, [*keys, *[order_name(o) for o in order]])
    if slice_by is None:
        w = Window.partitionBy(*keys).orderBy(*order_columns(order)).rowsBetween(-preceding, 0)
        return df.withColumns({n: a.over(w) for n, a in aggregates.items()})
    rows = with_halo(df, keys, order, slice_by, before=preceding)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order_columns(order)).rowsBetween(-preceding, 0)
    return _finish(rows.withColumns({n: a.over(w) for n, a in aggregates.items()}))


def lag_lead(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lags: Mapping[str, tuple[str, int]] | None = None,
    leads: Mapping[str, tuple[str, int]] | None = None,
    *,
    slice_by: Column | None = None,
) -> DataFrame:
    """Values of the row ``n`` places before (lags) or after (leads): ``{name: (column, n)}``."""
    lags, leads = dict(lags or {}), dict(leads or {})
    parts = list(keys)
    rows = df
    if slice_by is not None:
        rows = with_halo(
            df, keys, order, slice_by,
            before=max((n for _, n in lags.values()), default=0),
            after=max((n for _, n in leads.values()), default=0),
        )
        parts.append(SLICE)
    w = Window.partitionBy(*parts).orderBy(*order_columns(order))
    added = {n: F.lag(c, k).over(w) for n, (c, k) in lags.items()}
    added |= {n: F.lead(c, k).over(w) for n, (c, k) in leads.items()}
    rows = rows.withColumns(added)
    return rows if slice_by is None else _finish(rows)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggregates: Mapping[str, tuple[str, Column]],
    *,
    slice_by: Column | None = None,
) -> DataFrame:
    """``{name: (sum|min|max, value)}`` from the start of the key up to the current row, row by row."""
    need_columns(df, [*keys, *[order_name(o) for o in order]])
    for fn, _ in aggregates.values():
        need(fn in ("sum", "min", "max"), "INVALID_FUNCTION", fn)
    fns = [getattr(F, fn) for fn, _ in aggregates.values()]
    if slice_by is None:
        w = Window.partitionBy(*keys).orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: f(c).over(w) for f, (n, (_, c)) in zip(fns, aggregates.items(), strict=True)})
    values = {f"__v{i}": c for i, (_, c) in enumerate(aggregates.values())}
    base = df.withColumns({SLICE: slice_by, **values, MAIN: F.lit(True)}).repartition(*keys, SLICE)
    totals = base.groupBy(*keys, SLICE).agg(*[f(v).alias(v) for f, v in zip(fns, values, strict=True)])
    earlier = _per_key(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({v: f(v).over(earlier) for f, v in zip(fns, values, strict=True)})
    placed = carry.withColumn(MAIN, F.lit(False)).repartition(*keys, SLICE)
    rows = base.unionByName(placed, allowMissingColumns=True)
    w = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(F.col(MAIN), *order_columns(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    made = {n: f(v).over(w) for f, n, v in zip(fns, aggregates, values, strict=True)}
    return _finish(rows.withColumns(made)).drop(*values)


def edge_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, tuple[str, Column, str, bool]],
    *,
    slice_by: Column | None = None,
) -> DataFrame:
    """``{name: (sum|min|max, value, from, peers)}``: totals between an end of the key and the current row.

    ``from`` is ``start``, ``end``, or ``all`` for the whole key; with ``peers`` rows that tie with the
    current one count. All of them share one layout: a row for each slice brings what lies before it,
    after it, or in the whole key.
    """
    need_columns(df, [*keys, *[order_name(o) for o in order]])

    def over(fn: str, value: Column | str, way: str, peers: bool, parts: Sequence[str], first: Sequence[Column]) -> Column:
        w = Window.partitionBy(*parts).orderBy(*first, *order_columns(order if way == "start" else flipped(order)))
        return getattr(F, fn)(value).over((w.rangeBetween if peers else w.rowsBetween)(Window.unboundedPreceding, Window.currentRow))

    if slice_by is None:
        made = {n: getattr(F, fn)(v).over(Window.partitionBy(*keys)) if way == "all" else over(fn, v, way, peers, keys, []) for n, (fn, v, way, peers) in totals.items()}
        return df.withColumns(made)
    values = {f"__v{i}": v for i, (_, v, *_) in enumerate(totals.values())}
    base = df.withColumns({SLICE: slice_by, **values, MAIN: F.lit(True)}).repartition(*keys, SLICE)
    sums = base.groupBy(*keys, SLICE).agg(*[getattr(F, fn)(v).alias(v) for v, (fn, *_) in zip(values, totals.values(), strict=True)])
    slices = _per_key(keys, order)
    spans = {
        "start": slices.rowsBetween(Window.unboundedPreceding, -1), "end": slices.rowsBetween(1, Window.unboundedFollowing),
        "all": slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    }
    brought = {f"__c{i}": getattr(F, fn)(f"__v{i}").over(spans[way]) for i, (fn, _, way, _) in enumerate(totals.values())}
    carry = sums.withColumns(brought).drop(*values).withColumn(MAIN, F.lit(False)).repartition(*keys, SLICE)
    whole = Window.partitionBy(*keys, SLICE)
    made = {}
    for i, (name, (fn, _, way, peers)) in enumerate(totals.items()):
        made[name] = F.max(f"__c{i}").over(whole)
        if way != "all":
            own = over(fn, f"__v{i}", way, peers, [*keys, SLICE], [F.col(MAIN)])
            both = own + made[name] if fn == "sum" else (F.least if fn == "min" else F.greatest)(own, made[name])
            made[name] = F.coalesce(both, own, made[name])
    return _finish(base.unionByName(carry, allowMissingColumns=True).withColumns(made)).drop(*values, *brought)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    slice_by: Column | None = None,
) -> DataFrame:
    return running(df, keys, order, {n: ("sum", c) for n, c in sums.items()}, slice_by=slice_by)


def rank_family(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, str],
    *,
    slice_by: Column | None = None,
) -> DataFrame:
    """``{name: function}`` with row_number, rank, dense_rank, cume_dist, percent_rank or ``ntile(n)``."""
    need_columns(df, [*keys, *[order_name(o) for o in order]])
    for fn in outputs.values():
        known = fn in ("row_number", "rank", "dense_rank", "cume_dist", "percent_rank")
        need(known or bool(re.fullmatch(r"ntile\(\d+\)", fn)), "INVALID_METHOD", fn)
    if slice_by is None:
        w = Window.partitionBy(*keys).orderBy(*order_columns(order))
        made = {}
        for name, fn in outputs.items():
            bins = re.fullmatch(r"ntile\((\d+)\)", fn)
            value = F.ntile(int(bins.group(1))).over(w) if bins else getattr(F, fn)().over(w)
            made[name] = value if fn in ("cume_dist", "percent_rank") else value.cast("long")
        return df.withColumns(made)

    base = df.withColumns({SLICE: slice_by, MAIN: F.lit(True)}).repartition(*keys, SLICE)
    shape = [F.count(F.lit(1)).alias("__n")]
    if "dense_rank" in outputs.values():
        shape.append(F.count_distinct(F.struct(*[F.col(order_name(o)) for o in order])).alias("__d"))
    sizes = base.groupBy(*keys, SLICE).agg(*shape)
    earlier = _per_key(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(*keys)
    carried = {
        "__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
        "__all": F.sum("__n").over(all_rows),
    }
    if "dense_rank" in outputs.values():
        carried["__dense"] = F.coalesce(F.sum("__d").over(earlier), F.lit(0))
    carry = sizes.withColumns(carried).drop("__n", "__d").withColumn(MAIN, F.lit(False))
    rows = base.unionByName(carry.repartition(*keys, SLICE), allowMissingColumns=True)

    whole = Window.partitionBy(*keys, SLICE)
    w = whole.orderBy(F.col(MAIN), *order_columns(order))
    before, total = F.max("__before").over(whole), F.max("__all").over(whole)
    # The carry row sorts first in its slice, hence the "- 1".
    number = F.row_number().over(w) - 1 + before
    rank = F.rank().over(w) - 1 + before
    made = {}
    for name, fn in outputs.items():
        if fn == "row_number":
            made[name] = number
        elif fn == "rank":
            made[name] = rank
        elif fn == "dense_rank":
            made[name] = F.dense_rank().over(w) - 1 + F.max("__dense").over(whole)
        elif fn == "cume_dist":
            upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            made[name] = (upto - 1 + before) / total
        elif fn == "percent_rank":
            made[name] = F.when(total > 1, (rank - 1) / (total - 1)).otherwise(F.lit(0.0))
        else:
            made[name] = _ntile(number, total, int(fn[6:-1])).cast("long")
    return _finish(rows.withColumns(made)).drop("__before", "__all", "__dense")


def _ntile(number: Column, total: Column, bins: int) -> Column:
    """The first ``total % bins`` bins hold one row more than the rest."""
    small = F.floor(total / bins)
    extra = total % bins
    wide = extra * (small + 1)
    in_wide = F.ceil(number / (small + 1))
    in_small = extra + F.ceil((number - wide) / F.greatest(small, F.lit(1)))
    return F.when(number <= wide, in_wide).otherwise(in_small)


def rolling_days(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    aggregates: Mapping[str, tuple[str, str]],
    days: int,
) -> DataFrame:
    """``{name: (function, column)}`` over the rows of the last ``days`` days up to each row's time.

    Spark evaluates a sliding frame row by row, at a cost of rows times frame size. Here time is
    cut into slices exactly as wide as the frame. The frame of a row then ends in its own slice
    and begins in the one before, so it is a running aggregate from the slice's start, merged
    with a running aggregate towards the end of the slice before. Both are linear, and no task
    holds more than a key's slice.
    """
    need_columns(df, [*keys, time, *[c for _, c in aggregates.values()]])
    need(days > 0, "INVALID_DAYS", str(days))
    parts: dict[str, tuple[str, str]] = {}  # helper column -> (merge function, source column)
    for fn, c in aggregates.values():
        need(fn in ("sum", "avg", "min", "max", "count"), "INVALID_FUNCTION", fn)
        for part in {"avg": ("sum", "count")}.get(fn, (fn,)):
            parts[f"__{part}_{c}"] = (part, c)
    if isinstance(df.schema[time].dataType, T.TimestampType):
        number = F.floor(F.unix_micros(time) / F.lit(days * 86_400_000_000))
    else:
        number = F.floor(F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) / days)
    base = df.withColumn(SLICE, number).repartition(*keys, SLICE)

    def span(*order: Column):
        w = Window.partitionBy(*keys, SLICE).orderBy(*order)
        return w.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    from_start, to_end = span(F.col(time).asc()), span(F.col(time).desc())
    made = base.withColumns(
        {f"{h}_head": getattr(F, fn)(c).over(from_start) for h, (fn, c) in parts.items()}
        | {f"{h}_tail": getattr(F, fn)(c).over(to_end) for h, (fn, c) in parts.items()}
    )
    heads, tails = [f"{h}_head" for h in parts], [f"{h}_tail" for h in parts]
    rows = F.struct(*[F.col(f"`{c}`") for c in [*df.columns, *heads]])
    data = made.select(*keys, SLICE, F.col(time).alias("__t"), F.lit(0).alias("__kind"), *tails, F.lit(None).cast(made.select(rows).schema[0].dataType).alias("__row"))
    begin = F.col(time) - F.expr(f"INTERVAL {int(days)} DAYS")
    # Rows without a time are peers of each other alone: their frame is their own slice.
    timeless = made.filter(F.col(time).isNull()).select(rows.alias("__row"), *[F.lit(None).cast(made.schema[c].dataType).alias(c) for c in tails])
    probes = made.filter(F.col(time).isNotNull()).select(
        *keys, (F.col(SLICE) - 1).alias(SLICE), begin.alias("__t"), F.lit(1).alias("__kind"),
        *[F.lit(None).cast(made.schema[c].dataType).alias(c) for c in tails], rows.alias("__row"),
    )
    # Latest first: the last data row before a probe is the earliest one inside its frame.
    back = Window.partitionBy(*keys, SLICE).orderBy(F.col("__t").desc(), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    met = data.unionByName(probes.repartition(*keys, SLICE)).withColumns(
        {c: F.last(c, ignorenulls=True).over(back) for c in tails}
    )
    found = met.filter("__kind = 1").select("__row", *tails).unionByName(timeless).select("__row.*", *tails)

    def merged(h: str) -> Column:
        fn = parts[h][0]
        head, tail = F.col(f"{h}_head"), F.col(f"{h}_tail")
        if fn in ("min", "max"):
            return (F.least if fn == "min" else F.greatest)(head, tail)
        return F.when(head.isNull(), tail).otherwise(head + F.coalesce(tail, F.lit(0)))

    out = {}
    for name, (fn, c) in aggregates.items():
        out[name] = F.try_divide(merged(f"__sum_{c}"), merged(f"__count_{c}")) if fn == "avg" else merged(f"__{fn}_{c}")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(n) for n, v in out.items()])


def lookback(df: DataFrame, window_step, emit: Column, context: Column) -> DataFrame:
    """Run a window step over the context rows, then emit only the wanted ones.

    ``context`` holds for the rows to emit and all that their windows reach back to. It is applied
    below the window, so with a bound on a plain column it reaches the scan.
    """
    return window_step(df.filter(context)).filter(emit)


# -- declarative window list --------------------------------------------------

EDGE = r"(?:unbounded|\d+(?:\s+days?)?)\s+(?:preceding|following)|current\s+row"
FRAME = re.compile(rf"(rows|range)\s+between\s+({EDGE})\s+and\s+({EDGE})", re.I)
FROM_START = "rows between unbounded preceding and current row"
RANKS = ("row_number", "rank", "dense_rank", "cume_dist", "percent_rank")
AGGREGATES = ("sum", "avg", "min", "max", "count")


def _frame(spec: Mapping[str, object]) -> tuple[bool, int | None, int | None]:
    """Whether the frame counts rows, and its first and last place from the current row (None: the end of the key)."""
    text = str(spec.get("frame") or FROM_START).strip()
    match = FRAME.fullmatch(text)
    need(match is not None, "INVALID_FRAME", text)
    edges = [edge.lower().split() for edge in match.groups()[1:]]
    need(edges[0] != ["unbounded", "following"] and edges[1] != ["unbounded", "preceding"], "INVALID_FRAME", text)

    def place(words: list[str]) -> int | None:
        if words[0] in ("unbounded", "current"):
            return None if words[0] == "unbounded" else 0
        return int(words[0]) if words[-1] == "following" else -int(words[0])

    first, last = place(edges[0]), place(edges[1])
    need(first is None or last is None or first <= last, "INVALID_FRAME", f"{text}: ends before it begins")
    by_rows = match.group(1).lower() == "rows"
    if not by_rows:
        known = None in (first, last) and {first, last} <= {None, 0} or (first or 0) <= 0 <= (last or 0) and 0 in (first, last)
        need(known, "INVALID_FRAME", f"{text}: a time frame reaches to the current row, from days or an end of the key")
    return by_rows, first, last


def apply_specs(
    df: DataFrame, specs: Sequence[Mapping[str, object]], *, slice_by: Column | None = None
) -> DataFrame:
    """Add one column per ``{column, function, argument, partition_by, order_by, frame}``.

    Specs over the same keys and order share one pass per kind: ranks, totals from the start or to the
    end of a key, totals of a key, time frames (``range between 7 days preceding and current row`` or
    ``current row and 7 days following``, over one time column), and everything that looks a bounded
    number of rows around. A frame of rows from an end of the key to a row k places off is the total up
    to the current row, read k rows away. ``lag`` and ``lead`` take an ``offset`` and a ``default``.

    Frames of rows need an order without ties: rows that tie fall by chance, in each pass anew. A
    window over the whole table needs ``slice_by``: its rows are spread by slice, and only one row for
    each slice meets in one task. Null times come first, and are peers of each other alone in time frames.
    """
    groups: dict[tuple, list[Mapping[str, object]]] = {}
    for spec in specs:
        keys, order = tuple(spec.get("partition_by", ())), tuple(spec.get("order_by", ()))
        need(bool(keys) or slice_by is not None, "MISSING_PARTITION", f"{spec['column']}: a window over the whole table needs slices")
        groups.setdefault((keys, order), []).append(spec)
    for (keys, order), members in groups.items():
        df = _apply_group(df, list(keys), list(order), members, slice_by)
    return df


def _apply_group(df, keys, order, specs, slice_by):
    ranks: dict[str, str] = {}
    totals: dict[str, tuple[str, Column, str, bool]] = {}
    away: list[str] = []  # totals that are read some rows off
    averages: list[str] = []
    counts: list[str] = []
    days: dict[tuple[bool, int], dict[str, tuple[str, str]]] = {}
    near: dict[str, tuple[Callable[[WindowSpec], Column], int, int]] = {}
    for spec in specs:
        name, fn, arg = str(spec["column"]), str(spec["function"]).lower(), spec.get("argument")
        arg = None if arg in (None, "*") else str(arg)
        if fn in RANKS or fn.startswith("ntile"):
            ranks[name] = fn
            continue
        if fn in ("lag", "lead"):
            n = int(spec.get("offset", 1))
            near[name] = (_neighbour(fn, arg, n, spec.get("default")), n if fn == "lag" else 0, n if fn == "lead" else 0)
            continue
        need(fn in AGGREGATES, "INVALID_FUNCTION", fn)
        by_rows, first, last = _frame(spec)
        value = F.lit(1) if arg is None else F.col(arg)
        if first is not None and last is not None:
            if by_rows:
                near[name] = (_around(fn, value, first, last), max(-first, 0), max(last, 0))
                continue
            need(len(order) == 1 and not descending(order[0]), "INVALID_FRAME", f"{name}: a time frame needs one ascending time column")
            days.setdefault((last > 0, max(-first, last)), {})[name] = (fn, arg or order_name(order[0]))
            continue
        if fn == "avg":
            averages.append(name)
            parts = {f"__sum_{name}": ("sum", value), f"__n_{name}": ("sum", value.isNotNull().cast("long"))}
        elif fn == "count":
            counts.append(name)
            parts = {name: ("sum", value.isNotNull().cast("long"))}
        else:
            parts = {name: (fn, value)}
        way = "all" if first is None and last is None else "start" if first is None else "end"
        k = first or last or 0
        for part, (total, v) in parts.items():
            totals[f"__at_{part}" if k else part] = (total, v, way, not by_rows)
            if k:
                away.append(f"__at_{part}")
                # Past the far end of the key the last total counts; past the near end there is none.
                near[part] = (_read_off(f"__at_{part}", k, way), max(-k, 0), max(k, 0))
    if totals:
        df = edge_totals(df, keys, order, totals, slice_by=slice_by)
    if near:
        df = _nearby(df, keys, order, near, slice_by).drop(*away)
    if ranks:
        df = rank_family(df, keys, order, ranks, slice_by=slice_by)
    for name in averages:
        df = df.withColumn(name, F.try_divide(f"__sum_{name}", f"__n_{name}")).drop(f"__sum_{name}", f"__n_{name}")
    for name in counts:
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    for (ahead, length), members in days.items():
        time = order_name(order[0])
        if ahead:
            # The days after a time are the days before it on a mirrored axis.
            df = rolling_days(df.withColumn(MIRROR, _mirrored(df, time)), keys, MIRROR, members, length).drop(MIRROR)
        else:
            df = rolling_days(df, keys, time, members, length)
    return df


MIRROR = "__mirror"


def _mirrored(df: DataFrame, time: str) -> Column:
    kind = df.schema[time].dataType
    if isinstance(kind, T.DateType):
        return F.date_sub(F.lit("1970-01-01").cast("date"), F.datediff(F.col(time), F.lit("1970-01-01").cast("date")))
    return F.lit("1970-01-01").cast(kind) - (F.col(time) - F.lit("1970-01-01").cast(kind))


def _neighbour(fn: str, arg: str | None, n: int, default: object) -> Callable[[WindowSpec], Column]:
    need(arg is not None, "MISSING_ARGUMENT", fn)
    return lambda w: getattr(F, fn)(arg, n, default).over(w)


def _around(fn: str, value: Column, first: int, last: int) -> Callable[[WindowSpec], Column]:
    return lambda w: getattr(F, fn)(value).over(w.rowsBetween(first, last))


def _read_off(part: str, k: int, way: str) -> Callable[[WindowSpec], Column]:
    """The total at the row ``k`` places on. Beyond the end it runs towards, it is that of the last row there."""
    if k > 0 and way == "start":
        return lambda w: F.last(part).over(w.rowsBetween(0, k))
    if k < 0 and way == "end":
        return lambda w: F.first(part).over(w.rowsBetween(k, 0))
    return lambda w: F.lead(part, k).over(w) if k > 0 else F.lag(part, -k).over(w)


def _nearby(df, keys, order, near, slice_by):
    before, after = (max((item[i] for item in near.values()), default=0) for i in (1, 2))
    rows, parts = df, list(keys)
    if slice_by is not None:
        rows, parts = with_halo(df, keys, order, slice_by, before, after), [*keys, SLICE]
    w = Window.partitionBy(*parts).orderBy(*order_columns(order))
    rows = rows.withColumns({name: make(w) for name, (make, *_) in near.items()})
    return rows if slice_by is None else _finish(rows)
