"""Exact quantiles without gathering a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in memory. Here an approximate
sketch only proposes cut points. Rows are counted exactly per band between cut points (a handful
of counters leave each task), the band that holds the wanted rank follows from those counts, and
only that band's values are shuffled and ranked. A value that fills a band is one row there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need, need_columns


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], bands: int = 256
) -> list[float | None]:
    """Linearly interpolated quantiles, as ``percentile`` defines them."""
    need_columns(df, [column])
    need(all(0 <= p <= 1 for p in probabilities), "INVALID_PROBABILITY", str(list(probabilities)))
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    first = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [i / bands for i in range(1, bands)], 4 * bands).alias("cuts"),
    ).first()
    n = int(first["n"])
    if n == 0:
        return [None for _ in probabilities]
    banded = values.withColumn("band", _band(sorted(set(first["cuts"]))))
    per_band = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, start = {}, 0
    for band in sorted(per_band):
        before[band] = start
        start += per_band[band]

    wanted = set()
    for p in probabilities:
        position = p * (n - 1)
        wanted |= {int(position), min(int(position) + 1, n - 1)}
    hit = sorted({b for b in before for r in wanted if before[b] <= r < before[b] + per_band[b]})
    w = Window.partitionBy("band").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = banded.filter(F.col("band").isin(hit)).groupBy("band", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("upto", F.sum("n").over(w))
    offset = F.create_map(*[x for b in hit for x in (F.lit(b), F.lit(before[b]))])
    ranked = ranked.withColumn("last", F.element_at(offset, F.col("band")) + F.col("upto") - 1).withColumn(
        "first", F.col("last") - F.col("n") + 1
    )
    holds = F.lit(False)
    for r in sorted(wanted):
        holds = holds | ((F.col("first") <= r) & (F.col("last") >= r))
    rows = ranked.filter(holds).select("first", "last", "v").collect()  # at most two per probability

    def at(rank: int) -> float:
        return next(r["v"] for r in rows if r["first"] <= rank <= r["last"])

    out = []
    for p in probabilities:
        position = p * (n - 1)
        low = int(position)
        high = min(low + 1, n - 1)
        out.append(at(low) + (position - low) * (at(high) - at(low)))
    return out


def _band(cuts: Sequence[float], width: int = 16, name: str = "v") -> Column:
    """How many cut points lie at or below the value: first among every 16th, then within its run."""
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if not runs:
        return F.lit(0)

    def at_or_below(points: Column) -> Column:
        return F.size(F.filter(points, lambda c: c <= F.col(name)))

    heads = F.array(*[F.lit(float(r[0])) for r in runs])
    table = F.array(*[F.array(*[F.lit(float(c)) for c in r]) for r in runs])
    run = at_or_below(heads)
    inside = (run - 1) * width + at_or_below(F.element_at(table, run))
    return F.when(run == 0, F.lit(0)).otherwise(inside)


#: At most this many slices by value; rows that share a value fall into this many more by a hash.
MAX_SLICES, TIE_SLICES = 4096, 64
#: Whole numbers below this are exact as doubles.
EXACT_BELOW = 1 << 53
PLACE = "__place"


def with_even_slices(df: DataFrame, column: str, tie: Column, name: str, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Adds a slice number that rises with (column, tie), such that slices hold about equal numbers of rows.

    One pass counts the rows and sketches cut points of the column, whatever its range is: at most
    ``MAX_SLICES`` numbers reach the driver. A value that two cut points name fills a band by itself; it,
    and the rows without a value (first), are split by the leading bits of ``tie``, the 64-bit hash that
    orders ties. Numbers, dates, times and texts can be sliced. Texts are told apart by their first six
    bytes; those, decimals and whole numbers beyond 2^53 are not split within a value.
    """
    need_columns(df, [column])
    kind = df.schema[column].dataType
    placed = df.withColumn(PLACE, _rising(F.col(f"`{column}`"), kind))
    seen = placed.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(PLACE, [i / MAX_SLICES for i in range(1, MAX_SLICES)], 2 * MAX_SLICES).alias("cuts"),
    ).first()
    wanted = min(max(-(-int(seen["n"]) // rows_per_slice), 1), MAX_SLICES)
    cuts = [c for c in seen["cuts"] or [] if not math.isnan(c)]
    chosen = [cuts[len(cuts) * i // wanted] for i in range(1, wanted)] if cuts else []
    exact = not isinstance(kind, (T.StringType, T.DecimalType))
    heavy = sorted({a for a, b in itertools.pairwise(chosen) if a == b and exact and (isinstance(kind, T.FractionalType) or abs(a) < EXACT_BELOW)})
    # A heavy value has an edge on either side, so that its band holds nothing else.
    edges = sorted({*chosen, *[math.nextafter(v, math.inf) for v in heavy]})
    alone = F.col(PLACE).isNull()
    if heavy:
        alone = alone | F.array_contains(F.array(*[F.lit(v) for v in heavy]), F.col(PLACE))
    band = F.when(F.col(PLACE).isNull(), -1).otherwise(_band(edges, max(int(len(edges) ** 0.5), 1), PLACE))
    spread = F.when(alone, F.shiftright(tie, 58) + TIE_SLICES // 2).otherwise(0)
    return placed.withColumn(name, band.cast("long") * TIE_SLICES + spread).drop(PLACE)


def _rising(value: Column, kind: T.DataType) -> Column:
    """A double that never falls where the value rises."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    need(isinstance(kind, T.NumericType), "INVALID_ORDER", kind.simpleString())
    return value.cast("double")
