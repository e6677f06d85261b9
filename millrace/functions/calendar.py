"""Business-day calendars as frames with a running open-day number.

A calendar has a fixed size (one row per day of the given years), so it may be broadcast.
Business-day arithmetic is then two equi-joins: date to number, number plus or minus n to date.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, need
from ..operators.windows import running_total
from ..session import scratch_path
from .dates import split_token

FIRST_YEAR, LAST_YEAR = 1900, 2100
CALENDARS = ("US", "US-FED", "US-NYSE")


def _nth(year: Column, month: int, day_name: str, n: int) -> Column:
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, day_name), 7 * (n - 1))


def _last(year: Column, month: int, day_name: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), day_name)


def _observed(year: Column, month: int, day: int) -> Column:
    d = F.make_date(year, F.lit(month), F.lit(day))
    weekday = F.dayofweek(d)
    return F.when(weekday == 7, F.date_sub(d, 1)).when(weekday == 1, F.date_add(d, 1)).otherwise(d)


def easter(year: str = "year") -> Column:
    """Easter Sunday by the method of Gauss, days counted from 22 March."""
    k = f"({year} div 100)"
    shift_m = f"((15 - (13 + 8 * {k}) div 25 + {k} - {k} div 4) % 30)"
    shift_n = f"((4 + {k} - {k} div 4) % 7)"
    d = f"((19 * ({year} % 19) + {shift_m}) % 30)"
    e = f"((2 * ({year} % 4) + 4 * ({year} % 7) + 6 * {d} + {shift_n}) % 7)"
    days = (
        f"CASE WHEN {d} = 29 AND {e} = 6 THEN 28 "
        f"WHEN {d} = 28 AND {e} = 6 AND {year} % 19 > 10 THEN 27 ELSE {d} + {e} END"
    )
    return F.expr(f"date_add(make_date({year}, 3, 22), CAST({days} AS INT))")


def holidays(spark: SparkSession, calendar_id: str = "US") -> DataFrame:
    need(calendar_id in CALENDARS, "UNKNOWN_CALENDAR", calendar_id)
    y = F.col("year")
    rules = [
        _observed(y, 1, 1),
        _nth(y, 1, "Mon", 3),
        _nth(y, 2, "Mon", 3),
        _last(y, 5, "Mon"),
        F.when(y >= 2021, _observed(y, 6, 19)),
        _observed(y, 7, 4),
        _nth(y, 9, "Mon", 1),
        _nth(y, 11, "Thu", 4),
        _observed(y, 12, 25),
    ]
    if calendar_id == "US-FED":
        rules += [_nth(y, 10, "Mon", 2), _observed(y, 11, 11)]
    if calendar_id == "US-NYSE":
        rules.append(F.date_sub(easter("year"), 2))
    years = spark.range(FIRST_YEAR, LAST_YEAR + 1).select(F.col("id").cast("int").alias("year"))
    days = years.select(F.explode(F.array(*rules)).alias("holiday"))
    return days.filter("holiday IS NOT NULL").distinct()


_BUILT: dict[tuple, str] = {}


def calendar(
    spark: SparkSession,
    calendar_id: str = "US",
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
) -> DataFrame:
    """Columns ``calendar_date, is_open, open_number`` (open days up to and including the date).

    Written to the shared folder on first use: a calendar is joined several times in one query.
    """
    ident = (spark.sparkContext.applicationId, calendar_id, first_year, last_year)
    if ident not in _BUILT:
        path = scratch_path(spark, f"calendar-{calendar_id}")
        build_calendar(spark, calendar_id, first_year, last_year).coalesce(1).write.parquet(path)
        _BUILT[ident] = path
    schema = "calendar_id string, calendar_date date, is_open boolean, open_number long"
    return spark.read.schema(schema).parquet(_BUILT[ident])


def build_calendar(spark: SparkSession, calendar_id: str, first_year: int, last_year: int) -> DataFrame:
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date"))
        ).alias("calendar_date")
    )
    closed = holidays(spark, calendar_id)
    flagged = days.join(F.broadcast(closed), days.calendar_date == closed.holiday, "left").select(
        F.lit(calendar_id).alias("calendar_id"),
        "calendar_date",
        (F.col("holiday").isNull() & ~F.dayofweek("calendar_date").isin(1, 7)).alias("is_open"),
    )
    return running_total(
        flagged,
        ["calendar_id"],
        ["calendar_date"],
        {"open_number": F.col("is_open").cast("long")},
        slice_by=F.year("calendar_date"),
    )


def _month(day: Column) -> Column:
    return F.trunc(day, "month")


def add_business_date(
    df: DataFrame, out: str, token: str, as_of: str, days: DataFrame
) -> DataFrame:
    """Resolve FBOM, LBOM, PBD-n, NBD+n or NBDOM(n) for every row; null where the calendar ends."""
    text = token.strip().upper()
    nth = re.fullmatch(r"NBDOM\((\d+)\)", text)
    head, n = ("NBDOM", int(nth.group(1))) if nth else split_token(text)
    today = days.select(
        F.col("calendar_date").alias("__today"),
        F.col("is_open").alias("__open"),
        F.col("open_number").alias("__number"),
    )
    opened = days.filter("is_open").select(
        F.col("open_number").alias("__target"), F.col("calendar_date").alias(out)
    )
    base = df.withColumn("__asof", F.col(as_of).cast("date"))
    if head in ("FBOM", "LBOM", "NBDOM"):
        need(head == "NBDOM" or n == 0, "OFFSET_NOT_ALLOWED", token)
        months = days.groupBy(_month(F.col("calendar_date")).alias("__month")).agg(
            F.max("open_number").alias("__last"),
            F.sum(F.col("is_open").cast("long")).alias("__count"),
        )
        target = {
            "FBOM": F.col("__last") - F.col("__count") + 1,
            "LBOM": F.col("__last"),
            "NBDOM": F.when(F.lit(n) <= F.col("__count"), F.col("__last") - F.col("__count") + n),
        }[head]
        base = base.join(F.broadcast(months), _month(F.col("__asof")) == F.col("__month"), "left")
    elif head == "PBD":
        base = base.join(F.broadcast(today), F.col("__asof") == F.col("__today"), "left")
        target = F.col("__number") - F.col("__open").cast("long") - max(1, -n) + 1
    elif head == "NBD":
        base = base.join(F.broadcast(today), F.col("__asof") == F.col("__today"), "left")
        target = F.col("__number") + max(1, n)
    else:
        raise ConfigError("UNKNOWN_MNEMONIC", token)
    found = base.withColumn("__wanted", target).join(
        F.broadcast(opened), F.col("__wanted") == F.col("__target"), "left"
    )
    return found.select(*df.columns, out)


def add_business_days_between(df: DataFrame, out: str, start: str, end: str, days: DataFrame) -> DataFrame:
    """Open days in (start, end], whichever of the two comes first."""
    one = days.select(F.col("calendar_date").alias("__d1"), F.col("open_number").alias("__n1"))
    two = days.select(F.col("calendar_date").alias("__d2"), F.col("open_number").alias("__n2"))
    joined = df.join(F.broadcast(one), F.col(start).cast("date") == F.col("__d1"), "left").join(
        F.broadcast(two), F.col(end).cast("date") == F.col("__d2"), "left"
    )
    return joined.withColumn(out, F.abs(F.col("__n2") - F.col("__n1"))).drop("__d1", "__n1", "__d2", "__n2")
