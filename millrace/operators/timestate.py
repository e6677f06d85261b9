"""As-of state per dataset: next instant by grain, guarded advances, window selection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import need, need_columns
from ..functions.dates import period_end, period_start

# Fixed grains and weekday numbers (Monday is 0).
GRAINS = (
    "DAILY", "DAILY_BUSINESS_DAY", "WEEKLY", "BEG_OF_MONTH", "END_OF_MONTH", "BEG_OF_QUARTER",
    "END_OF_QUARTER", "EVERY_N_HOURS", "CONTINUOUS",
)
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def _plus_days(local: Column, days: Column | int) -> Column:
    n = days if isinstance(days, Column) else F.lit(days)
    return local + F.make_dt_interval(n)


def next_local(local: Column, grain: Column, weekdays: Column, hours: Column) -> Column:
    """Next as-of wall-clock time (a timestamp without zone) for any grain, row by row.

    ``weekdays`` is an array of three-letter names; hourly grains add elapsed hours outside.
    """
    day = local.cast("date")
    monday0 = F.weekday(day)
    to_open = F.when(monday0 == 4, 3).when(monday0 == 5, 2).otherwise(1)
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    wanted = F.when(F.size(weekdays) > 0, weekdays).otherwise(F.array(F.lit("MON")))
    steps = F.filter(
        F.sequence(F.lit(1), F.lit(7)),
        lambda s: F.array_contains(wanted, F.element_at(names, ((monday0 + s) % 7 + 1).cast("int"))),
    )
    week_step = F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit(7))
    quarter_end = period_end(day, 3)
    next_quarter_end = period_end(F.add_months(period_start(day, 3), 3), 3)
    midnight = {
        "BEG_OF_MONTH": F.add_months(period_start(day, 1), 1),
        "END_OF_MONTH": F.last_day(F.add_months(period_start(day, 1), 1)),
        "BEG_OF_QUARTER": F.add_months(period_start(day, 3), 3),
        "END_OF_QUARTER": F.when(day == quarter_end, next_quarter_end).otherwise(quarter_end),
    }
    out = F.when(grain == "DAILY_BUSINESS_DAY", _plus_days(local, to_open)).when(
        grain == "WEEKLY", _plus_days(local, week_step)
    )
    for name, d in midnight.items():
        out = out.when(grain == name, d.cast("timestamp_ntz"))
    return out.when(grain.isin("CONTINUOUS", "EVERY_N_HOURS"), local).otherwise(_plus_days(local, 1))


def next_asof(state: DataFrame, out: str = "next_asof") -> DataFrame:
    """State rows ``current_asof timestamp, time_grain, timezone, weekdays array, interval_hours``
    with the next as-of instant, computed in each dataset's own zone."""
    need_columns(state, ["current_asof", "time_grain", "timezone", "weekdays", "interval_hours"])
    grain = F.upper("time_grain")
    local = F.convert_timezone(F.current_timezone(), F.col("timezone"), F.col("current_asof").cast("timestamp_ntz"))
    nxt = next_local(local, grain, F.col("weekdays"), F.col("interval_hours"))
    back = F.convert_timezone(F.col("timezone"), F.current_timezone(), nxt).cast("timestamp")
    hours = F.col("current_asof").cast("timestamp") + F.make_dt_interval(hours=F.coalesce("interval_hours", F.lit(1)))
    value = F.when(grain == "EVERY_N_HOURS", hours).when(grain == "CONTINUOUS", F.col("current_asof")).otherwise(back)
    return state.withColumn(out, value)


class Advance(NamedTuple):
    state: DataFrame
    audit: DataFrame


def advance(state: DataFrame, requests: DataFrame, applied_runs: DataFrame | None = None) -> Advance:
    """Apply advance requests ``dataset, requested_asof, run_id, actor, requested_at``.

    A forward move is accepted, a backward one rejected; a run that is already in the audit log
    is skipped. Per dataset the furthest forward request of the batch becomes the state.
    """
    need_columns(state, ["dataset", "current_asof"])
    need_columns(requests, ["dataset", "requested_asof", "run_id", "actor", "requested_at"])
    fresh = requests
    if applied_runs is not None:
        fresh = requests.join(applied_runs.select("dataset", "run_id").distinct(), ["dataset", "run_id"], "left_anti")
    known = state.select("dataset", F.col("current_asof").alias("previous_period"))
    audit = fresh.join(known, "dataset").select(
        "dataset", "previous_period", F.col("requested_asof").alias("new_period"), "actor", "run_id",
        F.col("requested_at").alias("audit_ts"),
        F.when(F.col("requested_asof") > F.col("previous_period"), F.lit("ACCEPTED")).otherwise(F.lit("REJECTED")).alias("status"),
    )
    furthest = audit.filter("status = 'ACCEPTED'").groupBy("dataset").agg(F.max("new_period").alias("__asof"))
    moved = state.join(furthest, "dataset", "left").withColumn("current_asof", F.coalesce("__asof", "current_asof"))
    return Advance(moved.select(*state.columns), audit)


def select_window(rows: DataFrame, time: str, state: DataFrame, on: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows whose instant lies in the dataset's current local day ``[as-of, as-of + 1 day)``.

    Bounds are local midnights, so a day with a clock change has 23 or 25 hours.
    """
    need_columns(rows, [*on, time])
    need_columns(state, [*on, "current_asof", "timezone"])
    here = F.current_timezone()
    start = F.convert_timezone(F.col("timezone"), here, F.col("current_asof").cast("date").cast("timestamp_ntz"))
    end = F.convert_timezone(F.col("timezone"), here, F.date_add(F.col("current_asof").cast("date"), 1).cast("timestamp_ntz"))
    bounds = state.select(*on, start.cast("timestamp").alias("__from"), end.cast("timestamp").alias("__to"))
    joined = rows.join(bounds, list(on))
    return joined.filter((F.col(time) >= F.col("__from")) & (F.col(time) < F.col("__to"))).drop("__from", "__to")
