"""Composite data checks: gates, freshness, drift, anomalies, volume, reconciliation, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, need, need_columns
from ..functions.calendar import add_business_days_between, calendar
from ..functions.quantiles import exact_quantiles
from ..functions.sizes import one_row
from .quality import run_suite

# -- gates --------------------------------------------------------------------


def layer_gate(
    df: DataFrame,
    key: str,
    required: Sequence[str] = (),
    *,
    max_null_share: float = 0.0,
    min_rows: int = 0,
    ranges: Sequence[Mapping[str, object]] = (),
) -> DataFrame:
    """Key present and unique, required columns there and filled, volume floor, value ranges."""
    rules: list[dict] = [{"type": "not_null", "column": key}, {"type": "unique", "column": key}]
    for c in required:
        rules.append({"type": "column_exists", "column": c})
        if c in df.columns:
            rules.append({"type": "not_null", "column": c, "mostly": 1.0 - max_null_share})
    if min_rows > 0:
        rules.append({"type": "row_count_between", "min": min_rows})
    for r in ranges:
        rules.append({"type": "between", **{k: v for k, v in r.items() if k != "allow_null"}})
        if not r.get("allow_null", True):
            rules.append({"type": "not_null", "column": r["column"]})
    return run_suite(df, rules)


# -- freshness ----------------------------------------------------------------


def freshness(df: DataFrame, column: str, as_of: datetime | date, max_age_minutes: int) -> DataFrame:
    """Age of the newest row; the limit itself is still fresh, an empty table is not."""
    need_columns(df, [column])
    newest = df.agg(F.max(column).alias("newest"), F.count(F.lit(1)).alias("row_count"))
    now = F.lit(as_of).cast("timestamp")
    age = F.floor((now.cast("long") - F.col("newest").cast("timestamp").cast("long")) / 60)
    return newest.select(
        F.col("newest"), "row_count", age.alias("age_minutes"),
        F.coalesce(age <= max_age_minutes, F.lit(False)).alias("is_fresh"),
    )


def flag_freshness(df: DataFrame, column: str, as_of: datetime, max_lag_minutes: int, flag: str = "is_fresh") -> DataFrame:
    """Per batch row: lag within the limit, inclusive."""
    need_columns(df, [column])
    lag = F.lit(as_of).cast("timestamp").cast("long") - F.col(column).cast("timestamp").cast("long")
    return df.withColumn(flag, F.coalesce(lag <= max_lag_minutes * 60, F.lit(False)))


def freshness_business_days(df: DataFrame, column: str, as_of: date, max_age: int, calendar_id: str = "US-FED") -> DataFrame:
    """Age of the newest date in open days of a calendar against a limit."""
    need_columns(df, [column])
    newest = df.agg(F.max(F.col(column).cast("date")).alias("last_loaded")).withColumn("as_of", F.lit(as_of))
    aged = add_business_days_between(
        newest, "age_business_days", "last_loaded", "as_of", calendar(df.sparkSession, calendar_id)
    )
    reason = F.when(F.col("last_loaded").isNull(), F.lit("empty_table")).when(
        F.col("age_business_days") > max_age, F.lit("stale")
    )
    return aged.withColumns(
        {"reason": reason, "is_fresh": reason.isNull()}
    )


# -- schema drift -------------------------------------------------------------

# Fixed widenings that a reader can absorb.
WIDENINGS = {
    "int": ("bigint", "double", "decimal"),
    "bigint": ("double", "decimal"),
    "float": ("double",),
    "decimal": ("double",),
    "date": ("timestamp", "timestamp_ntz"),
}
DRIFT_SCHEMA = "column_name string, change string, expected string, actual string, severity string"


def widens(old: T.DataType, new: T.DataType) -> bool:
    a, b = old.simpleString().split("(")[0], new.simpleString().split("(")[0]
    return b in WIDENINGS.get(a, ())


def drift_changes(
    actual: T.StructType,
    expected: T.StructType,
    *,
    strict_order: bool = False,
    allow_extra: bool = True,
    ignored: Sequence[str] = (),
    optional: Sequence[str] = (),
) -> list[tuple[str, str, str | None, str | None, str]]:
    skip = {c.lower() for c in ignored}
    have = {f.name: f for f in actual.fields if f.name.lower() not in skip}
    want = {f.name: f for f in expected.fields if f.name.lower() not in skip}
    out: list[tuple[str, str, str | None, str | None, str]] = []
    for name, f in want.items():
        if name not in have:
            severity = "WARN" if name in optional else "FAIL"
            out.append((name, "missing", f.dataType.simpleString(), None, severity))
        elif have[name].dataType != f.dataType:
            severity = "WARN" if widens(f.dataType, have[name].dataType) else "FAIL"
            out.append((name, "type_changed", f.dataType.simpleString(), have[name].dataType.simpleString(), severity))
    for name, f in have.items():
        if name not in want:
            out.append((name, "added", None, f.dataType.simpleString(), "WARN" if allow_extra else "FAIL"))
    shared = [n for n in have if n in want]
    if strict_order and shared != [n for n in want if n in have]:
        for i, (a, b) in enumerate(zip(shared, [n for n in want if n in have], strict=True)):
            if a != b:
                out.append((a, "reordered", b, str(i), "FAIL"))
    return out


def schema_drift(df: DataFrame, expected: T.StructType, **options) -> DataFrame:
    """Report rows for every difference between a frame and its contract."""
    rows = drift_changes(df.schema, expected, **options)
    return df.sparkSession.createDataFrame(rows, DRIFT_SCHEMA)


def adapt_to_contract(df: DataFrame, expected: T.StructType, policy: str = "block", **options) -> DataFrame:
    """``block`` raises on a failing change, ``warn`` passes the frame, ``auto_adapt`` reshapes it."""
    need(policy in ("block", "warn", "auto_adapt"), "INVALID_DRIFT_POLICY", policy)
    changes = drift_changes(df.schema, expected, **options)
    failing = [c for c in changes if c[4] == "FAIL"]
    if policy == "block":
        need(not failing, "SCHEMA_DRIFT", f"breaking changes: {failing}")
    if policy != "auto_adapt":
        return df
    names = set(df.columns)
    return df.select(
        *[(F.col(f.name).try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in expected.fields]
    )


# -- anomalies ----------------------------------------------------------------


def anomaly_zscore(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Per column: mean, population deviation, and rows beyond the threshold.

    Two scans for any number of columns: one for all means, one for all counts.
    """
    need_columns(df, columns)
    moments: dict[str, Column] = {}
    for i, c in enumerate(columns):
        moments[f"m{i}"], moments[f"s{i}"] = F.avg(c), F.stddev_pop(c)
    stats = one_row(df, **moments)
    tests = df.select(
        *[
            (F.abs(F.col(c) - stats[f"m{i}"]) > F.lit(threshold) * stats[f"s{i}"]).alias(f"z{i}")
            for i, c in enumerate(columns)
        ],
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    wide = tests.agg(
        *[x for i in range(len(columns)) for x in (
            F.count(F.when(F.col(f"z{i}"), 1)).alias(f"n{i}"), F.avg(f"c{i}").alias(f"m{i}"), F.stddev_pop(f"c{i}").alias(f"s{i}")
        )]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.round(f"m{i}", 4).alias("mean"), F.round(f"s{i}", 4).alias("stddev"),
            F.col(f"n{i}").alias("anomaly_count"), (F.col(f"n{i}") == 0).alias("passed"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def anomaly_band(
    df: DataFrame,
    day: str,
    value: str,
    today: date,
    *,
    lookback_days: int = 28,
    sigmas: float = 3.0,
    floor: float | None = None,
    ceiling: float | None = None,
) -> DataFrame:
    """Today's mean against mean and deviation of the daily means before; no rows today, no row out."""
    need_columns(df, [day, value])
    d = F.col(day).cast("date")
    window = df.filter(d.between(F.date_sub(F.lit(today), lookback_days), F.lit(today)))
    daily = window.groupBy(d.alias("day")).agg(F.avg(value).alias("daily_mean"))
    is_today = F.col("day") == F.lit(today)
    both = daily.agg(
        F.max(F.when(is_today, F.col("daily_mean"))).alias("today_mean"),
        F.avg(F.when(~is_today, F.col("daily_mean"))).alias("band_mean"),
        F.stddev_samp(F.when(~is_today, F.col("daily_mean"))).alias("band_stddev"),
        F.count(F.when(~is_today, 1)).alias("history_days"),
    ).filter("today_mean IS NOT NULL")
    off = F.abs(F.col("today_mean") - F.col("band_mean")) > sigmas * F.col("band_stddev")
    outside = F.lit(False)
    if floor is not None:
        outside = outside | (F.col("today_mean") < floor)
    if ceiling is not None:
        outside = outside | (F.col("today_mean") > ceiling)
    return both.withColumn("is_anomaly", F.coalesce(off, F.lit(False)) | outside)


def anomaly_spikes(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    metric: str,
    *,
    baseline_events: int,
    factor: float,
    slice_by: Column | None = None,
) -> DataFrame:
    """Events whose metric exceeds ``factor`` times the mean of the preceding n events of the series."""
    need(bool(metric), "MISSING_PRIMARY_METRIC", "spike detection needs a metric")
    from .windows import SLICE, _finish, order_columns, with_halo

    need_columns(df, [*series, time, metric])
    rows, parts = df, list(series)
    if slice_by is not None:
        rows, parts = with_halo(df, series, [time], slice_by, before=baseline_events), [*series, SLICE]
    w = Window.partitionBy(*parts).orderBy(*order_columns([time])).rowsBetween(-baseline_events, -1)
    rows = rows.withColumns(
        {"baseline": F.avg(metric).over(w), "baseline_count": F.count(metric).over(w)}
    )
    if slice_by is not None:
        rows = _finish(rows)
    spike = (F.col("baseline_count") == baseline_events) & (F.col(metric) > factor * F.col("baseline"))
    severity = F.when(F.col(metric) > 2 * factor * F.col("baseline"), F.lit("high")).otherwise(F.lit("medium"))
    return rows.filter(spike).withColumn("severity", severity).drop("baseline_count")


def anomaly_threshold(df: DataFrame, metric: str, threshold: float, severity: str = "high") -> DataFrame:
    """Events above a fixed spike threshold."""
    need(bool(metric), "MISSING_PRIMARY_METRIC", "spike detection needs a metric")
    need_columns(df, [metric])
    return df.filter(F.col(metric) > threshold).withColumns(
        {"severity": F.lit(severity), "metric_name": F.lit(metric), "metric_value": F.col(metric)}
    )


def anomaly_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values outside ``[q1 - k*iqr, q3 + k*iqr]`` per column, with exact quartiles."""
    need_columns(df, columns)
    rows = []
    for c in columns:
        q1, q3 = exact_quantiles(df, c, [0.25, 0.75])
        need(q1 is not None, "EMPTY_COLUMN", c)
        low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        n = F.count(F.when((F.col(c) < low) | (F.col(c) > high), 1))
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(round(q1, 4)).alias("q1"), F.lit(round(q3, 4)).alias("q3"), n.alias("anomaly_count")
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def anomaly_mean_deviation(
    df: DataFrame, run: Column, value: str, *, runs: int = 7, sensitivity_percent: float = 20.0
) -> DataFrame:
    """Per run: mean, mean of the last n run means, and whether it deviates beyond the sensitivity."""
    per_run = df.groupBy(run.alias("run")).agg(F.avg(value).alias("run_mean"))
    return _against_trailing(per_run, "run_mean", runs).withColumn(
        "is_anomaly",
        F.coalesce(F.abs(F.col("run_mean") / F.col("baseline") - 1) * 100 > sensitivity_percent, F.lit(False)),
    )


def _against_trailing(per_run: DataFrame, value: str, runs: int) -> DataFrame:
    """Mean of the ``runs`` runs before each run. The runs are cut by month, never one window."""
    from .windows import SLICE, _finish, with_halo

    keyed = per_run.withColumn("__table", F.lit(1))
    month = F.trunc(F.col("run").cast("date"), "month")
    rows = with_halo(keyed, ["__table"], ["run"], month, before=runs)
    w = Window.partitionBy("__table", SLICE).orderBy("run").rowsBetween(-runs, -1)
    return _finish(rows.withColumn("baseline", F.avg(value).over(w))).drop("__table")


# -- volume, duplicates, references, reconciliation ---------------------------


def volume_check(
    df: DataFrame,
    day: str,
    *,
    metric: str = "row_count",
    key: str | None = None,
    bytes_of: Sequence[str] = (),
    baseline_days: int = 7,
    spike_percent: float = 200.0,
    drop_percent: float = 50.0,
) -> DataFrame:
    """Daily rows, distinct keys or text bytes against the mean of the days before."""
    measures = {
        "row_count": lambda: F.count(F.lit(1)),
        "distinct_keys": lambda: F.count_distinct(F.col(str(key))),
        "byte_size": lambda: F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in bytes_of), F.lit(0))),
    }
    if metric not in measures:
        raise ConfigError("INVALID_METRIC", metric)
    need(metric != "distinct_keys" or bool(key), "MISSING_KEY", "distinct_keys needs a key")
    daily = df.groupBy(F.col(day).cast("date").alias("run")).agg(measures[metric]().alias("volume"))
    compared = _against_trailing(daily, "volume", baseline_days)
    percent = 100.0 * F.col("volume") / F.col("baseline")
    verdict = (
        F.when(F.col("baseline").isNull(), F.lit("no_baseline"))
        .when(percent >= spike_percent, F.lit("spike"))
        .when(percent <= drop_percent, F.lit("drop"))
        .otherwise(F.lit("normal"))
    )
    return compared.select(F.col("run").alias("day"), "volume", "baseline", verdict.alias("verdict"))


def duplicate_share(df: DataFrame, keys: Sequence[str], threshold_percent: float = 1.0) -> DataFrame:
    """Rows beyond the first of each key, as a share of all rows. Groups are counted, then summed."""
    need_columns(df, keys)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")
    )
    percent = F.coalesce(F.try_divide(100.0 * F.col("duplicate_rows"), F.col("row_count")), F.lit(0.0))
    return totals.select("*", F.round(percent, 4).alias("duplicate_percent"), (percent <= threshold_percent).alias("passed"))


class Referential(NamedTuple):
    rows: DataFrame
    report: DataFrame


def referential(
    child: DataFrame,
    parent: DataFrame,
    on: Sequence[tuple[str, str]],
    *,
    nulls_allowed: bool = True,
    action: str = "reject",
    flag: str = "has_parent",
) -> Referential:
    """Child keys missing in the parent: rejected, flagged or only reported.

    Child rows are counted per key first, so a hot key is one row by the time it is joined.
    """
    need(action in ("reject", "flag", "log"), "INVALID_ACTION", action)
    left, right = [a for a, _ in on], [b for _, b in on]
    need_columns(child, left)
    need_columns(parent, right)
    keys = parent.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(right)]).distinct().withColumn("__hit", F.lit(True))
    cond, null_key = F.lit(True), F.lit(False)
    for i, a in enumerate(left):
        cond = cond & (F.col(a) == F.col(f"__k{i}"))
        null_key = null_key | F.col(a).isNull()
    ok = F.col("__hit").isNotNull() | (null_key if nulls_allowed else F.lit(False))
    helpers = ["__hit", *[f"__k{i}" for i in range(len(on))]]
    counts = child.groupBy(*left).agg(F.count(F.lit(1)).alias("n")).join(keys, cond, "left")
    report = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("orphan_rows"),
        F.count(F.when(~ok, 1)).alias("orphan_keys"),
    )
    if action == "log":
        return Referential(child, report)
    joined = child.join(keys, cond, "left")
    if action == "reject":
        return Referential(joined.filter(ok).drop(*helpers), report)
    return Referential(joined.withColumn(flag, ok).drop(*helpers), report)


def reconcile_totals(
    source: DataFrame, target: DataFrame, sums: Mapping[str, tuple[str, str]], tolerance_percent: float = 0.0
) -> DataFrame:
    """Row count and column sums of two tables: ``{name: (source column, target column)}``."""
    def side(df: DataFrame, pick: int) -> Column:
        made = {"row_count": F.count(F.lit(1)).cast("double")}
        made |= {n: F.sum(pair[pick]).cast("double") for n, pair in sums.items()}
        return one_row(df, **made)

    a, b = side(source, 0), side(target, 1)
    rows = F.array(*[
        F.struct(F.lit(n).alias("measure"), a[n].alias("source_value"), b[n].alias("target_value")) for n in ["row_count", *sums]
    ])
    out = source.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
    gap = F.abs(F.col("source_value") - F.col("target_value"))
    percent = F.when(gap == 0, F.lit(0.0)).otherwise(F.try_divide(100.0 * gap, F.abs("source_value")))
    return out.select(
        "measure", F.round("source_value", 4).alias("source_value"), F.round("target_value", 4).alias("target_value"),
        F.coalesce(percent <= tolerance_percent + 1e-9, F.lit(False)).alias("passed"),
    )


def reconcile_rows(
    source: DataFrame, target: DataFrame, keys: Sequence[str], compare: Sequence[str], tolerance: float = 0.0
) -> DataFrame:
    """Full match by key: rows missing on either side and rows whose values differ."""
    a = source.select(*keys, F.struct(*compare).alias("__a"))
    b = target.select(*keys, F.struct(*compare).alias("__b"))
    both = a.join(b, list(keys), "full_outer")
    differing = []
    for c in compare:
        x, y = F.col("__a")[c], F.col("__b")[c]
        if isinstance(source.schema[c].dataType, T.NumericType):
            near = F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
        else:
            near = x.eqNullSafe(y)
        differing.append(F.when(~near, F.lit(c)))
    columns = F.filter(F.array(*differing), lambda v: v.isNotNull())
    kind = (
        F.when(F.col("__a").isNull(), F.lit("missing_in_source"))
        .when(F.col("__b").isNull(), F.lit("missing_in_target"))
        .when(F.size(columns) > 0, F.concat(F.lit("differs:"), F.concat_ws(",", columns)))
        .otherwise(F.lit("match"))
    )
    return both.select(*keys, kind.alias("status"))


# -- scores -------------------------------------------------------------------


def scorecard(reports: DataFrame, weights: Mapping[str, float], method: str = "weighted") -> DataFrame:
    """Combine check results (``expectation``, ``success``): weighted score, pass or fail, or tier."""
    need(method in ("weighted", "pass_fail", "tiered"), "INVALID_METHOD", method)
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("expectation") == name, F.lit(float(w))).otherwise(weight)
    scored = reports.withColumns({"__w": weight, "__ok": F.col("success").cast("double")})
    total = scored.agg(
        F.round(F.try_divide(F.sum(F.col("__w") * F.col("__ok")), F.sum("__w")), 4).alias("score"),
        F.min("__ok").alias("worst"), F.count(F.lit(1)).alias("checks"),
    )
    if method == "weighted":
        verdict = F.when(F.col("score") >= 0.9, "pass").otherwise("fail")
    elif method == "pass_fail":
        verdict = F.when(F.col("worst") == 1, "pass").otherwise("fail")
    else:
        verdict = (
            F.when(F.col("score") >= 0.95, "gold").when(F.col("score") >= 0.8, "silver")
            .when(F.col("score") >= 0.6, "bronze").otherwise("failing")
        )
    return total.select("score", "checks", verdict.alias("verdict"))




