"""Expectation suites: one aggregate pass per table, one row flag per row-level rule.

An expectation is a dict ``{"type": ..., ...}``. Four kinds exist:

* row rules: a condition per row; failing rows are counted and can be quarantined exactly,
* table rules: one aggregate (a mean, a row count) compared with bounds,
* set rules: a comparison of distinct values or whole tables, one small frame each,
* schema rules: answered from ``df.schema`` alone.

All row, table and schema rules of a suite share one ``agg``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, need, need_columns
from ..functions.quantiles import exact_quantiles
from ..functions.sizes import BROADCAST_ROWS, broadcast_if_small, one_row

Rule = Mapping[str, object]
RESULT = "expectation string, column_name string, element_count long, unexpected_count long, unexpected_percent double, observed_value double, success boolean"


def _between(value: Column, rule: Rule) -> Column:
    ok = F.lit(True)
    if rule.get("min") is not None:
        ok = ok & (value >= F.lit(rule["min"]))
    if rule.get("max") is not None:
        ok = ok & (value <= F.lit(rule["max"]))
    return ok


# -- row rules: (condition that must hold, whether nulls are checked too) -----------------------


def _row_condition(rule: Rule, stats: Column | None = None) -> tuple[Column, Column]:
    """``(holds, counted)``: rows that are not counted (nulls, mostly) cannot fail."""
    kind = str(rule["type"])
    everything = F.lit(True)
    if kind == "unique_within_row":
        cols = [F.col(c) for c in rule["columns"]]  # type: ignore[union-attr]
        packed = F.array(*cols)
        complete = F.lit(True)
        for c in cols:
            complete = complete & c.isNotNull()
        return F.size(F.array_distinct(packed)) == F.size(packed), complete
    if kind == "pair_greater":
        a, b = F.col(str(rule["column"])), F.col(str(rule["other"]))
        return (a >= b if rule.get("or_equal") else a > b), a.isNotNull() & b.isNotNull()
    if kind == "pair_equal":
        return F.col(str(rule["column"])).eqNullSafe(F.col(str(rule["other"]))), everything
    if kind == "multi_sum_equal":
        total = F.lit(0.0)
        for c in rule["columns"]:  # type: ignore[union-attr]
            total = total + F.col(c)
        return F.abs(total - F.lit(rule["value"])) <= F.lit(rule.get("tolerance", 1e-9)), total.isNotNull()
    if kind == "row_sql":
        return F.expr(str(rule["sql"])), everything
    c = F.col(str(rule["column"]))
    given = c.isNotNull()
    if kind == "not_null":
        return given, everything
    if kind == "all_null":
        return ~given, everything
    if kind == "between":
        return _between(c, rule), given
    if kind == "match_regex":
        return c.rlike(str(rule["regex"])), given
    if kind == "not_match_regex":
        return ~c.rlike(str(rule["regex"])), given
    if kind == "match_regex_list":
        hit = F.lit(False)
        for r in rule["regexes"]:  # type: ignore[union-attr]
            hit = hit | c.rlike(r)
        return hit, given
    if kind == "match_like":
        return c.like(str(rule["pattern"])), given
    if kind == "length_between":
        return _between(F.length(c), rule), given
    if kind == "length_equal":
        return F.length(c) == F.lit(rule["value"]), given
    if kind == "in_set":
        return c.isin(*rule["values"]), given  # type: ignore[misc]
    if kind == "not_in_set":
        return ~c.isin(*rule["values"]), given  # type: ignore[misc]
    if kind == "zscore_below":
        need(stats is not None, "MISSING_STATS", kind)
        z = F.abs((c - stats["mean"]) / F.nullif(stats["stddev"], F.lit(0.0)))  # type: ignore[index]
        return F.coalesce(z < F.lit(rule["threshold"]), F.lit(True)), given
    raise ConfigError("UNKNOWN_EXPECTATION", kind)


ROW_RULES = {
    "not_null", "all_null", "between", "match_regex", "not_match_regex", "match_regex_list", "match_like",
    "length_between", "length_equal", "in_set", "not_in_set", "pair_greater", "pair_equal", "multi_sum_equal",
    "unique_within_row", "zscore_below", "row_sql",
}

# -- table rules --------------------------------------------------------------------------------

TABLE_RULES = {
    "non_null_ratio": lambda r: F.avg(F.col(str(r["column"])).isNotNull().cast("double")),
    "row_count_between": lambda r: F.count(F.lit(1)),
    "row_count_equal": lambda r: F.count(F.lit(1)),
    "distinct_count_between": lambda r: F.count_distinct(F.col(str(r["column"]))),
    "distinct_ratio_between": lambda r: F.try_divide(
        F.count_distinct(F.col(str(r["column"]))), F.count(F.col(str(r["column"])))
    ),
    "max_between": lambda r: F.max(str(r["column"])),
    "min_between": lambda r: F.min(str(r["column"])),
    "mean_between": lambda r: F.avg(str(r["column"])),
    "stdev_between": lambda r: F.stddev_samp(str(r["column"])),
    "sum_between": lambda r: F.sum(str(r["column"])),
}

# -- schema rules -------------------------------------------------------------------------------


def _schema_verdict(df: DataFrame, rule: Rule) -> tuple[bool, float]:
    """Verdict and an observed number (the column count)."""
    kind, names = str(rule["type"]), df.columns
    count = float(len(names))
    if kind == "column_exists":
        return str(rule["column"]) in names, count
    if kind == "columns_ordered":
        return names == list(rule["columns"]), count  # type: ignore[call-overload]
    if kind == "columns_set":
        wanted = set(rule["columns"])  # type: ignore[call-overload]
        exact = bool(rule.get("exact", True))
        return (set(names) == wanted if exact else wanted <= set(names)), count
    if kind == "column_count_equal":
        return len(names) == rule["value"], count
    if kind == "column_count_between":
        low, high = rule.get("min"), rule.get("max")
        return (low is None or len(names) >= low) and (high is None or len(names) <= high), count  # type: ignore[operator]
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}.get(str(rule["column"]))
    if kind == "of_type":
        return found == rule["value"], count
    if kind == "in_type_list":
        return found in rule["values"], count  # type: ignore[operator]
    raise ConfigError("UNKNOWN_EXPECTATION", kind)


SCHEMA_RULES = {
    "column_exists", "columns_ordered", "columns_set", "column_count_equal", "column_count_between", "of_type", "in_type_list",
}


def rule_name(rule: Rule) -> str:
    return str(rule.get("name") or rule["type"])


def rule_column(rule: Rule) -> str:
    if "column" in rule:
        return str(rule["column"])
    return ",".join(rule.get("columns", []))  # type: ignore[arg-type]


def _result(rule: Rule, elements: Column, unexpected: Column, percent: Column, observed: Column, success: Column) -> Column:
    return F.struct(
        F.lit(rule_name(rule)).alias("expectation"),
        F.lit(rule_column(rule)).alias("column_name"),
        elements.cast("long").alias("element_count"),
        unexpected.cast("long").alias("unexpected_count"),
        percent.cast("double").alias("unexpected_percent"),
        observed.cast("double").alias("observed_value"),
        F.coalesce(success, F.lit(False)).alias("success"),
    )


def _row_result(rule: Rule, stats: Column | None = None) -> Column:
    holds, counted = _row_condition(rule, stats)
    total = F.count(F.lit(1))
    checked = F.count(F.when(counted, F.lit(1)))
    # A condition that is null for a counted row has not been met.
    failed = F.count(F.when(counted & ~F.coalesce(holds, F.lit(False)), F.lit(1)))
    share = F.coalesce(F.try_divide(checked - failed, checked), F.lit(1.0))
    percent = F.round(100.0 * F.try_divide(failed, total), 4)
    return _result(rule, total, failed, percent, F.lit(None), share >= F.lit(rule.get("mostly", 1.0)))


def _table_result(rule: Rule) -> Column:
    observed = TABLE_RULES[str(rule["type"])](rule)
    ok = observed == F.lit(rule["value"]) if "value" in rule else _between(observed, rule)
    return _result(rule, F.count(F.lit(1)), F.lit(0), F.lit(0.0), F.round(observed.cast("double"), 4), ok)


def _mode_frame(df: DataFrame, rule: Rule) -> DataFrame:
    c = str(rule["column"])
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    # Most frequent value; the smaller one on a tie.
    top = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias("mode"))
    return top.select(
        _result(rule, F.col("total"), F.lit(0), F.lit(0.0), F.col("most"), F.col("mode").isin(*rule["values"])).alias("r")  # type: ignore[misc]
    ).select("r.*")


def _set_frame(df: DataFrame, rule: Rule) -> DataFrame:
    """Distinct values against a given set, from one distinct and one aggregate."""
    c, kind = str(rule["column"]), str(rule["type"])
    values = list(rule["values"])  # type: ignore[call-overload]
    distinct = df.select(F.col(c).alias("v")).filter("v IS NOT NULL").distinct()
    inside = F.col("v").isin(*values)
    agg = distinct.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~inside, 1)).alias("outside"),
        F.count(F.when(inside, 1)).alias("found"),
    )
    missing = F.lit(len(set(values))) - F.col("found")
    unexpected = {
        "distinct_equal_set": F.col("outside") + missing,
        "distinct_contain_set": missing,
        "distinct_in_set": F.col("outside"),
    }[kind]
    return agg.select(
        _result(rule, F.col("n"), unexpected, F.lit(0.0), F.col("n"), unexpected == 0).alias("r")
    ).select("r.*")


def _unique_frame(df: DataFrame, rule: Rule) -> DataFrame:
    """Rows in groups of equal values are unexpected; rows with nulls in the key are ignored."""
    cols = [str(rule["column"])] if "column" in rule else list(rule["columns"])  # type: ignore[call-overload]
    need_columns(df, cols)
    groups = df.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]).agg(F.count(F.lit(1)).alias("n"))
    complete = F.lit(True)
    for i in range(len(cols)):
        complete = complete & F.col(f"k{i}").isNotNull()
    agg = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(complete, F.col("n"))), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(complete & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("bad"),
    )
    share = F.coalesce(F.try_divide(F.col("checked") - F.col("bad"), F.col("checked")), F.lit(1.0))
    percent = F.round(100.0 * F.try_divide(F.col("bad"), F.col("total")), 4)
    return agg.select(
        _result(rule, F.col("total"), F.col("bad"), percent, F.lit(None), share >= F.lit(rule.get("mostly", 1.0))).alias("r")
    ).select("r.*")


def _large_set_frame(df: DataFrame, rule: Rule) -> DataFrame:
    """Membership in a set given as a frame: values are counted first, then joined."""
    c, frame = str(rule["column"]), rule["frame"]
    counts = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    members = frame.select(F.col(frame.columns[0]).alias("v"), F.lit(True).alias("hit")).distinct()  # type: ignore[attr-defined]
    joined = counts.join(broadcast_if_small(members, int(rule.get("max_broadcast", BROADCAST_ROWS))), "v", "left")  # type: ignore[call-overload]
    hit = F.coalesce("hit", F.lit(False))
    ok = hit if rule["type"] == "in_set" else ~hit
    given = F.col("v").isNotNull()
    agg = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(given, F.col("n"))), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(given & ~ok, F.col("n"))), F.lit(0)).alias("bad"),
    )
    share = F.coalesce(F.try_divide(F.col("checked") - F.col("bad"), F.col("checked")), F.lit(1.0))
    percent = F.round(100.0 * F.try_divide(F.col("bad"), F.col("total")), 4)
    return agg.select(
        _result(rule, F.col("total"), F.col("bad"), percent, F.lit(None), share >= F.lit(rule.get("mostly", 1.0))).alias("r")
    ).select("r.*")


def _median_frame(df: DataFrame, rule: Rule) -> DataFrame:
    median = exact_quantiles(df, str(rule["column"]), [0.5])[0]
    observed = F.lit(median).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        _result(rule, F.col("n"), F.lit(0), F.lit(0.0), F.round(observed, 4), _between(observed, rule)).alias("r")
    ).select("r.*")


def _row_count_other(df: DataFrame, rule: Rule) -> DataFrame:
    other = rule["other"].agg(F.count(F.lit(1)).alias("n")).scalar()  # type: ignore[attr-defined]
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        _result(rule, F.col("n"), F.abs(F.col("n") - other), F.lit(0.0), other, F.col("n") == other).alias("r")
    ).select("r.*")


def _custom_sql(df: DataFrame, rule: Rule) -> DataFrame:
    from .sets import sql_chain

    failing = sql_chain(df, [("failing", str(rule["sql"]))])
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return failing.agg(F.count(F.lit(1)).alias("bad")).select(
        _result(rule, total, F.col("bad"), F.round(100.0 * F.try_divide(F.col("bad"), total), 4), F.lit(None), F.col("bad") == 0).alias("r")
    ).select("r.*")


def _cross_source(df: DataFrame, rule: Rule) -> DataFrame:
    """Rows of either result missing in the other, as multisets: equal rows are counted, not compared."""
    from .sets import sql_chain

    here = sql_chain(df, [("q", str(rule["sql"]))]) if rule.get("sql") else df
    there = rule["other"]
    cols = here.columns
    tagged = here.withColumn("__s", F.lit(1)).unionByName(there.select(*cols).withColumn("__s", F.lit(-1)))  # type: ignore[attr-defined]
    balance = tagged.groupBy(*cols).agg(
        F.sum("__s").alias("__gap"), F.count(F.when(F.col("__s") == 1, 1)).alias("__here")
    )
    agg = balance.agg(
        F.coalesce(F.sum("__here"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.abs("__gap")), F.lit(0)).alias("bad")
    )
    percent = F.round(100.0 * F.try_divide(F.col("bad"), F.col("total")), 4)
    return agg.select(
        _result(rule, F.col("total"), F.col("bad"), percent, F.lit(None), F.col("bad") == 0).alias("r")
    ).select("r.*")


FRAME_RULES = {
    "unique": _unique_frame,
    "compound_unique": _unique_frame,
    "mode_in_set": _mode_frame,
    "distinct_equal_set": _set_frame,
    "distinct_contain_set": _set_frame,
    "distinct_in_set": _set_frame,
    "median_between": _median_frame,
    "row_count_other_table": _row_count_other,
    "custom_sql": _custom_sql,
    "cross_source": _cross_source,
}


def zscore_stats(df: DataFrame, column: str, population: bool = False) -> Column:
    spread = F.stddev_pop(column) if population else F.stddev_samp(column)
    return one_row(df, mean=F.avg(column), stddev=spread)


def run_suite(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One result row per expectation."""
    need(bool(rules), "EMPTY_SUITE", "a suite needs expectations")
    shared, frames = [], []
    for rule in rules:
        kind = str(rule["type"])
        if "frame" in rule and kind in ("in_set", "not_in_set"):
            frames.append(_large_set_frame(df, rule))
        elif kind in FRAME_RULES:
            frames.append(FRAME_RULES[kind](df, rule))
        elif kind == "zscore_below":
            need_columns(df, [str(rule["column"])])
            shared.append(_row_result(rule, zscore_stats(df, str(rule["column"]))))
        elif kind in ROW_RULES:
            shared.append(_row_result(rule))
        elif kind in TABLE_RULES:
            shared.append(_table_result(rule))
        elif kind in SCHEMA_RULES:
            ok, observed = _schema_verdict(df, rule)
            shared.append(_result(rule, F.count(F.lit(1)), F.lit(0), F.lit(0.0), F.lit(observed), F.lit(ok)))
        else:
            raise ConfigError("UNKNOWN_EXPECTATION", kind)
    if shared:
        one_pass = df.agg(F.array(*shared).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
        frames.insert(0, one_pass)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Validation(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    report: DataFrame


def flag_rows(df: DataFrame, rules: Sequence[Rule], column: str = "failed_rules") -> DataFrame:
    """Names of the row rules each row breaks."""
    marks = []
    for rule in rules:
        stats = zscore_stats(df, str(rule["column"])) if rule["type"] == "zscore_below" else None
        holds, counted = _row_condition(rule, stats)
        marks.append(F.when(counted & ~F.coalesce(holds, F.lit(False)), F.lit(rule_name(rule))))
    if not marks:
        return df.withColumn(column, F.array().cast("array<string>"))
    return df.withColumn(column, F.filter(F.array(*marks), lambda x: x.isNotNull()))


def validate(
    df: DataFrame, rules: Sequence[Rule], *, on_failure: str = "quarantine", threshold_percent: float = 0.0
) -> Validation:
    """Split rows by the row rules and report the whole suite.

    ``block`` raises when more than ``threshold_percent`` of the rows fail, ``warn`` accepts every
    row, ``quarantine`` accepts the rows that pass.
    """
    need(on_failure in ("block", "warn", "quarantine"), "INVALID_ON_FAILURE", on_failure)
    row_rules = [r for r in rules if r["type"] in ROW_RULES and "frame" not in r]
    flagged = flag_rows(df, row_rules)
    bad = F.size("failed_rules") > 0
    report = run_suite(df, rules)
    accepted = flagged if on_failure == "warn" else flagged.filter(~bad)
    rejected = flagged.filter(bad)
    if on_failure == "block":
        stats = flagged.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad")).first()
        share = 100.0 * stats["bad"] / stats["n"] if stats["n"] else 0.0
        need(share <= threshold_percent, "VALIDATION_BLOCKED", f"{share:.4f}% of the rows fail")
    return Validation(accepted.drop("failed_rules"), rejected, report)
