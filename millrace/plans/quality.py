"""Expectation and data-check queries."""

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks, profiling, quality
from .registry import query


def _head(name: str, column: str) -> str:
    return f"SELECT '{name}' AS expectation, '{column}' AS column_name, CAST(count(*) AS BIGINT) AS element_count"


def row_oracle(name, table, column, counted, holds, mostly=1.0):
    bad = f"count(*) FILTER (({counted}) AND NOT coalesce({holds}, false))"
    seen = f"count(*) FILTER ({counted})"
    return (
        f"{_head(name, column)}, CAST({bad} AS BIGINT) AS unexpected_count, round(100.0 * {bad} / count(*), 4) AS unexpected_percent, "
        f"CAST(NULL AS DOUBLE) AS observed_value, CASE WHEN {seen} = 0 THEN true ELSE ({seen} - {bad})::DOUBLE / {seen} >= {mostly} END AS success FROM {table}"
    )


def table_oracle(name, table, column, observed, success):
    return (
        f"{_head(name, column)}, CAST(0 AS BIGINT) AS unexpected_count, CAST(0 AS DOUBLE) AS unexpected_percent, "
        f"round(CAST({observed} AS DOUBLE), 4) AS observed_value, {success} AS success FROM {table}"
    )


ORDERS = "(SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS state FROM orders)"


def orders(t):
    return t.orders.withColumn("state", F.expr("nullif(o_orderstatus, 'P')"))


def row_rule(key, rule, counted, holds, table=ORDERS, frame=orders, column=None):
    kind = rule["type"]
    shown = column if column is not None else rule.get("column", ",".join(rule.get("columns", [])))

    @query(key, row_oracle(kind, table, shown, counted, holds, rule.get("mostly", 1.0)))
    def _(t):
        return quality.run_suite(frame(t), [rule])


row_rule("dq_not_null", {"type": "not_null", "column": "state", "mostly": 0.6}, "true", "state IS NOT NULL")
row_rule("dq_all_null", {"type": "all_null", "column": "state", "mostly": 0.5}, "true", "state IS NULL")
row_rule("dq_between", {"type": "between", "column": "o_totalprice", "min": 1000, "max": 450000, "mostly": 0.9}, "o_totalprice IS NOT NULL", "o_totalprice BETWEEN 1000 AND 450000")
row_rule("dq_match_regex", {"type": "match_regex", "column": "o_orderpriority", "regex": "^[1-5]-[A-Z]+$"}, "true", "regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$')")
row_rule("dq_not_match_regex", {"type": "not_match_regex", "column": "o_orderpriority", "regex": "SPEC", "mostly": 0.7}, "true", "NOT regexp_matches(o_orderpriority, 'SPEC')")
row_rule("dq_match_regex_list", {"type": "match_regex_list", "column": "o_orderpriority", "regexes": ["^1", "LOW$"], "mostly": 0.3}, "true", "regexp_matches(o_orderpriority, '^1') OR regexp_matches(o_orderpriority, 'LOW$')")
row_rule("dq_match_like", {"type": "match_like", "column": "o_orderpriority", "pattern": "%-%"}, "true", "o_orderpriority LIKE '%-%'")
row_rule("dq_length_between", {"type": "length_between", "column": "o_orderpriority", "min": 5, "max": 10, "mostly": 0.75}, "true", "length(o_orderpriority) BETWEEN 5 AND 10")
row_rule("dq_length_equal", {"type": "length_equal", "column": "state", "value": 1}, "state IS NOT NULL", "length(state) = 1")
row_rule("dq_in_set", {"type": "in_set", "column": "state", "values": ["F", "O"]}, "state IS NOT NULL", "state IN ('F', 'O')")
row_rule("dq_not_in_set", {"type": "not_in_set", "column": "state", "values": ["F"], "mostly": 0.4}, "state IS NOT NULL", "state NOT IN ('F')")
LINES = "lineitem"


def lines(t):
    return t.lineitem


row_rule("dq_pair_greater", {"type": "pair_greater", "column": "l_extendedprice", "other": "l_quantity", "mostly": 0.99}, "true", "l_extendedprice > l_quantity", LINES, lines)
row_rule("dq_pair_equal", {"type": "pair_equal", "column": "l_discount", "other": "l_tax", "mostly": 0.05}, "true", "l_discount IS NOT DISTINCT FROM l_tax", LINES, lines)
row_rule("dq_multi_sum_equal", {"type": "multi_sum_equal", "columns": ["l_discount", "l_tax"], "value": 0.1, "mostly": 0.5}, "true", "abs(l_discount + l_tax - 0.1) <= 1e-9", LINES, lines)
row_rule("dq_unique_within_row", {"type": "unique_within_row", "columns": ["l_partkey", "l_suppkey", "l_orderkey"], "mostly": 0.9}, "true", "l_partkey <> l_suppkey AND l_suppkey <> l_orderkey AND l_partkey <> l_orderkey", LINES, lines)
row_rule(
    "dq_zscore_below", {"type": "zscore_below", "column": "value", "threshold": 3.0, "mostly": 0.95}, "true",
    "abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)) < 3.0", "events", lambda t: t.events,
)


def table_rule(key, rule, observed, success, table=ORDERS, frame=orders):
    @query(key, table_oracle(rule["type"], table, rule.get("column", ""), observed, success))
    def _(t):
        return quality.run_suite(frame(t), [rule])


table_rule("dq_non_null_ratio", {"type": "non_null_ratio", "column": "state", "min": 0.5, "max": 0.8}, "avg(CASE WHEN state IS NULL THEN 0.0 ELSE 1.0 END)", "avg(CASE WHEN state IS NULL THEN 0.0 ELSE 1.0 END) BETWEEN 0.5 AND 0.8")
table_rule("dq_row_count_between", {"type": "row_count_between", "min": 10, "max": 2000}, "count(*)", "count(*) BETWEEN 10 AND 2000")
table_rule("dq_row_count_equal", {"type": "row_count_equal", "value": 15000}, "count(*)", "count(*) = 15000")
table_rule("dq_distinct_count_between", {"type": "distinct_count_between", "column": "o_custkey", "min": 5}, "count(DISTINCT o_custkey)", "count(DISTINCT o_custkey) >= 5")
table_rule("dq_distinct_ratio_between", {"type": "distinct_ratio_between", "column": "o_custkey", "min": 0.01, "max": 0.2}, "count(DISTINCT o_custkey)::DOUBLE / count(o_custkey)", "count(DISTINCT o_custkey)::DOUBLE / count(o_custkey) BETWEEN 0.01 AND 0.2")
table_rule("dq_max_between", {"type": "max_between", "column": "o_totalprice", "min": 100, "max": 1e7}, "max(o_totalprice)", "max(o_totalprice) BETWEEN 100 AND 1e7")
table_rule("dq_min_between", {"type": "min_between", "column": "o_totalprice", "min": 0, "max": 10}, "min(o_totalprice)", "min(o_totalprice) BETWEEN 0 AND 10")
table_rule("dq_mean_between", {"type": "mean_between", "column": "o_totalprice", "min": 200000, "max": 300000}, "avg(o_totalprice)", "avg(o_totalprice) BETWEEN 200000 AND 300000")
table_rule("dq_stdev_between", {"type": "stdev_between", "column": "o_totalprice", "min": 0, "max": 1000}, "stddev_samp(o_totalprice)", "stddev_samp(o_totalprice) BETWEEN 0 AND 1000")
table_rule("dq_sum_between", {"type": "sum_between", "column": "l_quantity", "min": 1}, "sum(l_quantity)", "sum(l_quantity) >= 1", LINES, lines)
table_rule("dq_median_between", {"type": "median_between", "column": "o_totalprice", "min": 200000, "max": 300000}, "median(o_totalprice)", "median(o_totalprice) BETWEEN 200000 AND 300000")


def schema_rule(key, rule, success):
    """``success`` is SQL over ``names`` (list) and ``types`` (map) of the described table."""
    asked = rule.get("column", ",".join(rule.get("columns", [])))
    sql = f"""WITH d AS (SELECT list(column_name) AS names, map(list(column_name), list(column_type)) AS types FROM (DESCRIBE SELECT * FROM {ORDERS}))
      SELECT '{rule["type"]}' AS expectation, '{asked}' AS column_name, (SELECT count(*) FROM orders) AS element_count, CAST(0 AS BIGINT) AS unexpected_count,
             CAST(0 AS DOUBLE) AS unexpected_percent, CAST(len(names) AS DOUBLE) AS observed_value, {success} AS success FROM d"""

    @query(key, sql)
    def _(t):
        return quality.run_suite(orders(t), [rule])


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "state"]
schema_rule("dq_column_exists", {"type": "column_exists", "column": "o_custkey"}, "list_contains(names, 'o_custkey')")
schema_rule("dq_columns_ordered", {"type": "columns_ordered", "columns": ORDER_COLUMNS}, f"names = {ORDER_COLUMNS}")
schema_rule("dq_columns_set", {"type": "columns_set", "columns": ["state", "o_orderkey"]}, "list_sort(names) = ['o_orderkey', 'state']")
schema_rule("dq_column_count_equal", {"type": "column_count_equal", "value": 6}, "len(names) = 6")
schema_rule("dq_column_count_between", {"type": "column_count_between", "min": 3, "max": 9}, "len(names) BETWEEN 3 AND 9")
schema_rule("dq_of_type", {"type": "of_type", "column": "o_totalprice", "value": "double"}, "types['o_totalprice'] = 'DOUBLE'")
schema_rule("dq_in_type_list", {"type": "in_type_list", "column": "o_custkey", "values": ["int", "string"]}, "types['o_custkey'] IN ('INTEGER', 'VARCHAR')")


def unique_oracle(name, column, keys, table, mostly):
    return f"""WITH g AS (SELECT count(*) AS n FROM {table} GROUP BY {keys})
      SELECT '{name}' AS expectation, '{column}' AS column_name, CAST(sum(n) AS BIGINT) AS element_count, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS unexpected_count,
             round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 4) AS unexpected_percent, CAST(NULL AS DOUBLE) AS observed_value,
             1 - coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n) >= {mostly} AS success FROM g"""


@query("dq_unique", unique_oracle("unique", "o_orderkey", "o_orderkey", "orders", 1.0))
def _(t):
    return quality.run_suite(t.orders, [{"type": "unique", "column": "o_orderkey"}])


@query("dq_compound_unique", unique_oracle("compound_unique", "l_orderkey,l_linenumber", "l_orderkey, l_linenumber", "lineitem", 0.3))
def _(t):
    return quality.run_suite(t.lineitem, [{"type": "compound_unique", "columns": ["l_orderkey", "l_linenumber"], "mostly": 0.3}])


def set_oracle(name, unexpected):
    return f"""WITH d AS (SELECT DISTINCT o_orderpriority AS v FROM orders)
      SELECT '{name}' AS expectation, 'o_orderpriority' AS column_name, count(*) AS element_count, CAST({unexpected} AS BIGINT) AS unexpected_count, CAST(0 AS DOUBLE) AS unexpected_percent,
             CAST(count(*) AS DOUBLE) AS observed_value, {unexpected} = 0 AS success FROM d"""


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "9-NONE"]
IN_LIST = "v IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', '9-NONE')"
for _kind, _bad in {
    "distinct_equal_set": f"(count(*) FILTER (NOT {IN_LIST}) + 5 - count(*) FILTER ({IN_LIST}))",
    "distinct_contain_set": f"(5 - count(*) FILTER ({IN_LIST}))",
    "distinct_in_set": f"count(*) FILTER (NOT {IN_LIST})",
}.items():

    @query(f"dq_{_kind}", set_oracle(_kind, _bad))
    def _(t, kind=_kind):
        return quality.run_suite(t.orders, [{"type": kind, "column": "o_orderpriority", "values": PRIORITIES}])


@query(
    "dq_in_set_large",
    """SELECT 'in_set' AS expectation, 'l_partkey' AS column_name, count(*) AS element_count, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS unexpected_count,
              round(100.0 * count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) / count(*), 4) AS unexpected_percent, CAST(NULL AS DOUBLE) AS observed_value, true AS success FROM lineitem""",
)
def _(t):
    members = t.part.filter("p_size > 10").select("p_partkey")
    return quality.run_suite(t.lineitem, [{"type": "in_set", "column": "l_partkey", "frame": members, "mostly": 0.7}])


@query(
    "dq_mode_in_set",
    """WITH c AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1), m AS (SELECT v, n FROM c ORDER BY n DESC, v LIMIT 1)
       SELECT 'mode_in_set' AS expectation, 'event_type' AS column_name, CAST((SELECT sum(n) FROM c) AS BIGINT) AS element_count, CAST(0 AS BIGINT) AS unexpected_count, CAST(0 AS DOUBLE) AS unexpected_percent,
              CAST(n AS DOUBLE) AS observed_value, v IN ('view', 'click') AS success FROM m""",
)
def _(t):
    return quality.run_suite(t.events, [{"type": "mode_in_set", "column": "event_type", "values": ["view", "click"]}])


@query(
    "dq_row_count_other_table",
    """SELECT 'row_count_other_table' AS expectation, '' AS column_name, count(*) AS element_count, abs(count(*) - (SELECT count(*) FROM orders)) AS unexpected_count, CAST(0 AS DOUBLE) AS unexpected_percent,
              CAST((SELECT count(*) FROM orders) AS DOUBLE) AS observed_value, count(*) = (SELECT count(*) FROM orders) AS success FROM customer""",
)
def _(t):
    return quality.run_suite(t.customer, [{"type": "row_count_other_table", "other": t.orders}])


@query(
    "dq_custom_sql",
    """SELECT 'custom_sql' AS expectation, '' AS column_name, (SELECT count(*) FROM orders) AS element_count, count(*) AS unexpected_count, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS unexpected_percent,
              CAST(NULL AS DOUBLE) AS observed_value, count(*) = 0 AS success FROM orders WHERE o_totalprice < 2000""",
)
def _(t):
    return quality.run_suite(t.orders, [{"type": "custom_sql", "sql": "SELECT * FROM input WHERE o_totalprice < 2000"}])


@query(
    "dq_cross_source",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 20000 GROUP BY 1),
       u AS (SELECT k, n, count(*) FILTER (s = 1) AS x, sum(s) AS d FROM (SELECT k, n, 1 AS s FROM a UNION ALL SELECT k, n, -1 FROM b) GROUP BY 1, 2)
       SELECT 'cross_source' AS expectation, '' AS column_name, CAST(sum(x) AS BIGINT) AS element_count, CAST(sum(abs(d)) AS BIGINT) AS unexpected_count, round(100.0 * sum(abs(d)) / sum(x), 4) AS unexpected_percent,
              CAST(NULL AS DOUBLE) AS observed_value, sum(abs(d)) = 0 AS success FROM u""",
)
def _(t):
    other = t.orders.filter("o_totalprice > 20000").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rule = {"type": "cross_source", "sql": "SELECT o_custkey AS k, count(*) AS n FROM input GROUP BY o_custkey", "other": other}
    return quality.run_suite(t.orders, [rule])


# -- dqc_* --------------------------------------------------------------------

CLAIM_RULES = [
    {"type": "not_null", "name": "status_given", "column": "state"},
    {"type": "between", "name": "price_floor", "column": "o_totalprice", "min": 5000},
    {"type": "in_set", "name": "known_priority", "column": "o_orderpriority", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]},
]


@query(
    "dqc_validate",
    f"""SELECT o_orderkey, concat_ws(',', CASE WHEN state IS NULL THEN 'status_given' END, CASE WHEN o_totalprice < 5000 THEN 'price_floor' END,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'known_priority' END) AS failed FROM {ORDERS}""",
)
def _(t):
    v = quality.validate(orders(t), CLAIM_RULES)
    good = v.accepted.select("o_orderkey", F.lit("").alias("failed"))
    return good.unionByName(v.rejected.select("o_orderkey", F.concat_ws(",", "failed_rules").alias("failed")))


@query(
    "dqc_validate_report",
    " UNION ALL ".join([
        row_oracle("status_given", ORDERS, "state", "true", "state IS NOT NULL"),
        row_oracle("price_floor", ORDERS, "o_totalprice", "true", "o_totalprice >= 5000"),
        row_oracle("known_priority", ORDERS, "o_orderpriority", "true", "o_orderpriority <> '4-NOT SPECIFIED'"),
    ]),
)
def _(t):
    return quality.validate(orders(t), CLAIM_RULES).report


@query(
    "dqc_report_append",
    f"SELECT 'run-1' AS run_id, 'not_null' AS expectation, count(*) FILTER (state IS NULL) AS unexpected_count FROM {ORDERS} UNION ALL SELECT 'run-2', 'not_null', 0 FROM orders HAVING count(*) > 0",
)
def _(t):
    from ..session import scratch_path
    from ..sinks.tables import append_report

    path = scratch_path(t.spark, "reports")
    rule = [{"type": "not_null", "column": "state"}]
    append_report(quality.run_suite(orders(t), rule), path, "run-1", date(2024, 1, 1))
    append_report(quality.run_suite(orders(t).fillna("P", ["state"]), rule), path, "run-2", date(2024, 1, 2))
    return t.spark.read.parquet(path).select("run_id", "expectation", "unexpected_count")


@query(
    "dqc_gate",
    " UNION ALL ".join([
        "SELECT 'not_null' AS expectation, 'o_orderkey' AS column_name, true AS success",
        "SELECT 'unique', 'o_orderkey', (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders)",
        "SELECT 'column_exists', 'state', true", f"SELECT 'not_null', 'state', (SELECT avg(CASE WHEN state IS NULL THEN 0.0 ELSE 1.0 END) >= 0.6 FROM {ORDERS})",
        "SELECT 'column_exists', 'missing_one', false", "SELECT 'row_count_between', '', (SELECT count(*) >= 100 FROM orders)",
        "SELECT 'between', 'o_totalprice', (SELECT count(*) = 0 FROM orders WHERE o_totalprice < 0)",
    ]),
)
def _(t):
    gate = checks.layer_gate(
        orders(t), "o_orderkey", ["state", "missing_one"], max_null_share=0.4, min_rows=100, ranges=[{"column": "o_totalprice", "min": 0}]
    )
    return gate.select("expectation", "column_name", "success")


@query(
    "dqc_freshness",
    """SELECT event_type AS feed, max(ts) AS newest, count(*) AS row_count, CAST(floor(date_diff('second', max(ts), TIMESTAMP '2024-01-31') / 60) AS BIGINT) AS age_minutes,
              floor(date_diff('second', max(ts), TIMESTAMP '2024-01-31') / 60) <= 1500 AS is_fresh FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) GROUP BY 1""",
)
def _(t):
    out = None
    events = t.events.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    for kind in ("click", "error", "purchase", "signup", "view"):
        one = checks.freshness(events.filter(F.col("event_type") == kind), "ts", datetime(2024, 1, 31), 1500).withColumn("feed", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dqc_freshness_rows",
    "SELECT event_id, date_trunc('second', ts) >= TIMESTAMP '2024-01-31' - INTERVAL 2880 MINUTE AS is_fresh FROM events",
)
def _(t):
    events = t.events.select("event_id", F.date_trunc("second", "ts").alias("ts"))
    return checks.flag_freshness(events, "ts", datetime(2024, 1, 31), 2880).drop("ts")


# Open days between 2024-01-13 and 2024-02-09 on the federal calendar leave out one Monday holiday.
@query(
    "dqc_freshness_bd",
    """SELECT max(CAST(ts AS DATE)) AS last_loaded, DATE '2024-02-09' AS as_of,
              (SELECT count(*) FROM range(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY) r(d) WHERE CAST(d AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) AND dayofweek(d) NOT IN (0, 6)
                 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15')) AS age_business_days, 'stale' AS reason, false AS is_fresh FROM events""",
)
def _(t):
    return checks.freshness_business_days(t.events, "ts", date(2024, 2, 9), 3)


EXPECTED = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.IntegerType()), T.StructField("o_totalprice", T.StringType()),
    T.StructField("o_orderdate", T.DateType()), T.StructField("o_clerk", T.StringType()), T.StructField("o_comment", T.StringType()),
])


@query(
    "dqc_drift",
    """WITH have AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM orders)),
       want(column_name, column_type, needed) AS (VALUES ('o_orderkey', 'BIGINT', true), ('o_custkey', 'INTEGER', true), ('o_totalprice', 'VARCHAR', true),
         ('o_orderdate', 'DATE', true), ('o_clerk', 'VARCHAR', true), ('o_comment', 'VARCHAR', false)),
       d AS (SELECT coalesce(h.column_name, w.column_name) AS column_name, needed, w.column_type AS wanted,
                    CASE WHEN h.column_name IS NULL THEN 'missing' WHEN w.column_name IS NULL THEN 'added' WHEN h.column_type <> w.column_type THEN 'type_changed' END AS change
             FROM have h FULL JOIN want w ON h.column_name = w.column_name)
       SELECT column_name, change, CASE WHEN change = 'missing' AND needed OR change = 'type_changed' AND wanted = 'VARCHAR' THEN 'FAIL' ELSE 'WARN' END AS severity,
              (SELECT count(*) FROM orders) AS checked_rows FROM d WHERE change IS NOT NULL""",
)
def _(t):
    report = checks.schema_drift(t.orders, EXPECTED, optional=["o_comment"])
    n = t.orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return report.select("column_name", "change", "severity", n.alias("checked_rows"))


@query(
    "dqc_drift_adapt",
    """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_clerk FROM orders""",
)
def _(t):
    return checks.adapt_to_contract(t.orders, EXPECTED, "auto_adapt").drop("o_totalprice", "o_comment")


def _z_sql(c: str, table: str) -> str:
    bad = f"count(*) FILTER (abs({c} - m) > 3 * s)"
    return f"SELECT '{c}' AS column_name, round(any_value(m), 4) AS mean, round(any_value(s), 4) AS stddev, {bad} AS anomaly_count, {bad} = 0 AS passed FROM {table}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {table})"


@query("dqc_anomaly_z", _z_sql("value", "events") + " UNION ALL " + _z_sql("user_id", "events"))
def _(t):
    return checks.anomaly_zscore(t.events, ["value", "user_id"])


@query(
    "dqc_anomaly_band",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS m FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-06' AND DATE '2024-01-20' GROUP BY 1)
       SELECT round(max(m) FILTER (day = DATE '2024-01-20'), 4) AS today_mean, round(avg(m) FILTER (day < DATE '2024-01-20'), 4) AS band_mean, round(stddev_samp(m) FILTER (day < DATE '2024-01-20'), 4) AS band_stddev,
              count(*) FILTER (day < DATE '2024-01-20') AS history_days,
              abs(max(m) FILTER (day = DATE '2024-01-20') - avg(m) FILTER (day < DATE '2024-01-20')) > 3 * stddev_samp(m) FILTER (day < DATE '2024-01-20') OR max(m) FILTER (day = DATE '2024-01-20') > 60 AS is_anomaly FROM d""",
)
def _(t):
    out = checks.anomaly_band(t.events, "ts", "value", date(2024, 1, 20), lookback_days=14, ceiling=60.0)
    return out.withColumns({c: F.round(c, 4) for c in ("today_mean", "band_mean", "band_stddev")})


@query(
    "dqc_anomaly_spike",
    """SELECT event_id, round(b, 4) AS baseline, value, CASE WHEN value > 8 * b THEN 'high' ELSE 'medium' END AS severity FROM (
         SELECT *, avg(value) OVER w AS b, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE n = 5 AND value > 4 * b""",
)
def _(t):
    out = checks.anomaly_spikes(t.events, ["user_id"], "ts", "value", baseline_events=5, factor=4.0, slice_by=F.col("ts").cast("date"))
    return out.select("event_id", F.round("baseline", 4).alias("baseline"), "value", "severity")


@query(
    "dqc_anomaly_threshold",
    "SELECT event_id, user_id, 'high' AS severity, 'value' AS metric_name, value AS metric_value FROM events WHERE value > 90.0",
)
def _(t):
    return checks.anomaly_threshold(t.events.select("event_id", "user_id", "value"), "value", 90.0).drop("value")


@query(
    "dqc_anomaly_iqr",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT 'value' AS column_name, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS anomaly_count FROM events, q""",
)
def _(t):
    return checks.anomaly_iqr(t.events, ["value"])


@query(
    "dqc_anomaly_mean_dev",
    """WITH d AS (SELECT CAST(ts AS DATE) AS run, avg(value) AS m FROM events GROUP BY 1), b AS (SELECT *, avg(m) OVER (ORDER BY run ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b FROM d)
       SELECT run, round(m, 4) AS run_mean, round(b, 4) AS baseline, coalesce(abs(m / b - 1) * 100 > 5, false) AS is_anomaly FROM b""",
)
def _(t):
    out = checks.anomaly_mean_deviation(t.events, F.col("ts").cast("date"), "value", runs=7, sensitivity_percent=5.0)
    return out.withColumns({c: F.round(c, 4) for c in ("run_mean", "baseline")})


def _volume_sql(metric: str, value: str) -> str:
    return f"""SELECT '{metric}' AS metric, day, CAST(v AS BIGINT) AS volume, round(b, 4) AS baseline, CASE WHEN b IS NULL THEN 'no_baseline' WHEN 100 * v / b >= 110 THEN 'spike' WHEN 100 * v / b <= 95 THEN 'drop' ELSE 'normal' END AS verdict
      FROM (SELECT day, v, avg(v) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b FROM (SELECT CAST(ts AS DATE) AS day, {value} AS v FROM events GROUP BY 1))"""


@query(
    "dqc_volume",
    " UNION ALL ".join([
        _volume_sql("row_count", "count(*)"), _volume_sql("distinct_keys", "count(DISTINCT user_id)"), _volume_sql("byte_size", "sum(strlen(props) + strlen(event_type))"),
    ]),
)
def _(t):
    out = None
    for metric in ("row_count", "distinct_keys", "byte_size"):
        one = checks.volume_check(
            t.events, "ts", metric=metric, key="user_id", bytes_of=["props", "event_type"], spike_percent=110.0, drop_percent=95.0
        ).select(F.lit(metric).alias("metric"), "day", F.col("volume").cast("long").alias("volume"), F.round("baseline", 4).alias("baseline"), "verdict")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dqc_duplicates",
    """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(100.0 * sum(n - 1) / sum(n), 4) AS duplicate_percent, 100.0 * sum(n - 1) / sum(n) <= 1.0 AS passed FROM g""",
)
def _(t):
    return checks.duplicate_share(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "dqc_referential",
    """SELECT doc_id, quality, CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN true ELSE false END AS has_parent FROM labels""",
)
def _(t):
    parents = t.documents.filter("lang = 'en'")
    return checks.referential(t.labels, parents, [("doc_id", "doc_id")], action="flag").rows.select("doc_id", "quality", "has_parent")


@query(
    "dqc_referential_report",
    """SELECT count(*) AS child_rows, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS orphan_rows,
              count(DISTINCT CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey END) AS orphan_keys FROM orders""",
)
def _(t):
    return checks.referential(t.orders, t.customer.filter("c_acctbal > 0"), [("o_custkey", "c_custkey")]).report


@query(
    "dqc_reconcile",
    """SELECT 'row_count' AS measure, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS source_value, CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS target_value, (SELECT count(*) FROM orders) = (SELECT count(*) FROM lineitem) AS passed
       UNION ALL SELECT 'amount', round((SELECT sum(o_totalprice) FROM orders), 2), round((SELECT sum(l_extendedprice) FROM lineitem), 2),
         abs((SELECT sum(o_totalprice) FROM orders) - (SELECT sum(l_extendedprice) FROM lineitem)) <= (SELECT sum(o_totalprice) FROM orders)""",
)
def _(t):
    out = checks.reconcile_totals(t.orders, t.lineitem, {"amount": ("o_totalprice", "l_extendedprice")}, tolerance_percent=100.0)
    exact = checks.reconcile_totals(t.orders, t.lineitem, {})
    rows = out.filter("measure <> 'row_count'").unionByName(exact)
    return rows.withColumns({c: F.round(c, 2) for c in ("source_value", "target_value")})


@query(
    "dqc_reconcile_rows",
    """WITH s AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS amount, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT o_orderkey AS k, o_totalprice AS amount, CAST(3 AS BIGINT) AS n FROM orders)
       SELECT coalesce(s.k, g.k) AS k, CASE WHEN s.k IS NULL THEN 'missing_in_source' WHEN g.k IS NULL THEN 'missing_in_target' WHEN abs(s.amount - g.amount) > 1000 AND s.n <> g.n THEN 'differs:amount,n'
              WHEN abs(s.amount - g.amount) > 1000 THEN 'differs:amount' WHEN abs(s.n - g.n) > 1000 THEN 'differs:n' ELSE 'match' END AS status FROM s FULL OUTER JOIN g ON s.k = g.k""".replace("s.n <> g.n", "abs(s.n - g.n) > 1000"),
)
def _(t):
    source = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.count(F.lit(1)).alias("n"))
    target = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"), F.lit(3).cast("long").alias("n"))
    return checks.reconcile_rows(source, target, ["k"], ["amount", "n"], tolerance=1000.0)


@query(
    "dqc_quarantine",
    f"""SELECT o_orderkey, 'run-7' AS quarantine_run_id, DATE '2024-01-31' AS quarantine_ds, concat_ws(',', CASE WHEN state IS NULL THEN 'status_given' END, CASE WHEN o_totalprice < 5000 THEN 'price_floor' END,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'known_priority' END) AS failed FROM {ORDERS} WHERE state IS NULL OR o_totalprice < 5000 OR o_orderpriority = '4-NOT SPECIFIED'""",
)
def _(t):
    from ..session import scratch_path
    from ..sinks.tables import append_quarantine, retain

    path = scratch_path(t.spark, "quarantine")
    rejected = quality.validate(orders(t), CLAIM_RULES).rejected
    append_quarantine(rejected, path, "run-1", date(2023, 1, 1))
    append_quarantine(rejected, path, "run-7", date(2024, 1, 31))
    kept = retain(t.spark.read.parquet(path), "quarantine_ds", date(2024, 2, 1), 90)
    return kept.select("o_orderkey", "quarantine_run_id", "quarantine_ds", F.concat_ws(",", "failed_rules").alias("failed"))


@query(
    "dqc_scorecard",
    f"""WITH r AS (SELECT 3.0 AS w, CAST((SELECT count(*) = 0 FROM {ORDERS} WHERE state IS NULL) AS INTEGER) AS ok UNION ALL SELECT 1.0, CAST((SELECT count(*) = 0 FROM orders WHERE o_totalprice < 5000) AS INTEGER)
          UNION ALL SELECT 6.0, CAST((SELECT count(*) > 100 FROM orders) AS INTEGER)), s AS (SELECT round(sum(w * ok) / sum(w), 4) AS score, min(ok) AS worst, count(*) AS checks FROM r)
       SELECT 'weighted' AS method, score, checks, CASE WHEN score >= 0.9 THEN 'pass' ELSE 'fail' END AS verdict FROM s UNION ALL SELECT 'pass_fail', score, checks, CASE WHEN worst = 1 THEN 'pass' ELSE 'fail' END FROM s
       UNION ALL SELECT 'tiered', score, checks, CASE WHEN score >= 0.95 THEN 'gold' WHEN score >= 0.8 THEN 'silver' WHEN score >= 0.6 THEN 'bronze' ELSE 'failing' END FROM s""",
)
def _(t):
    rules = [CLAIM_RULES[0], CLAIM_RULES[1], {"type": "row_count_between", "min": 101}]
    report = quality.run_suite(orders(t), rules)
    weights = {"status_given": 3.0, "price_floor": 1.0, "row_count_between": 6.0}
    out = None
    for method in ("weighted", "pass_fail", "tiered"):
        one = checks.scorecard(report, weights, method).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


def _profile_sql(c: str, valid: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER (v IS NULL) AS null_count, count(DISTINCT v) AS distinct_count, coalesce(max(length(v)), 0) AS max_length,
      count(*) FILTER ({valid}) AS valid_count, (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT nullif(trim(CAST({c} AS VARCHAR)), '') AS x FROM {PROFILED}) WHERE x IS NOT NULL GROUP BY x)) AS top_count
      FROM (SELECT nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM {PROFILED})"""


PROFILED = "(SELECT doc_id, lang, source, text, CASE WHEN lang = 'de' THEN n_chars END AS size FROM documents)"
PROFILE_SQL = " UNION ALL ".join([
    _profile_sql("doc_id", "TRY_CAST(v AS INTEGER) IS NOT NULL"), _profile_sql("lang", "v IS NOT NULL"), _profile_sql("source", "TRY_CAST(v AS INTEGER) IS NOT NULL"), _profile_sql("size", "v IS NOT NULL"),
    _profile_sql("text", "v IS NOT NULL"),
])


def profiled(t):
    return t.documents.select("doc_id", "lang", "source", "text", F.expr("CASE WHEN lang = 'de' THEN n_chars END").alias("size"))


@query("dqc_profile", f"SELECT *, round(null_count / row_count, 6) AS null_rate, round(valid_count / (row_count - null_count), 6) AS valid_share FROM ({PROFILE_SQL})")
def _(t):
    return profiling.profile(profiled(t), {"doc_id": "int", "source": "int"})


@query(
    "dqc_profile_top",
    """WITH c AS (SELECT 'lang' AS column_name, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2)
       SELECT column_name, value, n, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS position FROM c) WHERE position <= 3""",
)
def _(t):
    return profiling.top_values(t.documents, ["lang", "source"])


@query(
    "dqc_profile_flags",
    f"""WITH p AS ({PROFILE_SQL}) SELECT column_name, 'mostly_null' AS warning FROM p WHERE null_count >= 0.8 * row_count UNION ALL SELECT column_name, 'dominant_value' FROM p WHERE top_count >= 0.9 * row_count
        UNION ALL SELECT column_name, 'type_mismatch' FROM p WHERE valid_count < row_count - null_count""",
)
def _(t):
    return profiling.profile_flags(profiling.profile(profiled(t), {"doc_id": "int", "source": "int"}))
