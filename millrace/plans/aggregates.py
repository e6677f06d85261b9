"""Aggregate queries."""

from datetime import date

from pyspark.sql import functions as F

from ..operators import aggregates as op
from .registry import query


@query(
    "agg_group",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship,
              max(l_discount) AS max_l_discount, count(*) AS count_all, count(DISTINCT l_suppkey) AS count_distinct_l_suppkey
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(t):
    out = op.group_aggregate(
        t.lineitem,
        ["l_returnflag", "l_linestatus"],
        [
            {"function": "sum", "column": "l_quantity", "alias": "sum_qty"},
            {"function": "avg", "column": "l_extendedprice", "alias": "avg_price"},
            {"function": "min", "column": "l_shipdate", "alias": "first_ship"},
            {"function": "max", "column": "l_discount"},
            {"function": "count", "column": "*"},
            {"function": "count_distinct", "column": "l_suppkey"},
        ],
    )
    return out.withColumn("avg_price", F.round("avg_price", 4))


@query("agg_global", "SELECT count(*) AS count_all, round(sum(o_totalprice), 2) AS total FROM orders")
def _(t):
    out = op.group_aggregate(
        t.orders, [], [{"function": "count", "column": None}, {"function": "sum", "column": "o_totalprice", "alias": "total"}]
    )
    return out.withColumn("total", F.round("total", 2))


@query(
    "agg_having",
    "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 2000000",
)
def _(t):
    out = op.group_aggregate(
        t.orders, ["o_custkey"],
        [{"function": "count", "column": "*", "alias": "n"}, {"function": "sum", "column": "o_totalprice", "alias": "total"}],
        having="n > 10 AND total > 2000000",
    )
    return out.withColumn("total", F.round("total", 2))


@query(
    "agg_types",
    """SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sum_p_size, round(sum(p_retailprice), 2) AS price, avg(p_size) AS avg_p_size,
              min(p_size) AS min_p_size, max(p_name) AS max_p_name, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand""",
)
def _(t):
    rows = t.part.withColumn("price", F.col("p_retailprice").cast("decimal(12,2)"))
    return op.group_aggregate(
        rows, ["p_brand"],
        [
            {"function": "sum", "column": "p_size"}, {"function": "sum", "column": "price", "alias": "price"},
            {"function": "avg", "column": "p_size"}, {"function": "min", "column": "p_size"}, {"function": "max", "column": "p_name"},
            {"function": "count_distinct", "column": "p_type", "alias": "types"},
        ],
        contract_types=True,
    ).withColumn("price", F.round("price", 2))


@query(
    "agg_distinct_dims",
    """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days,
              count(DISTINCT o_orderstatus) AS statuses, count(*) AS orders FROM orders GROUP BY o_orderpriority""",
)
def _(t):
    rows = t.orders.withColumn("day", F.col("o_orderdate").cast("date"))
    return op.group_aggregate(
        rows, ["o_orderpriority"],
        [
            {"function": "count_distinct", "column": "o_custkey", "alias": "customers"},
            {"function": "count_distinct", "column": "day", "alias": "days"},
            {"function": "count_distinct", "column": "o_orderstatus", "alias": "statuses"},
            {"function": "count", "column": "*", "alias": "orders"},
        ],
    )


@query(
    "agg_stats",
    """SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_samp(value), 4) AS var, quantile_disc(value, 0.5) AS p50,
              arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event FROM events GROUP BY event_type""",
)
def _(t):
    out = op.group_aggregate(
        t.events, ["event_type"],
        [
            {"function": "stddev", "column": "value", "alias": "sd"},
            {"function": "variance", "column": "value", "alias": "var"},
            {"function": "percentile_approx", "column": "value", "argument": 0.5, "alias": "p50"},
            {"function": "first", "column": "event_id", "order": "ts", "alias": "first_event"},
            {"function": "last", "column": "event_id", "order": "ts", "alias": "last_event"},
        ],
    )
    return out.withColumns({"sd": F.round("sd", 4), "var": F.round("var", 4)})


@query(
    "agg_collect",
    """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses,
              array_to_string(list_sort(list(o_orderkey)), ',') AS orders FROM orders GROUP BY o_custkey""",
)
def _(t):
    out = op.group_aggregate(
        t.orders, ["o_custkey"],
        [
            {"function": "collect_set", "column": "o_orderstatus", "alias": "statuses"},
            {"function": "collect_list", "column": "o_orderkey", "alias": "orders"},
        ],
    )
    return out.withColumns({"statuses": F.concat_ws(",", "statuses"), "orders": F.concat_ws(",", F.col("orders").cast("array<string>"))})


@query(
    "agg_bucket",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period_bucket, l_returnflag, sum(l_quantity) AS l_quantity_sum, round(avg(l_quantity), 8) AS l_quantity_avg,
              max(l_extendedprice) AS l_extendedprice_max, count(DISTINCT l_partkey) AS l_partkey_distinct_count, count(*) AS row_count
       FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    out = op.bucket_aggregate(
        t.lineitem, "l_shipdate", "month", ["l_returnflag"], {"l_quantity": ["sum", "avg"], "l_extendedprice": ["max"]}, distinct=["l_partkey"]
    )
    return out.withColumn("l_quantity_avg", F.round("l_quantity_avg", 8))


def _bucket_sql(unit: str, expr: str) -> str:
    return f"SELECT '{unit}' AS unit, {expr} AS period_bucket, round(sum(o_totalprice), 2) AS total, count(*) AS row_count FROM orders GROUP BY 2"


@query(
    "agg_bucket_units",
    " UNION ALL ".join(_bucket_sql(u, f"CAST(date_trunc('{u}', o_orderdate) AS DATE)") for u in ("day", "week", "month", "quarter", "year")),
)
def _(t):
    out = None
    for unit in ("day", "week", "month", "quarter", "year"):
        part = op.bucket_aggregate(t.orders, "o_orderdate", unit, [], {"o_totalprice": ["sum"]})
        part = part.select(F.lit(unit).alias("unit"), "period_bucket", F.round("o_totalprice_sum", 2).alias("total"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "agg_fiscal_bucket",
    """SELECT 'quarter' AS unit, CAST(date_trunc('quarter', o_orderdate - INTERVAL 1 MONTH) + INTERVAL 1 MONTH AS DATE) AS period_bucket, o_orderstatus, count(*) AS row_count FROM orders GROUP BY 2, 3
       UNION ALL SELECT 'year', CAST(date_trunc('year', o_orderdate - INTERVAL 1 MONTH) + INTERVAL 1 MONTH AS DATE), o_orderstatus, count(*) FROM orders GROUP BY 2, 3""",
)
def _(t):
    parts = [
        op.bucket_aggregate(t.orders, "o_orderdate", f"fiscal_{u}", ["o_orderstatus"], {}, fiscal_offset=1).withColumn("unit", F.lit(u))
        for u in ("quarter", "year")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "agg_incremental",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_bucket, count(*) AS row_count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def _(t):
    def monthly(df):
        out = op.bucket_aggregate(df, "o_orderdate", "month", [], {"o_totalprice": ["sum"]})
        return out.select("period_bucket", "row_count", F.round("o_totalprice_sum", 2).alias("total"))

    # Published before the finished orders of 1999 and 2000 arrived; the run rebuilds those months.
    start, end = date(1999, 1, 1), date(2000, 12, 1)
    day = F.col("o_orderdate").cast("date")
    late = day.between(F.lit(start), F.lit(date(2000, 12, 31))) & (F.col("o_orderstatus") == "F")
    published = monthly(t.orders.filter(~late))
    return op.incremental_buckets(t.orders, published, "o_orderdate", "month", start, end, monthly)


@query(
    "agg_net_measures",
    """WITH r AS (SELECT s_nationkey AS seller, l_shipdate, l_orderkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS gross,
                         CASE WHEN l_returnflag = 'R' THEN l_extendedprice WHEN l_quantity = 1 THEN -1 ELSE 0 END AS refund, l_quantity
                  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
       SELECT seller, CAST(l_shipdate AS DATE) AS business_date, round(sum(gross), 2) AS gross_revenue, round(sum(refund), 2) AS refund_amount,
              round(sum(gross) - sum(refund), 2) AS net_revenue, sum(l_quantity) AS units, count(DISTINCT l_orderkey) AS order_count
       FROM r WHERE gross >= 0 AND refund >= 0 GROUP BY 1, 2""",
)
def _(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("seller"), "l_shipdate", "l_orderkey", "l_quantity",
        F.expr("CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END").alias("gross"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN l_extendedprice WHEN l_quantity = 1 THEN -1 ELSE 0 END").alias("refund"),
    )
    rollup = op.net_measures(rows, "seller", "l_shipdate", "gross", "refund", "l_quantity", "l_orderkey").accepted
    return rollup.withColumns({c: F.round(c, 2) for c in ("gross_revenue", "refund_amount", "net_revenue")})


@query(
    "agg_line_rules",
    """WITH r AS (SELECT l_suppkey, l_linestatus, CASE WHEN l_returnflag = 'R' OR l_quantity > 45 THEN -l_quantity ELSE l_quantity END AS q, l_extendedprice AS p,
                         CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'sale' END AS k FROM lineitem)
       SELECT l_suppkey, l_linestatus, sum(q) AS sum_quantity, round(sum(q * p), 2) AS sum_revenue, count(*) AS line_count, min(p) AS min_unit_price, max(p) AS max_unit_price
       FROM r WHERE NOT (q < 0 AND k <> 'return') GROUP BY 1, 2""",
)
def _(t):
    rows = t.lineitem.select(
        "l_suppkey", "l_linestatus", F.expr("CASE WHEN l_returnflag = 'R' OR l_quantity > 45 THEN -l_quantity ELSE l_quantity END").alias("q"),
        F.col("l_extendedprice").alias("p"), F.expr("CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'sale' END").alias("k"),
    )
    out = op.line_rules(rows, ["l_suppkey", "l_linestatus"], "q", "p", "k").accepted
    return out.withColumn("sum_revenue", F.round("sum_revenue", 2))


@query(
    "agg_pre",
    """SELECT part_p_brand, part_p_type, CAST(sum(lines) AS BIGINT) AS lines, sum(qty) AS qty FROM (
         SELECT p_brand AS part_p_brand, p_type AS part_p_type, lines, qty FROM
           (SELECT l_partkey, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2""",
)
def _(t):
    joined = op.pre_aggregate_star(
        t.lineitem, ["l_partkey"], {"lines": F.count(F.lit(1)), "qty": F.sum("l_quantity")},
        [("part_", t.part, [("l_partkey", "p_partkey")], ["p_brand", "p_type"])],
    )
    return joined.groupBy("part_p_brand", "part_p_type").agg(F.sum("lines").alias("lines"), F.sum("qty").alias("qty"))


@query(
    "agg_collect_parts",
    """WITH n AS (SELECT o_orderstatus, o_custkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) - 1) // 500 AS part FROM orders),
       l AS (SELECT o_orderstatus, part, string_agg(o_custkey, ',' ORDER BY o_custkey) AS customers FROM n GROUP BY ALL),
       d AS (SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(*) AS orders FROM orders GROUP BY ALL)
       SELECT l.o_orderstatus, part, orders, customers, CASE WHEN part = 0 THEN priorities ELSE '' END AS priorities FROM l JOIN d USING (o_orderstatus)""",
)
def _(t):
    out = op.group_aggregate(
        t.orders, ["o_orderstatus"],
        [
            {"function": "count", "column": "*", "alias": "orders"},
            {"function": "collect_list", "column": "o_custkey", "alias": "customers"},
            {"function": "collect_set", "column": "o_orderpriority", "alias": "priorities"},
        ],
        part_rows=500,
    )
    return out.withColumns({"customers": F.concat_ws(",", F.col("customers").cast("array<string>")), "priorities": F.concat_ws(",", "priorities")})


FEATURES_SQL = """
WITH cut AS (SELECT user_id, CASE WHEN max(value) > 200 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-02' END AS cutoff FROM events GROUP BY user_id),
f AS (
  SELECT e.user_id, cutoff, count(*) FILTER (ts > cutoff - INTERVAL 7 DAY) AS events_7d, sum(value) FILTER (ts > cutoff - INTERVAL 7 DAY) AS value_7d,
         count(*) AS events_30d, sum(value) AS value_30d, max(value) AS max_value_30d, count(*) FILTER (event_type = 'error') AS errors_30d
  FROM events e JOIN cut USING (user_id) WHERE ts <= cutoff AND ts > cutoff - INTERVAL 30 DAY GROUP BY 1, 2)
SELECT user_id, cutoff, coalesce(events_7d, 0) AS events_7d, round(coalesce(value_7d, 0.0), 4) AS value_7d, coalesce(events_30d, 0) AS events_30d,
       round(coalesce(value_30d, 0.0), 4) AS value_30d, coalesce(max_value_30d, 0.0) AS max_value_30d, coalesce(errors_30d, 0) AS errors_30d
FROM cut LEFT JOIN f USING (user_id, cutoff)"""


def feature_cutoffs(t):
    return t.events.groupBy("user_id").agg(
        F.expr("CASE WHEN max(value) > 200 THEN TIMESTAMP_NTZ '2024-01-20 00:00:00' ELSE TIMESTAMP_NTZ '2024-01-02 00:00:00' END").alias("cutoff")
    )


def feature_table(t):
    return op.windowed_features(
        feature_cutoffs(t), t.events, ["user_id"], "cutoff", "ts",
        {
            "events_7d": ("count", 7, None), "value_7d": ("sum", 7, F.col("value")), "events_30d": ("count", 30, None),
            "value_30d": ("sum", 30, F.col("value")), "max_value_30d": ("max", 30, F.col("value")),
            "errors_30d": ("count", 30, F.col("event_type") == "error"),
        },
        excluded=["props"],
    ).withColumns({"value_7d": F.round("value_7d", 4), "value_30d": F.round("value_30d", 4)})


@query("agg_features", FEATURES_SQL)
def _(t):
    return feature_table(t)


@query(
    "agg_features_daily",
    """WITH cut AS (SELECT DISTINCT user_id, time_bucket(INTERVAL 12 HOUR, ts) AS cutoff FROM events)
       SELECT c.user_id, c.cutoff, count(*) FILTER (ts > cutoff - INTERVAL 1 DAY) AS n_1d, count(*) FILTER (ts > cutoff - INTERVAL 3 DAY) AS n_3d,
              coalesce(round(avg(value) FILTER (ts > cutoff - INTERVAL 3 DAY), 8), 0) AS avg_3d, coalesce(min(value) FILTER (ts > cutoff - INTERVAL 7 DAY), 0) AS min_7d,
              coalesce(max(value), 0) AS max_14d
       FROM cut c LEFT JOIN events e ON e.user_id = c.user_id AND ts <= cutoff AND ts > cutoff - INTERVAL 14 DAY GROUP BY ALL""".replace(
        "count(*) FILTER (ts", "count(*) FILTER (e.user_id IS NOT NULL AND ts"
    ),
)
def _(t):
    cutoffs = t.events.select("user_id", F.expr("timestampadd(HOUR, 12 * (hour(ts) div 12), date_trunc('DAY', ts))").cast("timestamp_ntz").alias("cutoff")).distinct()
    out = op.windowed_features(
        cutoffs, t.events, ["user_id"], "cutoff", "ts",
        {"n_1d": ("count", 1, None), "n_3d": ("count", 3, None), "avg_3d": ("avg", 3, F.col("value")), "min_7d": ("min", 7, F.col("value")), "max_14d": ("max", 14, F.col("value"))},
    )
    return out.withColumn("avg_3d", F.round("avg_3d", 8))


@query(
    "agg_feature_join",
    """SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(o.total, 0.0) AS total, coalesce(f.n, 0) AS open_orders FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 GROUP BY 1) f ON c_custkey = f.o_custkey""",
)
def _(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    totals = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    opened = orders.filter("o_orderstatus = 'O' AND o_totalprice > 200000").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("open_orders"))
    return op.join_features(t.customer, ["c_custkey"], [totals, opened])


def _downsample_sql(unit: str, method: str, value: str) -> str:
    bucket = f"date_trunc('{unit}', ts)" if unit == "hour" else f"CAST(CAST(date_trunc('{unit}', ts) AS DATE) AS TIMESTAMP)"
    return f"SELECT '{unit}' AS unit, '{method}' AS method, event_type, {bucket} AS period_bucket, {value} AS value FROM events GROUP BY 3, 4"


@query(
    "agg_downsample",
    " UNION ALL ".join([
        _downsample_sql("hour", "last", "arg_max(value, ts)"),
        _downsample_sql("day", "average", "round(avg(value), 8)"),
        _downsample_sql("week", "first", "arg_min(value, ts)"),
        _downsample_sql("month", "average", "round(avg(value), 8)"),
    ]),
)
def _(t):
    out = None
    for unit, method in (("hour", "last"), ("day", "average"), ("week", "first"), ("month", "average")):
        part = op.downsample(t.events, "ts", unit, ["event_type"], "value", method)
        part = part.select(
            F.lit(unit).alias("unit"), F.lit(method).alias("method"), "event_type", F.col("period_bucket").cast("timestamp_ntz").alias("period_bucket"),
            (F.round("value", 8) if method == "average" else F.col("value")).alias("value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "agg_metrics",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS total, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY 1)
       SELECT day, n, bought, round(total / n, 8) AS per_event, round(100e0 * bought / n, 8) AS conversion,
              round(avg(total) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS rolling_total FROM d""",
)
def _(t):
    from ..operators.windows import rolling_rows

    daily = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("bought")
    )
    rolled = rolling_rows(
        daily.withColumn("all", F.lit(1)), ["all"], ["day"], {"rolling": F.avg("total")}, 6, slice_by=F.trunc("day", "month")
    )
    out = op.derived_metrics(rolled, {"per_event": "total / n", "conversion": "100e0 * bought / n", "rolling_total": "rolling"}, digits=8)
    return out.drop("all", "total", "rolling")
