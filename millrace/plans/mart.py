"""The flagship job: clean the orders, join the star, roll up by month and segment, sort."""

from pyspark.sql import functions as F

from ..operators import aggregates, columns, joins, sets
from .registry import Tables, query

MART_SQL = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_bucket, c_mktsegment AS segment, n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
       round(avg(l_quantity), 8) AS avg_quantity, count(DISTINCT o_orderkey) AS orders, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"""


def sales_mart(t: Tables):
    orders = columns.clean(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"),
        trim_columns=["o_orderpriority"],
        names={"o_orderdate": "order_day"},
        types={"order_day": "date"},
        drop_columns=["o_orderpriority"],
        required=["o_orderkey", "o_custkey"],
    )
    lines = t.lineitem.select(
        "l_orderkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )
    star = joins.join_star(
        lines,
        [
            ("", orders, [("l_orderkey", "o_orderkey")], ["o_custkey", "order_day"]),
            ("", t.customer, [("o_custkey", "c_custkey")], ["c_mktsegment", "c_nationkey"]),
            ("", t.nation, [("c_nationkey", "n_nationkey")], ["n_name"]),
        ],
        how="inner",
    )
    monthly = aggregates.bucket_aggregate(
        star, "order_day", "month", ["c_mktsegment", "n_name"], {"revenue": ["sum"], "l_quantity": ["avg"]}, distinct=["l_orderkey"]
    )
    out = monthly.select(
        "period_bucket", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.round("revenue_sum", 4).alias("revenue"),
        F.round("l_quantity_avg", 8).alias("avg_quantity"), F.col("l_orderkey_distinct_count").alias("orders"), F.col("row_count").alias("lines"),
    )
    return sets.sort(out, ["period_bucket", "segment", "nation"])


@query("mart_sales", MART_SQL)
def _(t):
    return sales_mart(t)
