"""Filter and routing queries."""

from datetime import date

from pyspark.sql import functions as F

from ..operators import filters as op
from ..operators import routing
from .registry import query


@query(
    "flt_sql",
    "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000 AND (o_orderpriority LIKE '1%' OR o_orderdate >= DATE '1999-01-01')",
)
def _(t):
    return op.filter_sql(
        t.orders,
        "o_orderstatus = 'F' AND o_totalprice > 150000 AND (o_orderpriority LIKE '1%' OR o_orderdate >= DATE '1999-01-01')",
    )


@query(
    "flt_conditions",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem
       WHERE l_returnflag = 'R' AND l_quantity >= 40 OR l_linestatus = 'F' AND l_quantity < 3 AND l_returnflag NOT IN ('A', 'R')""",
)
def _(t):
    rows = op.filter_conditions(
        t.lineitem,
        [
            {"column": "l_returnflag", "operator": "eq", "value": "R"},
            {"column": "l_quantity", "operator": "gte", "value": 40, "logic": "AND"},
            {"column": "l_linestatus", "operator": "eq", "value": "F", "logic": "OR"},
            {"column": "l_quantity", "operator": "lt", "value": 3, "logic": "AND"},
            {"column": "l_returnflag", "operator": "not_in", "value": "A, R", "logic": "AND"},
        ],
    )
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")


@query(
    "flt_drop_nulls",
    "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'",
)
def _(t):
    holes = t.orders.select(
        "o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority")
    )
    return op.drop_null_rows(holes, ["status", "priority"])


@query(
    "flt_complex",
    """SELECT o_orderkey, status, o_orderdate, o_totalprice FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders)
       WHERE o_orderdate >= DATE '1999-10-01' AND (status NOT IN ('F') OR status IS NULL) AND o_totalprice < 250000""",
)
def _(t):
    rows = t.orders.withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))
    kept = op.filter_clauses(
        rows,
        [
            {"column": "o_orderdate", "op": ">=", "date_relative": "BOQ-1"},
            {"column": "status", "op": "NOT_IN", "values": ["F"], "allow_null": True},
            {"column": "o_totalprice", "op": "<", "value": 250000},
        ],
        "AND",
        date(2000, 2, 10),
    )
    return kept.select("o_orderkey", "status", "o_orderdate", "o_totalprice")


@query("flt_partition", "SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'")
def _(t):
    dated = t.events.withColumn("ds", F.col("ts").cast("date"))
    return op.filter_partition(dated, "ds", date(2024, 1, 10), date(2024, 1, 16)).select("event_id", "user_id", "value")


ROUTES = {
    "large": "o_totalprice > 250000",
    "urgent": "nullif(o_orderpriority, '3-MEDIUM') = '1-URGENT'",
    "open": "o_orderstatus = 'O'",
}


@query(
    "rte_split",
    """WITH r AS (SELECT *, o_totalprice > 250000 AS a, o_orderpriority = '1-URGENT' AS b, o_orderstatus = 'O' AS c FROM orders)
       SELECT 'large' AS route, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM r WHERE a
       UNION ALL SELECT 'urgent', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM r WHERE b
       UNION ALL SELECT 'open', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM r WHERE c
       UNION ALL SELECT 'default', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM r WHERE NOT (a OR b OR c)""",
)
def _(t):
    outputs = routing.split_routes(t.orders, ROUTES)
    sizes = [
        df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")).select(F.lit(name).alias("route"), "n", "key_sum")
        for name, df in outputs.items()
    ]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


@query(
    "rte_tags",
    """WITH r AS (SELECT o_orderkey, o_totalprice > 250000 AS a, o_orderpriority = '1-URGENT' AS b, o_orderstatus = 'O' AS c FROM orders)
       SELECT o_orderkey, 'large' AS route FROM r WHERE a UNION ALL SELECT o_orderkey, 'urgent' FROM r WHERE b
       UNION ALL SELECT o_orderkey, 'open' FROM r WHERE c UNION ALL SELECT o_orderkey, 'default' FROM r WHERE NOT (a OR b OR c)""",
)
def _(t):
    return routing.route_tags(t.orders, ROUTES).select("o_orderkey", "route")


@query(
    "rte_label",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'prime' WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN 'review'
              WHEN o_totalprice < 50000 THEN 'small' ELSE 'standard' END AS route FROM orders""",
)
def _(t):
    return routing.label_routes(
        t.orders,
        [
            ("prime", "o_totalprice > 300000"),
            ("review", "o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'"),
            ("small", "o_totalprice < 50000"),
            ("standard", "default"),
        ],
    ).select("o_orderkey", "route")
