"""Join queries."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import joins as op
from .registry import query


@query(
    "jn_equi",
    """SELECT s.id AS id, s.name AS name, s.s_nationkey, n.id AS right_id, n.name AS right_name
       FROM (SELECT s_suppkey AS id, s_name AS name, s_nationkey FROM supplier WHERE s_acctbal > 0) s
       FULL OUTER JOIN (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 0) n ON s.s_nationkey = n.id""",
)
def _(t):
    suppliers = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    nations = t.nation.filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return op.join_equi(suppliers, nations, [("s_nationkey", "id")], "full_outer")


@query(
    "jn_equi_orders",
    """SELECT l_orderkey, l_linenumber, l_quantity, o_orderdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    right = t.orders.select("o_orderkey", "o_orderdate", "o_custkey")
    return op.join_equi(left, right, [("l_orderkey", "o_orderkey")]).drop("o_orderkey")


@query(
    "jn_cross",
    """SELECT r_name, c_mktsegment, c_custkey FROM customer, region""",
)
def _(t):
    return op.join_cross(t.customer.select("c_custkey", "c_mktsegment"), t.region.select("r_name"))


@query(
    "jn_theta",
    """SELECT o_orderkey, c_custkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 30""",
)
def _(t):
    return op.join_theta(t.orders, t.customer, "l.o_custkey = r.c_custkey AND l.o_totalprice > r.c_acctbal * 30").select(
        "o_orderkey", "c_custkey", "o_totalprice", "c_acctbal"
    )


@query(
    "jn_projected",
    """SELECT o_orderkey AS order_id, c_name AS customer, round(o_totalprice - c_acctbal, 4) AS gap
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def _(t):
    return op.join_projected(
        t.orders, t.customer, [("o_custkey", "c_custkey")],
        {"order_id": "l.o_orderkey", "customer": "r.c_name", "gap": "round(l.o_totalprice - r.c_acctbal, 4)"},
        left_filter="o_orderstatus = 'O'", right_filter="c_mktsegment IN ('BUILDING', 'MACHINERY')",
    )


@query(
    "jn_enrich",
    """SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS is_labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    docs = t.documents.select("doc_id", "lang")
    return op.enrich(docs, t.labels, ["doc_id"], ["quality", "toxic"], flag="is_labelled")


@query(
    "jn_unknown_member",
    """SELECT o_orderkey, o_custkey, coalesce(c_name, 'UNKNOWN') AS c_name, coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""",
)
def _(t):
    dim = t.customer.filter("c_acctbal >= 0")
    return op.with_unknown_member(t.orders.select("o_orderkey", "o_custkey"), dim, [("o_custkey", "c_custkey")], ["c_name", "c_mktsegment"])


STAR_SQL = """SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderdate AS order_o_orderdate, c_name AS cust_c_name, c_nationkey AS cust_c_nationkey,
       n_name AS nat_n_name, p_brand AS part_p_brand
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey"""


@query("jn_star", STAR_SQL)
def _(t):
    fact = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = op.join_star(
        fact,
        [
            ("order_", t.orders, [("l_orderkey", "o_orderkey")], ["o_orderdate", "o_custkey"]),
            ("cust_", t.customer, [("order_o_custkey", "c_custkey")], ["c_name", "c_nationkey"]),
            ("nat_", t.nation, [("cust_c_nationkey", "n_nationkey")], ["n_name"]),
            ("part_", t.part, [("l_partkey", "p_partkey")], ["p_brand"]),
        ],
    )
    return out.drop("l_partkey", "order_o_custkey")


# Segment versions per customer: one per status change of the customer's orders would be data
# dependent; here every customer has a version from the start and one from mid-1998 on.
TEMPORAL_SQL = """
WITH v AS (
  SELECT c_custkey AS k, 'early-' || c_mktsegment AS grade, TIMESTAMP '1996-01-01' AS f, TIMESTAMP '1998-07-01' AS u FROM customer
  UNION ALL SELECT c_custkey, 'late-' || c_mktsegment, TIMESTAMP '1998-07-01', CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2000-01-01' END FROM customer)
SELECT o_orderkey, o_custkey, o_orderdate, grade FROM orders LEFT JOIN v ON o_custkey = k AND o_orderdate >= f AND (u IS NULL OR o_orderdate < u)"""


def customer_versions(t):
    start, turn, end = (F.lit(datetime(y, m, 1)).cast("timestamp_ntz") for y, m in ((1996, 1), (1998, 7), (2000, 1)))
    early = t.customer.select(
        F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("early-"), "c_mktsegment").alias("grade"), start.alias("valid_from"), turn.alias("valid_to")
    )
    late = t.customer.select(
        F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("late-"), "c_mktsegment").alias("grade"), turn.alias("valid_from"),
        F.when(F.col("c_acctbal") < 0, end).alias("valid_to"),
    )
    return early.unionByName(late)


@query("jn_temporal", TEMPORAL_SQL)
def _(t):
    facts = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return op.join_temporal(
        facts, customer_versions(t), ["o_custkey"], "o_orderdate", "valid_from", "valid_to", ["grade"], max_broadcast=0
    )


@query("jn_temporal_small", TEMPORAL_SQL.replace("LEFT JOIN v", "JOIN v"))
def _(t):
    facts = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return op.join_temporal(facts, customer_versions(t), ["o_custkey"], "o_orderdate", "valid_from", "valid_to", ["grade"], how="inner")


# Cut-off per user: the time of the user's last purchase.
POINT_SQL = """
WITH cut AS (SELECT user_id, max(ts) AS cutoff FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id, cutoff, count(*) AS events_before, round(sum(value), 4) AS value_before
FROM events e JOIN cut USING (user_id) WHERE ts <= cutoff GROUP BY e.user_id, cutoff"""


def purchase_cutoffs(t):
    return t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("cutoff"))


@query("jn_point_in_time", POINT_SQL)
def _(t):
    joined = op.join_point_in_time(purchase_cutoffs(t), t.events.select("user_id", "ts", "value"), ["user_id"], "cutoff", "ts")
    return joined.groupBy("user_id", "cutoff").agg(
        F.count(F.lit(1)).alias("events_before"), F.round(F.sum("value"), 4).alias("value_before")
    )


@query(
    "jn_salted",
    """SELECT e.event_id, e.user_id, n FROM events e JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) x USING (user_id)""",
)
def _(t):
    per_user = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return op.salted_join(t.events.select("event_id", "user_id"), per_user, ["user_id"], hot_rows=70).select("event_id", "user_id", "n")


VALIDITY_SQL = """WITH promo AS (SELECT 'P-' || p_partkey AS promo, p_partkey AS k, DATE '1996-01-01' AS s, CASE WHEN p_type = 'PROMO' THEN NULL ELSE DATE '1997-06-30' END AS e FROM part WHERE p_type IN ('PROMO', 'SMALL'))
       SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS ship_day, promo FROM lineitem
       LEFT JOIN promo ON l_partkey = k AND CAST(l_shipdate AS DATE) >= s AND (e IS NULL OR CAST(l_shipdate AS DATE) <= e)"""


def promotions(t):
    return t.part.filter("p_type IN ('PROMO', 'SMALL')").select(
        F.concat(F.lit("P-"), "p_partkey").alias("promo"), "p_partkey", F.lit("1996-01-01").cast("date").alias("start_date"),
        F.expr("CASE WHEN p_type <> 'PROMO' THEN DATE '1997-06-30' END").alias("end_date"),
    )


def shipped_lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("ship_day"))


@query("jn_validity_promo", VALIDITY_SQL)
def _(t):
    return op.join_validity(shipped_lines(t), promotions(t), [("l_partkey", "p_partkey")], "ship_day", "start_date", "end_date", ["promo"])


@query("jn_validity_sliced", VALIDITY_SQL)
def _(t):
    return op.join_validity(
        shipped_lines(t), promotions(t), [("l_partkey", "p_partkey")], "ship_day", "start_date", "end_date", ["promo"], slice_by="quarter", max_broadcast=0, hot_rows=3, salts=4
    )


@query(
    "jn_anti_orphans",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)",
)
def _(t):
    parents = t.part.filter("p_size > 10")
    return op.anti_orphans(t.lineitem, parents, [("l_partkey", "p_partkey")]).select("l_orderkey", "l_linenumber")


@query(
    "jn_semi_retry",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')
       AND CAST(o_orderdate AS DATE) NOT IN (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
)
def _(t):
    dated = t.orders.withColumn("ds", F.col("o_orderdate").cast("date"))
    loaded = dated.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    wanted = t.customer.filter("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return op.semi_pending(dated, wanted, ["o_custkey"], loaded, ["ds"]).select("o_orderkey", "o_custkey")
