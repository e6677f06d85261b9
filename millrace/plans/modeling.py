"""Fact, mart, reference, vault and hierarchy queries."""

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import modeling as op
from .aggregates import FEATURES_SQL, feature_table
from .registry import query

FACT_SQL = """
WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem),
promo AS (SELECT p_partkey, 'PR-' || p_type AS promotion_id FROM part WHERE p_type = 'PROMO')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p.p_brand, 'UNKNOWN') AS p_brand, coalesce(p.p_type, 'UNKNOWN') AS p_type, coalesce(s.s_name, 'UNKNOWN') AS s_name,
       promotion_id, round(l_extendedprice * l_discount, 4) AS discount_amount, round(l_extendedprice * l_tax, 4) AS tax_amount,
       round(l_extendedprice - l_extendedprice * l_discount + l_extendedprice * l_tax, 4) AS net_amount
FROM l LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON l_partkey = p.p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey
LEFT JOIN promo ON l_partkey = promo.p_partkey AND l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' WHERE copies = 1"""

MEASURES = {
    "discount_amount": "round(l_extendedprice * l_discount, 4)",
    "tax_amount": "round(l_extendedprice * l_tax, 4)",
    "net_amount": "round(l_extendedprice - l_extendedprice * l_discount + l_extendedprice * l_tax, 4)",
}


@query("mdl_fact", FACT_SQL)
def _(t):
    from ..operators.joins import join_validity

    promo = t.part.filter("p_type = 'PROMO'").select(
        "p_partkey", F.concat(F.lit("PR-"), "p_type").alias("promotion_id"),
        F.lit("1997-01-01").cast("date").alias("s"), F.lit("1999-12-31").cast("date").alias("e"),
    )
    fact = op.build_fact(
        t.lineitem, ["l_orderkey", "l_linenumber"],
        [
            op.Dimension(t.part.filter("p_size > 5"), [("l_partkey", "p_partkey")], ["p_brand", "p_type"]),
            op.Dimension(t.supplier.filter("s_acctbal > 0"), [("l_suppkey", "s_suppkey")], ["s_name"]),
        ],
        MEASURES,
    ).accepted
    dated = fact.withColumn("ship_day", F.col("l_shipdate").cast("date"))
    out = join_validity(dated, promo, [("l_partkey", "p_partkey")], "ship_day", "s", "e", ["promotion_id"])
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_type", "s_name", "promotion_id", *MEASURES
    )


@query(
    "mdl_fact_rejects",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t):
    split = op.build_fact(t.lineitem, ["l_orderkey", "l_linenumber"], [], {})
    return split.rejected.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))


# Today's events are the orders of one day; unresolved ones come from the 30 days before. A
# customer is known from the date its segment allows.
LATE_DIM_SQL = """
WITH e AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_orderdate AS DATE) AS ds FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2000-07-01'),
d AS (SELECT c_custkey, 'C' || c_custkey AS customer_sk FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT o_orderkey, customer_sk, ds, sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(ds AS VARCHAR)) AS fact_pk, strftime(o_orderdate, '%Y%m%d') AS date_sk,
       customer_sk IS NOT NULL AS is_resolved, customer_sk IS NULL AND date_diff('day', ds, DATE '2000-07-01') >= 7 AS gave_up
FROM e LEFT JOIN d ON o_custkey = c_custkey"""


@query("mdl_fact_late_dim", LATE_DIM_SQL)
def _(t):
    today = date(2000, 7, 1)
    dated = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("ds"))
    new = dated.filter(F.col("ds") == F.lit(today))
    waiting = dated.filter(F.col("ds") < F.lit(today)).withColumn("dim_resolved_at", F.lit(None).cast("timestamp"))
    dim = t.customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("C"), "c_custkey").alias("customer_sk"),
        F.lit(datetime(1990, 1, 1)).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )
    out = op.fact_with_late_dimension(
        new, waiting, dim, "o_custkey", "o_orderdate", ["o_orderkey"], "customer_sk", today, run_time=datetime(2000, 7, 1, 6)
    )
    return out.select("o_orderkey", "customer_sk", "ds", "fact_pk", "date_sk", F.col("dim_resolved_at").isNotNull().alias("is_resolved"), "gave_up")


WIDE_SQL = """
WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem),
ship AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus <> 'P')
SELECT l_orderkey, l_linenumber, coalesce(p_name, 'UNKNOWN') AS p_name, coalesce(p_brand, 'UNKNOWN') AS p_brand, o_orderstatus, o_custkey, round(l_quantity * l_extendedprice, 2) AS line_amount
FROM l LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey LEFT JOIN ship ON l_orderkey = o_orderkey WHERE copies = 1"""


@query("mdl_wide_mart", WIDE_SQL)
def _(t):
    mart = op.wide_mart(
        t.lineitem, ["l_orderkey", "l_linenumber"],
        [op.Dimension(t.part.filter("p_size <= 40"), [("l_partkey", "p_partkey")], ["p_name", "p_brand"])],
        [op.Dimension(t.orders.filter("o_orderstatus <> 'P'"), [("l_orderkey", "o_orderkey")], ["o_orderstatus", "o_custkey"])],
        {"line_amount": "round(l_quantity * l_extendedprice, 2)"},
    ).accepted
    return mart.select("l_orderkey", "l_linenumber", "p_name", "p_brand", "o_orderstatus", "o_custkey", "line_amount")


@query(
    "mdl_reference",
    """SELECT sha256(p_brand || '|' || p_type) AS reference_id, p_brand, p_type, p_name, p_retailprice, DATE '2024-01-31' AS as_of_date FROM (
         SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) AS rn FROM part WHERE p_size > 3) WHERE rn = 1""",
)
def _(t):
    return op.publish_reference(
        t.part, ["p_brand", "p_type"], ["p_name", "p_retailprice"], date(2024, 1, 31), active="p_size > 3", order=["p_partkey desc"]
    )


# Published: one open row per nation. Incoming: periods per supplier (some overlap, some future).
VALIDITY_SQL = """
WITH pub AS (SELECT n_name AS code, DATE '2020-01-01' AS s, CAST(NULL AS DATE) AS e FROM nation WHERE n_regionkey = 0),
inc AS (SELECT s_name AS code, DATE '2021-01-01' AS s, DATE '2021-12-31' AS e FROM supplier
        UNION ALL SELECT s_name, CASE WHEN s_acctbal > 5000 THEN DATE '2021-06-01' ELSE DATE '2022-01-01' END, CAST(NULL AS DATE) FROM supplier
        UNION ALL SELECT n_name, DATE '2027-01-01', CAST(NULL AS DATE) FROM nation),
bad AS (SELECT a.code, a.s FROM inc a JOIN inc b ON a.code = b.code AND a.s <> b.s AND a.s <= coalesce(b.e, DATE '9999-12-31') AND b.s <= coalesce(a.e, DATE '9999-12-31'))
SELECT code, s, e, 'published' AS outcome FROM pub
UNION ALL SELECT code, s, e, CASE WHEN (code, s) IN (SELECT code, s FROM bad) THEN 'overlapping-validity' WHEN code IN (SELECT code FROM pub) THEN 'duplicate-key' ELSE 'published' END FROM inc"""


@query("mdl_reference_validity", VALIDITY_SQL)
def _(t):
    def period(df, name, start, end):
        return df.select(F.col(name).alias("code"), F.expr(start).cast("date").alias("s"), F.expr(end).cast("date").alias("e"))

    published = period(t.nation.filter("n_regionkey = 0"), "n_name", "DATE '2020-01-01'", "NULL")
    incoming = (
        period(t.supplier, "s_name", "DATE '2021-01-01'", "DATE '2021-12-31'")
        .unionByName(period(t.supplier, "s_name", "CASE WHEN s_acctbal > 5000 THEN DATE '2021-06-01' ELSE DATE '2022-01-01' END", "NULL"))
        .unionByName(period(t.nation, "n_name", "DATE '2027-01-01'", "NULL"))
    )
    split = op.publish_reference_validity(published, incoming, ["code"], "s", "e", reason="outcome")
    return split.accepted.withColumn("outcome", F.lit("published")).unionByName(split.rejected)


@query(
    "mdl_reference_versioned",
    "SELECT p_partkey, p_name, 1 AS version FROM part UNION ALL SELECT p_partkey, upper(p_name), 2 FROM part",
)
def _(t):
    columns = ["p_partkey", "p_name"]
    first = op.publish_version(None, t.part, columns)
    unchanged = op.publish_version(first, t.part.repartition(3, "p_name"), columns)
    if unchanged is not None:
        first = first.unionByName(unchanged)
    second = op.publish_version(first, t.part.withColumn("p_name", F.upper("p_name")), columns)
    return first.unionByName(second)


# A reply tree: every turn answers the turn before, the first turn of a conversation is a root.
@query("mdl_hierarchy_depth", "SELECT conv_id || '-' || turn AS node, CAST(turn AS BIGINT) AS depth FROM conversations")
def _(t):
    rows = t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("node"), F.expr("CASE WHEN turn > 0 THEN concat_ws('-', conv_id, turn - 1) END").alias("parent")
    )
    return op.hierarchy_depth(rows, "node", "parent").select("node", "depth")


@query(
    "mdl_data_vault",
    """SELECT 'hub' AS part, sha256(CAST(c_custkey AS VARCHAR)) AS hk, CAST(c_custkey AS VARCHAR) AS detail FROM customer
       UNION ALL SELECT 'link', sha256(o_custkey || '|' || o_orderkey), sha256(CAST(o_custkey AS VARCHAR)) || sha256(CAST(o_orderkey AS VARCHAR)) FROM orders
       UNION ALL SELECT 'satellite', sha256(CAST(o_custkey AS VARCHAR)), d || ' ' || p FROM (
         SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, min(o_orderpriority) AS p, lag(min(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS b
         FROM orders GROUP BY 1, 2) WHERE b IS NULL OR b <> p""",
)
def _(t):
    now = F.lit("2024-01-31").cast("date")
    hub = op.hub(t.customer, "customer", ["c_custkey"], now, "erp").select(
        F.lit("hub").alias("part"), F.col("customer_hk").alias("hk"), F.col("c_custkey").cast("string").alias("detail")
    )
    link = op.link(t.orders, "placed", {"customer": ["o_custkey"], "order": ["o_orderkey"]}, now, "erp").select(
        F.lit("link").alias("part"), F.col("placed_hk").alias("hk"), F.concat("customer_hk", "order_hk").alias("detail")
    )
    staged = t.orders.select("o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    sat = op.satellite(staged, "customer", ["o_custkey"], ["o_orderpriority"], "day").select(
        F.lit("satellite").alias("part"), F.col("customer_hk").alias("hk"), F.concat_ws(" ", F.col("load_date").cast("string"), "o_orderpriority").alias("detail")
    )
    return hub.unionByName(link).unionByName(sat)


@query(
    "mdl_feature_publish",
    f"SELECT user_id, CAST(cutoff AS DATE) AS as_of_date, events_30d, value_30d, errors_30d FROM ({FEATURES_SQL})",
)
def _(t):
    return feature_table(t).select("user_id", F.col("cutoff").cast("date").alias("as_of_date"), "events_30d", "value_30d", "errors_30d")


@query(
    "mdl_date_dim",
    """SELECT o_orderkey, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
              CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, strftime(d, '%a') AS day_name_short, strftime(d, '%A') AS day_name,
              CAST(weekofyear(d) AS INTEGER) AS iso_week, CAST(date_trunc('month', d) AS DATE) AS month_start_date, last_day(d) AS month_end_date,
              CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end_date, CAST(date_trunc('year', d) AS DATE) AS year_start_date,
              CAST(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS year_end_date, dayofweek(d) IN (0, 6) AS is_weekend
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def _(t):
    days = op.date_dimension(t.spark)
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("calendar_date"))
    return rows.join(F.broadcast(days), "calendar_date").drop("calendar_date", "iso_date", "quarter_start_date")
