"""Projection and value queries."""

from pyspark.sql import functions as F

from ..operators import columns as op
from .registry import query

# -- prj_* --------------------------------------------------------------------


@query("prj_add_column", "SELECT *, round(o_totalprice * 1.08, 4) AS gross FROM orders")
def _(t):
    return op.add_column(op.add_column(t.orders, "gross", "round(o_totalprice * 1.08, 4)"))


@query(
    "prj_derive",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
              l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate,
              round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem""",
)
def _(t):
    return op.derive(
        t.lineitem,
        {"l_shipdate": "CAST(l_shipdate AS DATE)", "charge": "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)"},
        drop=["l_shipdate", "l_tax"],
    )


@query(
    "prj_transform_values",
    "SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, abs(c_acctbal) AS c_acctbal, c_mktsegment FROM customer",
)
def _(t):
    return op.transform_values(t.customer, {"c_name": "upper(c_name)", "c_acctbal": "abs(c_acctbal)"})


@query("prj_keep", "SELECT o_orderpriority, o_orderkey FROM orders")
def _(t):
    return op.keep(t.orders, ["o_orderpriority", "o_orderkey"])


@query("prj_drop", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(t):
    return op.drop(t.orders, ["o_orderpriority", "not_there"])


@query(
    "prj_rename",
    "SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(t):
    return op.rename(t.customer, {"c_custkey": "customer_id", "c_name": "customer_name"})


@query(
    "prj_cast",
    """SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
              CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part""",
)
def _(t):
    return op.cast_columns(t.part, {"p_partkey": "int", "p_size": "bigint", "p_retailprice": "string"})


@query(
    "prj_try_cast",
    """SELECT doc_id, lang, TRY_CAST(substr(source, 4) AS BIGINT) AS number, TRY_CAST(source AS BIGINT) AS source_id,
              'source_id' AS failed, true AS has_cast_failure FROM documents""",
)
def _(t):
    raw = t.documents.select("doc_id", "lang", F.substring("source", 4, 20).alias("number"), F.col("source").alias("source_id"))
    out = op.try_cast_columns(raw, {"number": "bigint", "source_id": "bigint"})
    return out.select("doc_id", "lang", "number", "source_id", F.concat_ws(",", "cast_failures").alias("failed"), "has_cast_failure")


@query("prj_trim", "SELECT n_nationkey, n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def _(t):
    padded = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_nationkey", F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("n_name"), "c_custkey"
    )
    return op.trim(padded, ["n_name"])


@query(
    "prj_fill_nulls",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS status,
              CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS price FROM orders""",
)
def _(t):
    holes = t.orders.select(
        "o_orderkey",
        F.expr("nullif(o_orderstatus, 'P')").alias("status"),
        F.expr("CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END").alias("price"),
    )
    return op.fill_nulls(holes, {"status": "unknown", "price": 0.0})


CLEAN_SQL = """
WITH shaped AS (
  SELECT lower(trim(o_orderpriority)) AS priority, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_day,
         o_totalprice, o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status
  FROM orders),
kept AS (SELECT * FROM shaped WHERE status IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id, order_day ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM kept)
SELECT priority, customer_id, order_day, o_totalprice, o_orderkey, status FROM ranked WHERE rn = 1"""


@query("prj_clean", CLEAN_SQL)
def _(t):
    raw = t.orders.select(
        F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit("  ")).alias("priority"),
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey",
        F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.lit("x").alias("junk"),
    )
    return op.clean(
        raw,
        trim_columns=["priority"],
        names={"o_custkey": "customer_id", "o_orderdate": "order_day"},
        types={"order_day": "date"},
        drop_columns=["junk"],
        required=["status"],
        dedupe_keys=["customer_id", "order_day"],
        dedupe_order=["o_totalprice desc", "o_orderkey"],
    )


# Contacts are made of whole tables: an address from the name, a phone from key and balance.
CONTACTS_SQL = """
WITH raw AS (
  SELECT c_custkey, c_name,
         CASE WHEN c_acctbal < 0 THEN replace(c_name, '#', '.') ELSE replace(c_name, '#', '@') || '.Example.COM' END AS email,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'ext 12' ELSE '+1 (212) ' || substr(c_name, 12, 3) || '-' || substr(c_name, 15, 4) END AS phone,
         c_mktsegment AS state FROM customer),
norm AS (
  SELECT c_custkey, c_name, lower(trim(email)) AS email, regexp_replace(phone, '[^0-9]', '', 'g') AS phone, phone AS raw_phone, upper(trim(state)) AS state FROM raw),
judged AS (
  SELECT *, NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS bad_email,
         (raw_phone <> '' AND length(phone) NOT IN (10, 11)) AS bad_phone FROM norm)
SELECT c_custkey, c_name, email, phone, state,
       CASE WHEN bad_email AND bad_phone THEN 'invalid_email:email,invalid_phone:phone'
            WHEN bad_email THEN 'invalid_email:email' WHEN bad_phone THEN 'invalid_phone:phone' ELSE '' END AS reasons
FROM judged"""


@query("prj_standardize", CONTACTS_SQL)
def _(t):
    raw = t.customer.select(
        "c_custkey",
        F.concat(F.lit(" "), "c_name").alias("c_name"),
        F.expr(
            "CASE WHEN c_acctbal < 0 THEN replace(c_name, '#', '.') ELSE concat(' ', replace(c_name, '#', '@'), '.Example.COM ') END"
        ).alias("email"),
        F.expr(
            "CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'ext 12' "
            "ELSE concat('+1 (212) ', substr(c_name, 12, 3), '-', substr(c_name, 15, 4)) END"
        ).alias("phone"),
        F.lower("c_mktsegment").alias("state"),
    )
    split = op.standardize(raw, trim_columns=["c_name"], upper=["state"], emails=["email"], phones=["phone"])
    good = split.accepted.withColumn("reasons", F.lit(""))
    bad = split.rejected.withColumn("reasons", F.concat_ws(",", "reject_reasons")).drop("reject_reasons")
    return good.unionByName(bad)


@query(
    "prj_null_policy",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS kept,
              CASE WHEN o_totalprice > 300000 THEN -1.0 ELSE o_totalprice END AS coerced, o_orderstatus AS required
       FROM orders WHERE o_orderstatus <> 'F'""",
)
def _(t):
    holes = t.orders.select(
        "o_orderkey",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("kept"),
        F.expr("CASE WHEN o_totalprice <= 300000 THEN o_totalprice END").alias("coerced"),
        F.expr("nullif(o_orderstatus, 'F')").alias("required"),
    )
    return op.null_policy(holes, {"kept": "keep", "coerced": {"value": -1.0}, "required": "drop"})


@query(
    "prj_contract",
    "SELECT CAST(p_partkey AS VARCHAR) AS part_id, p_name AS part_name, CAST(p_size AS DOUBLE) AS size_cm FROM part",
)
def _(t):
    return op.contract(
        t.part,
        [
            {"name": "part_id", "source": "p_partkey", "type": "string"},
            {"name": "part_name", "source": "p_name"},
            {"name": "size_cm", "source": "p_size", "type": "double"},
        ],
    )


@query(
    "prj_contract_values",
    """SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus = 'F' AS is_closed,
              upper(o_orderpriority) AS priority, CAST(o_custkey AS INTEGER) AS customer_id
       FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
)
def _(t):
    raw = t.orders.select(
        F.col("o_orderkey").alias("Order Id"),
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN date_format(o_orderdate, 'MM/dd/yyyy') "
            "WHEN 'O' THEN date_format(o_orderdate, 'dd-MMM-yyyy') ELSE date_format(o_orderdate, 'yyyy/MM/dd') END"
        ).alias("Order Date"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN ' Y' ELSE 'false ' END").alias("Closed"),
        F.lower("o_orderpriority").alias("Priority"),
        F.expr("CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'thirty' ELSE concat(' ', o_custkey) END").alias("Customer"),
    )
    return op.contract_values(
        raw,
        [
            {"name": "order_id", "source": "Order Id", "type": "bigint"},
            {"name": "order_date", "source": "Order Date", "type": "date"},
            {"name": "is_closed", "source": "Closed", "type": "boolean"},
            {"name": "priority", "source": "Priority", "upper": True},
            {"name": "customer_id", "source": "Customer", "type": "int"},
        ],
    ).accepted


@query(
    "prj_lookup_standardize",
    """SELECT c_custkey, coalesce(CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name END, 'OTHER') AS region
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"))
    lookup = t.region.filter("r_name IN ('ASIA', 'EUROPE')")
    rows = rows.withColumn("region", F.col("region").cast("string"))
    lookup = lookup.withColumn("r_regionkey", F.col("r_regionkey").cast("string"))
    return op.lookup_standardize(rows, "region", lookup, "r_regionkey", "r_name").accepted


@query(
    "prj_surrogate_key",
    """SELECT l_orderkey, l_linenumber, sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' ||
              coalesce(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END, '<null>')) AS line_sk FROM lineitem""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.expr("nullif(l_returnflag, 'N')").alias("flag"))
    return op.add_surrogate_key(rows, "line_sk", ["l_orderkey", "l_linenumber", "flag"]).drop("flag")
