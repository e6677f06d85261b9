"""Sort, limit, sample, set and SQL chain queries."""

from pyspark.sql import functions as F

from ..operators import sets as op
from .registry import query


@query("srt_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC")
def _(t):
    return op.sort(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", "o_totalprice desc"])


@query(
    "srt_limit",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 1000",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return op.limit(rows, order=["l_extendedprice desc", "l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "srt_sample",
    "SELECT o_orderkey, o_custkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.1",
)
def _(t):
    return op.sample(t.orders.select("o_orderkey", "o_custkey"), 10, key="o_orderkey")


@query(
    "set_union_all",
    "SELECT c_nationkey AS nation_key, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier",
)
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("nation_key"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation_key"))
    return op.union_all([a, b], positional=False)


@query(
    "set_union_positional",
    "SELECT c_nationkey AS nation_key, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier",
)
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("nation_key"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    return op.union_all([a, t.supplier.select("s_nationkey", "s_acctbal", F.lit("supplier"))])


@query(
    "set_union_distinct",
    "SELECT l_partkey AS k, l_returnflag AS f FROM lineitem UNION SELECT p_partkey, 'A' FROM part",
)
def _(t):
    a = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("f"))
    return op.union_distinct([a, t.part.select("p_partkey", F.lit("A"))])


@query(
    "sql_chain",
    """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM big GROUP BY o_custkey)
       SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS orders, round(max(total), 2) AS best FROM per JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def _(t):
    return op.sql_chain(
        t.orders,
        [
            ("big orders", "SELECT * FROM input WHERE o_totalprice > 100000"),
            ("blank", "  "),
            ("per", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM big_orders GROUP BY o_custkey"),
            ("out", "SELECT c_mktsegment, sum(n) AS orders, round(max(total), 2) AS best FROM per JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
        ],
        {"customer": t.customer},
    )


@query(
    "sql_chain_set_ops",
    """SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'
       EXCEPT SELECT p_partkey FROM part WHERE p_type = 'PROMO'""",
)
def _(t):
    return op.sql_chain(
        t.lineitem,
        [
            ("returned", "SELECT DISTINCT l_partkey AS k FROM input WHERE l_returnflag = 'R'"),
            ("accepted", "SELECT DISTINCT l_partkey AS k FROM input WHERE l_returnflag = 'A'"),
            ("out", "SELECT k FROM returned INTERSECT SELECT k FROM accepted EXCEPT SELECT p_partkey AS k FROM part WHERE p_type = 'PROMO'"),
        ],
        {"part": t.part},
    )
