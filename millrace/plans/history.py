"""History and merge queries. Change sets are derived from the tables by business predicates."""

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import history as op
from ..operators import merge
from .registry import query

RUN = datetime(2024, 2, 1)
START = datetime(2024, 1, 1)


def customers(t):
    return t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")


def customers_next(t):
    """Second load: no household customers, buildings gain 10, some keys are new."""
    kept = customers(t).filter("c_mktsegment <> 'HOUSEHOLD'").withColumn(
        "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal"))
    )
    new = t.supplier.select(
        (F.col("s_suppkey") + 100000000).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal")
    )
    return kept.unionByName(new)


def _scd2_sql(hard_delete: bool) -> str:
    gone_end = "TIMESTAMP '2024-02-01'" if hard_delete else "CAST(NULL AS TIMESTAMP)"
    return f"""
SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, TIMESTAMP '2024-01-01' AS valid_from,
       CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-02-01' WHEN c_mktsegment = 'HOUSEHOLD' THEN {gone_end} END AS valid_to FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, round(c_acctbal + 10, 2), TIMESTAMP '2024-02-01', NULL FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT s_suppkey + 100000000, 'SUPPLIER', round(s_acctbal, 2), TIMESTAMP '2024-02-01', NULL FROM supplier"""


def _shown(history):
    return history.select(
        "c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), F.col("valid_from").cast("timestamp_ntz").alias("valid_from"),
        F.col("valid_to").cast("timestamp_ntz").alias("valid_to"),
    )


@query("hist_scd2_check", _scd2_sql(False))
def _(t):
    base = op.start_history(customers(t), ["c_custkey"], F.lit(START))
    return _shown(op.track_history(base, customers_next(t), ["c_custkey"], ["c_mktsegment", "c_acctbal"], RUN))


@query("hist_scd2_hard_delete", _scd2_sql(True))
def _(t):
    base = op.start_history(customers(t), ["c_custkey"], F.lit(START))
    return _shown(
        op.track_history(base, customers_next(t), ["c_custkey"], ["c_mktsegment", "c_acctbal"], RUN, invalidate_hard_deletes=True)
    )


@query(
    "hist_scd2_timestamp",
    """SELECT o_orderkey, o_orderstatus AS state, TIMESTAMP '1995-01-01' AS valid_from, CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN o_orderdate END AS valid_to FROM orders
       UNION ALL SELECT o_orderkey, 'Z', o_orderdate, NULL FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'""",
)
def _(t):
    first = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("state"), F.lit(datetime(1995, 1, 1)).alias("changed_at"))
    base = op.start_history(first, ["o_orderkey"], F.col("changed_at"))
    # The second load repeats the old rows and brings a later state for the newer orders.
    newer = F.col("o_orderdate") > F.lit(datetime(1998, 1, 1))
    second = t.orders.select(
        "o_orderkey", F.when(newer, F.lit("Z")).otherwise(F.col("o_orderstatus")).alias("state"),
        F.when(newer, F.col("o_orderdate").cast("timestamp")).otherwise(F.lit(datetime(1995, 1, 1))).alias("changed_at"),
    )
    out = op.track_history(base, second, ["o_orderkey"], ["state"], RUN, strategy="timestamp", updated_at="changed_at")
    return out.select(
        "o_orderkey", "state", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("valid_to").cast("timestamp_ntz").alias("valid_to")
    )


# One snapshot per customer and order day: the best priority of that day.
EFFECTIVE_SQL = """
WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderpriority) AS p FROM orders GROUP BY 1, 2),
c AS (SELECT *, lag(p) OVER (PARTITION BY o_custkey ORDER BY d) AS b FROM s),
k AS (SELECT * FROM c WHERE b IS NULL OR b <> p)
SELECT o_custkey, p AS priority, d AS effective_start, CAST(lead(d) OVER (PARTITION BY o_custkey ORDER BY d) - INTERVAL 1 DAY AS DATE) AS effective_end,
       lead(d) OVER (PARTITION BY o_custkey ORDER BY d) IS NULL AS is_current FROM k"""


@query("hist_scd2_effective", EFFECTIVE_SQL)
def _(t):
    snapshots = t.orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("d")).agg(F.min("o_orderpriority").alias("priority"))
    return op.effective_history(snapshots, ["o_custkey"], ["priority"], "d")


@query(
    "hist_scd2_same_day",
    """WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS effective_start, o_orderpriority AS priority FROM orders
         QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
       c AS (SELECT * FROM d QUALIFY lag(priority) OVER (PARTITION BY o_custkey ORDER BY effective_start) IS DISTINCT FROM priority)
       SELECT o_custkey, priority, effective_start, CAST(lead(effective_start) OVER w - INTERVAL 1 DAY AS DATE) AS effective_end, lead(effective_start) OVER w IS NULL AS is_current
       FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY effective_start)""",
)
def _(t):
    # Several orders of a customer on one day: the last of the day counts.
    snapshots = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("priority"))
    return op.effective_history(snapshots, ["o_custkey"], ["priority"], "d", tie_break=["o_orderkey"])


BITEMPORAL_SQL = """
WITH r AS (SELECT o_custkey, o_orderdate AS eff, o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders),
k AS (SELECT * FROM r WHERE rn = 1)
SELECT o_custkey, o_orderkey, o_totalprice, eff AS valid_from, lead(eff) OVER w AS valid_to, lead(eff) OVER w IS NULL AS current_flag, row_number() OVER w AS version
FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY eff)"""


@query("hist_bitemporal", BITEMPORAL_SQL)
def _(t):
    rows = t.orders.select("o_custkey", F.col("o_orderdate").alias("eff"), "o_orderkey", "o_totalprice")
    # The whole history arrives twice: repeated runs change nothing.
    out = op.bitemporal_history(rows.unionByName(rows), ["o_custkey"], "eff", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "o_totalprice", "valid_from", "valid_to", "current_flag", "version")


@query(
    "hist_snapshot",
    """SELECT s_suppkey, s_acctbal, DATE '2024-01-02' AS ds, 'run-3' AS snapshot_run_id FROM supplier UNION ALL SELECT s_suppkey, s_acctbal + 1, DATE '2024-01-03', 'run-2' FROM supplier""",
)
def _(t):
    from ..session import scratch_path
    from ..sinks.tables import overwrite_partitions

    path = scratch_path(t.spark, "snapshots")
    rows = t.supplier.select("s_suppkey", "s_acctbal")
    loads = [(date(2023, 12, 1), "run-0", rows), (date(2024, 1, 2), "run-1", rows.withColumn("s_acctbal", F.lit(0.0))),
             (date(2024, 1, 3), "run-2", rows.withColumn("s_acctbal", F.col("s_acctbal") + 1)), (date(2024, 1, 2), "run-3", rows)]
    for day, run, frame in loads:
        overwrite_partitions(op.periodic_snapshot(frame, day, run), path, ["ds"])
    return op.retain_snapshots(t.spark.read.parquet(path), date(2024, 1, 3), 30)


@query(
    "hist_snapshot_diff",
    """SELECT c_custkey, 'removed' AS change FROM customer WHERE c_mktsegment = 'HOUSEHOLD' UNION ALL SELECT c_custkey, 'changed' FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT s_suppkey + 100000000, 'added' FROM supplier""",
)
def _(t):
    return op.snapshot_diff(customers(t), customers_next(t), ["c_custkey"], ["c_mktsegment", "c_acctbal"])


# -- mrg_* --------------------------------------------------------------------


def order_delta(t):
    """Two updates for every urgent order (the later one counts) and copies under new keys."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    first = urgent.withColumns({"o_totalprice": F.lit(-1.0), "seq": F.lit(1)})
    second = urgent.withColumns({"o_totalprice": F.col("o_totalprice") + 5, "seq": F.lit(2)})
    new = urgent.withColumns({"o_orderkey": F.col("o_orderkey") + 100000000, "seq": F.lit(1)})
    return first.unionByName(second).unionByName(new)


def order_target(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


UPSERT_SQL = """
SELECT o_orderkey, o_custkey, round(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 5 ELSE o_totalprice END, 2) AS o_totalprice, o_orderdate FROM orders
UNION ALL SELECT o_orderkey + 100000000, o_custkey, round(o_totalprice, 2), o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'"""


@query("mrg_upsert", UPSERT_SQL)
def _(t):
    out = merge.upsert(order_target(t), order_delta(t), ["o_orderkey"], ["seq desc"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "mrg_strategies",
    """SELECT 'append' AS strategy, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
         UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey + 100000000 FROM orders WHERE o_orderpriority = '1-URGENT')
       UNION ALL SELECT 'delete_insert', count(*), count(DISTINCT k) FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
         UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey + 100000000 FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(t):
    parts = [
        merge.upsert(order_target(t), order_delta(t), ["o_orderkey"], ["seq desc"], strategy=s)
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys")).withColumn("strategy", F.lit(s))
        for s in ("append", "delete_insert")
    ]
    return parts[0].unionByName(parts[1])


def customer_changes(t):
    """Furniture customers are deleted (after an update), buildings updated, suppliers inserted."""
    c = customers(t)
    update = c.filter("c_mktsegment IN ('BUILDING', 'FURNITURE')").withColumns(
        {"c_acctbal": F.col("c_acctbal") + 1, "op": F.lit("UPSERT"), "seq": F.lit(1)}
    )
    delete = c.filter("c_mktsegment = 'FURNITURE'").withColumns({"c_acctbal": F.lit(None).cast("double"), "op": F.lit("DELETE"), "seq": F.lit(2)})
    insert = t.supplier.select(
        (F.col("s_suppkey") + 100000000).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit("UPSERT").alias("op"), F.lit(1).alias("seq"),
    )
    return update.unionByName(delete).unionByName(insert)


CDC_STATE = """
SELECT c_custkey, c_mktsegment, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal{flag0} FROM customer WHERE {keep}
UNION ALL SELECT s_suppkey + 100000000, 'SUPPLIER', round(s_acctbal, 2){flag1} FROM supplier"""


@query("mrg_cdc", CDC_STATE.format(flag0="", flag1="", keep="c_mktsegment <> 'FURNITURE'"))
def _(t):
    out = merge.apply_changes(customers(t), customer_changes(t), ["c_custkey"], "op", ["seq"]).state
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    "mrg_cdc_truncate",
    """SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'
       UNION ALL SELECT s_suppkey + 100000000, 'SUPPLIER', round(s_acctbal, 2) FROM supplier""",
)
def _(t):
    # The table is emptied after the first changes; machinery and suppliers come (back) afterwards.
    early = customer_changes(t).filter("c_mktsegment <> 'SUPPLIER'")
    back = customers(t).filter("c_mktsegment = 'MACHINERY'").withColumns({"op": F.lit("UPSERT"), "seq": F.lit(4)})
    late = customer_changes(t).filter("c_mktsegment = 'SUPPLIER'").withColumn("seq", F.lit(4))
    emptied = t.region.agg(F.lit(None).cast("long").alias("c_custkey"), F.lit("TRUNCATE").alias("op"), (F.count(F.lit(1)) * 0 + 3).cast("int").alias("seq"))
    changes = early.unionByName(back).unionByName(late).unionByName(emptied, allowMissingColumns=True)
    out = merge.apply_changes(customers(t), changes, ["c_custkey"], "op", ["seq"]).state
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    "mrg_cdc_report",
    """SELECT c_custkey, 'updated' AS action FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'deleted' FROM customer WHERE c_mktsegment = 'FURNITURE'
       UNION ALL SELECT s_suppkey + 100000000, 'inserted' FROM supplier""",
)
def _(t):
    return merge.apply_changes(customers(t), customer_changes(t), ["c_custkey"], "op", ["seq"]).report


@query("mrg_initial_snapshot", CDC_STATE.format(flag0="", flag1="", keep="c_mktsegment <> 'FURNITURE'"))
def _(t):
    empty = customers(t).filter("c_custkey IS NULL")
    out = merge.bootstrap_or_apply(empty, customers(t), customer_changes(t), ["c_custkey"], "op", ["seq"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    "mrg_soft_delete",
    CDC_STATE.format(flag0=", c_mktsegment = 'FURNITURE' AS is_deleted", flag1=", false", keep="true"),
)
def _(t):
    out = merge.apply_changes(customers(t), customer_changes(t), ["c_custkey"], "op", ["seq"], deletes="soft_delete").state
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("mrg_watermark", "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) <= DATE '2024-01-20')")
def _(t):
    loaded = t.events.filter("event_type = 'signup' AND CAST(ts AS DATE) <= DATE '2024-01-20'")
    mark = merge.high_water(loaded, "ts")
    return merge.newer_than(t.events.select("event_id", "ts"), "ts", mark)


LATE_ARRIVAL = "ts + make_dt_interval(0, cast(value as int), 0, 0)"


@query(
    "mrg_late_policy",
    """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, CAST(trunc(value) AS INTEGER) > 72 AS late FROM events)
       SELECT 'flagged' AS outcome, d, count(*) AS n FROM e WHERE late GROUP BY 2 UNION ALL SELECT 'on_time', d, count(*) FROM e WHERE NOT late GROUP BY 2
       UNION ALL SELECT 'recompute', d, 1 FROM (SELECT DISTINCT d FROM e WHERE late)
       UNION ALL SELECT 'quarantined', d, count(*) FROM e WHERE late GROUP BY 2""",
)
def _(t):
    rows = t.events.withColumn("arrived_at", F.expr(LATE_ARRIVAL))
    kept = merge.late_policy(rows, "ts", "arrived_at", "recompute")
    held = merge.late_policy(rows, "ts", "arrived_at", "quarantine")

    def per_day(df, outcome):
        return df.groupBy(F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n")).select(outcome.alias("outcome"), "d", "n")

    flagged = kept.accepted.groupBy(F.col("ts").cast("date").alias("d"), "is_late").agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("is_late"), "flagged").otherwise("on_time").alias("outcome"), "d", "n"
    )
    rebuilt = kept.recompute.select(F.lit("recompute").alias("outcome"), F.col("ds").alias("d"), F.lit(1).cast("long").alias("n"))
    return flagged.unionByName(rebuilt).unionByName(per_day(held.quarantined, F.lit("quarantined")))
