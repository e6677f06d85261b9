"""Source and sink queries: round trips through the shared folder, load patterns, manifests."""

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sinks import kafka, tables
from ..sources import files, loads
from .registry import query

ORDER_KEYS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "src_files",
    " UNION ALL ".join(
        f"SELECT '{f}' AS format, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders" for f in ("parquet", "orc", "json", "csv", "unknown")
    ),
)
def _(t):
    rows = t.orders.select(*ORDER_KEYS)
    out = None
    for fmt in ("parquet", "orc", "json", "csv", "unknown"):
        path = scratch_path(t.spark, f"files-{fmt}")
        real = "parquet" if fmt == "unknown" else fmt
        tables.write_files(rows, path, fmt=real, options={"header": "true"} if real == "csv" else None)
        back = files.read_files(t.spark, path, fmt, schema=rows.schema if fmt in ("json", "csv") else None)
        one = back.select(F.lit(fmt).alias("format"), *ORDER_KEYS)
        out = one if out is None else out.unionByName(one)
    return out


CSV_SCHEMA = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType()), T.StructField("status", T.StringType()),
])


@query(
    "src_csv_tolerant",
    """SELECT o_orderkey AS k, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, 'row' AS outcome FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT NULL, NULL, NULL, NULL, 'corrupt' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT NULL, NULL, NULL, NULL, 'bad_file' FROM orders HAVING count(*) > 0""",
)
def _(t):
    good, other = scratch_path(t.spark, "csv"), scratch_path(t.spark, "csv-other")
    lines = t.orders.select(
        F.col("o_orderkey").alias("k"), F.expr("CASE WHEN o_orderstatus = 'P' THEN 'not-a-number' ELSE cast(o_totalprice AS string) END").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"),
    )
    tables.write_files(lines, good, fmt="csv", options={"header": "true"})
    tables.write_files(lines.repartitionByRange("k").withColumnRenamed("day", "date"), other, fmt="csv", options={"header": "true"})
    load = files.read_tolerant_csv(t.spark, [good, other], CSV_SCHEMA)
    out = load.accepted.withColumn("outcome", F.lit("row"))
    out = out.unionByName(load.rejected.select(F.lit("corrupt").alias("outcome")), allowMissingColumns=True)
    return out.unionByName(load.bad_files.select(F.lit("bad_file").alias("outcome")), allowMissingColumns=True)


@query(
    "src_snapshot",
    """SELECT s_suppkey, s_acctbal, CAST(ds AS DATE) AS ds, 'loaded' AS outcome FROM (SELECT s_suppkey, s_acctbal, DATE '2024-05-01' AS ds FROM supplier UNION ALL SELECT s_suppkey, s_acctbal - 1, DATE '2024-05-02' FROM supplier WHERE s_acctbal > 0)
       UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'no_asof' FROM supplier""",
)
def _(t):
    path = scratch_path(t.spark, "snapshot")

    def extract(rows, day):
        return rows.select("s_suppkey", "s_acctbal", F.lit(day).cast("timestamp").alias("as_of"))

    first = extract(t.supplier, datetime(2024, 5, 1))
    second = extract(t.supplier.filter("s_acctbal > 0").withColumn("s_acctbal", F.col("s_acctbal") - 1), datetime(2024, 5, 2))
    missing = extract(t.supplier, None)
    for rows in (first, second, second):  # the second extract runs twice
        tables.overwrite_partitions(loads.snapshot_extract(rows, "as_of").accepted, path, ["ds"])
    loaded = t.spark.read.parquet(path).select("s_suppkey", "s_acctbal", F.col("ds").cast("date").alias("ds"), F.lit("loaded").alias("outcome"))
    rejected = loads.snapshot_extract(missing, "as_of").rejected
    return loaded.unionByName(rejected.select("s_suppkey", "s_acctbal", F.lit(None).cast("date").alias("ds"), F.lit("no_asof").alias("outcome")))


@query(
    "src_incremental_poll",
    "SELECT event_id, ts, (SELECT max(ts) FROM events) AS new_mark FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'",
)
def _(t):
    batch = loads.poll(t.events.select("event_id", "ts"), "ts", datetime(2024, 1, 20))
    return batch.rows.withColumn("new_mark", F.lit(batch.mark).cast("timestamp_ntz"))


@query(
    "src_backfill_chunks",
    """SELECT CAST(date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) // 30 AS INTEGER) AS chunk_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, 'loaded' AS kind FROM orders
         WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1
       UNION ALL SELECT CAST(i AS INTEGER), 30 - CASE WHEN i = 36 THEN 14 ELSE 0 END, NULL, 'planned' FROM range(0, 37) r(i)""",
)
def _(t):
    start, end, path = date(1996, 1, 1), date(1998, 12, 31), scratch_path(t.spark, "backfill")
    tables.overwrite_partitions(loads.with_chunk(t.orders, "o_orderdate", start, end, 30), path, ["chunk_id"])
    loaded = t.spark.read.parquet(path).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
    planned = loads.plan_chunks(t.spark, start, end, 30).select(
        "chunk_id", (F.datediff("chunk_end", "chunk_start") + 1).cast("long").alias("n"), F.lit(None).cast("long").alias("key_sum"), F.lit("planned").alias("kind")
    )
    return loaded.withColumn("kind", F.lit("loaded")).unionByName(planned)


@query(
    "src_missing_periods",
    """SELECT m AS period FROM (SELECT strftime(d, '%Y-%m') AS m FROM range(DATE '1994-10-01', DATE '1995-07-01', INTERVAL 1 MONTH) r(d)) WHERE m NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders)""",
)
def _(t):
    months = [f"1994-{m:02d}" for m in (10, 11, 12)] + [f"1995-{m:02d}" for m in range(1, 7)]
    return loads.missing_periods(t.orders, F.date_format("o_orderdate", "yyyy-MM"), months)


@query("src_duplicate_rows", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return loads.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


PAGE = "meta STRUCT<page: BIGINT>, data ARRAY<STRUCT<word: STRING, pos: INT>>"


@query(
    "src_paged_json",
    "SELECT w AS word, CAST(i AS INTEGER) AS pos FROM (SELECT unnest(string_split(url, '/')) AS w, unnest(range(len(string_split(url, '/')))) AS i FROM pages) WHERE i > 2",
)
def _(t):
    words = F.split("url", "/")
    items = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    body = F.to_json(F.struct(F.struct(F.col("page_id").alias("page")).alias("meta"), items.alias("data")))
    responses = t.pages.select(body.alias("value"))
    return files.explode_pages(responses, "value", PAGE, "data", incremental="pos", after=2)


@query(
    "src_fan_in",
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS source, event_id,
              row_number() OVER (PARTITION BY CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END ORDER BY ts) AS position FROM events""",
)
def _(t):
    named = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    parts = {k: t.events.filter(F.col("event_type") == k) for k in ("click", "view")} | {"other": t.events.filter(~named)}
    return files.fan_in(parts, "interleave", order="ts").select("source", "event_id", "position")


@query(
    "src_fan_in_union",
    "SELECT 'customer' AS source, c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return files.fan_in({"customer": a, "supplier": b})


@query(
    "src_evolution",
    """SELECT 'add_columns' AS policy, c_custkey AS k, c_nationkey AS nation, NULL AS extra FROM customer UNION ALL SELECT 'add_columns', s_suppkey, s_nationkey, s_name FROM supplier
       UNION ALL SELECT 'log_and_skip', c_custkey, c_nationkey, NULL FROM customer UNION ALL SELECT 'log_and_skip', s_suppkey, s_nationkey, NULL FROM supplier""",
)
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    new = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_name").alias("extra"))
    added = files.evolve_union(base, new, "add_columns").withColumn("policy", F.lit("add_columns"))
    skipped = files.evolve_union(base, new, "log_and_skip").withColumns({"policy": F.lit("log_and_skip"), "extra": F.lit(None).cast("string")})
    return added.unionByName(skipped)


@query(
    "src_infer_types",
    """WITH x AS (SELECT CAST(o_orderkey AS VARCHAR) AS "key", printf('%.2f', o_totalprice) AS amount, CASE WHEN o_orderstatus = 'F' THEN '-3' ELSE printf('%.2f', o_totalprice) END AS mixed,
                  strftime(o_orderdate, '%Y-%m-%d') AS "day", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "at",
                  CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'false' ELSE '' END AS flag, o_orderpriority AS word,
                  CASE WHEN o_orderstatus = 'F' THEN '12' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS odd FROM orders),
       u AS (UNPIVOT x ON COLUMNS(*) INTO NAME column_name VALUE v),
       k AS (SELECT column_name, CASE WHEN v = '' THEN NULL WHEN regexp_full_match(v, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '-?[0-9]+[.][0-9]+') THEN 'decimal'
                    WHEN TRY_CAST(v AS DATE) IS NOT NULL AND length(v) = 10 THEN 'date' WHEN TRY_CAST(v AS TIMESTAMP) IS NOT NULL THEN 'timestamp'
                    WHEN lower(v) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind FROM u),
       g AS (SELECT column_name, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds, count(*) FILTER (kind IS NULL) > 0 AS is_nullable FROM k GROUP BY 1)
       SELECT column_name, CASE WHEN len(kinds) = 1 THEN kinds[1] WHEN kinds = ['decimal', 'integer'] THEN 'decimal' ELSE 'string' END AS inferred_type, is_nullable FROM g""",
)
def _(t):
    texts = t.orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.format_string("%.2f", "o_totalprice").alias("amount"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN '-3' ELSE cast(cast(o_totalprice AS decimal(18, 2)) AS string) END").alias("mixed"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'false' ELSE '' END").alias("flag"), F.col("o_orderpriority").alias("word"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN '12' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END").alias("odd"),
    )
    return files.infer_types(texts)


@query(
    "src_file_inventory",
    """SELECT kind, CAST(n AS BIGINT) AS file_count, n = 1 AS is_ready FROM (SELECT 'template' AS kind, 1 AS n UNION ALL SELECT 'glob', 2 UNION ALL SELECT 'regex', 2 UNION ALL SELECT 'too_big', 0), (SELECT count(*) AS c FROM supplier) WHERE c > 0""",
)
def _(t):
    root = scratch_path(t.spark, "landing")
    for folder in ("expected/partner_daily_20260506.csv", "expected/partner_daily_20260507.csv", "wrong-prefix/partner_daily_20260506.csv"):
        tables.write_files(t.supplier.groupBy("s_nationkey").count().coalesce(1), f"{root}/{folder}", fmt="csv")  # a row for each nation
    # Spark writes directories; each landed name is judged by its one data file.
    listed = loads.list_files(t.spark, root).filter(F.col("path").contains("/part-")).withColumn("path", F.regexp_replace("path", "/part-[^/]*$", ""))
    head = f"{root}/expected"
    cases = {
        "template": loads.match_files(listed, head, "partner_daily_{yyyyMMdd}.csv", business_date=date(2026, 5, 6)),
        "glob": loads.match_files(listed, head, "partner_daily_*.csv", kind="glob", min_bytes=1),
        "regex": loads.match_files(listed, head, "partner_daily_[0-9]{8}[.]csv", kind="regex"),
        "too_big": loads.match_files(listed, head, "partner_daily_*.csv", kind="glob", min_bytes=10_000_000),
    }
    out = None
    for kind, matched in cases.items():
        one = loads.file_readiness(matched).select(F.lit(kind).alias("kind"), "file_count", "is_ready")
        out = one if out is None else out.unionByName(one)
    return out


@query("src_count_gate", "SELECT count(*) AS row_count, count(*) BETWEEN 100 AND 1000 AS is_ready FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'")
def _(t):
    return loads.count_gate(t.events, 100, 1000, day="ts", on=date(2024, 1, 10))


@query(
    "src_arrivals",
    "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, ts) AS event_id, count(*) AS arrival_count FROM events GROUP BY user_id, event_type",
)
def _(t):
    return loads.first_arrivals(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts")


# -- snk_* --------------------------------------------------------------------


@query("snk_files", "SELECT o_orderkey, o_totalprice, o_orderstatus, c AS copies FROM orders, (SELECT unnest([1, 2]) AS c)")
def _(t):
    path = scratch_path(t.spark, "sink")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.write_files(rows.withColumn("copies", F.lit(0)), path, partition_by=["o_orderstatus"])
    tables.write_files(rows.withColumn("copies", F.lit(1)), path, partition_by=["o_orderstatus"])
    tables.write_files(rows.withColumn("copies", F.lit(2)), path, mode="append", partition_by=["o_orderstatus"])
    return t.spark.read.parquet(path)


@query(
    "snk_overwrite_partition",
    "SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN -1.0 ELSE value END AS value, CAST(ts AS DATE) AS ds FROM events",
)
def _(t):
    path = scratch_path(t.spark, "daily")
    rows = t.events.select("event_id", "value", F.col("ts").cast("date").alias("ds"))
    tables.overwrite_partitions(rows, path, ["ds"])
    again = rows.filter("ds = DATE '2024-01-05'").withColumn("value", F.lit(-1.0))
    for _run in range(2):
        tables.overwrite_partitions(again, path, ["ds"])
    return t.spark.read.parquet(path).withColumn("ds", F.col("ds").cast("date"))


@query(
    "snk_merge",
    """SELECT event_id, CASE WHEN event_type = 'error' AND CAST(ts AS DATE) >= DATE '2024-01-20' THEN 0.0 ELSE value END AS value, CAST(ts AS DATE) AS ds FROM events
       UNION ALL SELECT event_id + 100000000, 1.0, CAST(ts AS DATE) FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) >= DATE '2024-01-20'""",
)
def _(t):
    path = scratch_path(t.spark, "merge-target")
    rows = t.events.select("event_id", "value", F.col("ts").cast("date").alias("ds"), "event_type")
    tables.overwrite_partitions(rows.drop("event_type"), path, ["ds"])
    late = rows.filter("ds >= DATE '2024-01-20'")
    delta = late.filter("event_type = 'error'").select("event_id", F.lit(0.0).alias("value"), "ds", F.lit(1).alias("seq")).unionByName(
        late.filter("event_type = 'signup'").select((F.col("event_id") + 100000000).alias("event_id"), F.lit(1.0).alias("value"), "ds", F.lit(1).alias("seq"))
    )
    for _run in range(2):  # the same delta twice gives the same table
        tables.merge_files(t.spark, path, delta, ["event_id"], ["seq desc"], ["ds"])
    return t.spark.read.parquet(path).select("event_id", "value", F.col("ds").cast("date").alias("ds"))


@query(
    "snk_merge_moved",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status FROM orders""",
)
def _(t):
    path = scratch_path(t.spark, "merge-moved")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    tables.overwrite_partitions(rows.drop("o_orderpriority"), path, ["status"])
    # Urgent orders change their partition; that of status P is left without rows.
    delta = rows.filter("o_orderpriority = '1-URGENT' OR status = 'P'").select("o_orderkey", F.lit("X").alias("status"), F.lit(1).alias("seq"))
    for _run in range(2):
        tables.merge_files(t.spark, path, delta, ["o_orderkey"], ["seq desc"], ["status"])
    return t.spark.read.parquet(path)


@query("snk_compact_partitions", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderstatus = 'F' AS clustered FROM orders")
def _(t):
    path = scratch_path(t.spark, "small-files")
    t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").repartition(24).write.partitionBy("o_orderstatus").parquet(path)
    tables.compact(t.spark, path, target_files=2, cluster_by=["o_custkey"], partition={"o_orderstatus": "F"}, partition_by=["o_orderstatus"])
    rows = t.spark.read.parquet(path)
    files = rows.select("o_orderstatus", F.col("_metadata.file_name").alias("f")).groupBy("o_orderstatus").agg(F.count_distinct("f").alias("n"))
    small = F.broadcast(files.select("o_orderstatus", (F.col("n") <= 2).alias("clustered")))  # one row for each partition
    return rows.join(small, "o_orderstatus").select("o_orderkey", "o_custkey", "o_orderstatus", "clustered")


@query(
    "snk_jdbc",
    """WITH r AS (SELECT CASE WHEN l_returnflag = 'A' AND l_quantity = 1 THEN NULL ELSE l_orderkey END AS k, l_shipdate, l_quantity, l_extendedprice FROM lineitem)
       SELECT k, l_shipdate, l_quantity, l_extendedprice, 'write' AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_shipdate DESC, l_extendedprice, l_quantity) AS rn FROM r WHERE k IS NOT NULL) WHERE rn = 1
       UNION ALL SELECT k, l_shipdate, l_quantity, l_extendedprice, 'null_key' FROM r WHERE k IS NULL""",
)
def _(t):
    rows = t.lineitem.select(
        F.expr("CASE WHEN NOT (l_returnflag = 'A' AND l_quantity = 1) THEN l_orderkey END").alias("k"), "l_shipdate", "l_quantity", "l_extendedprice"
    )
    split = tables.prepare_upsert(rows, ["k"], "l_shipdate", ["l_extendedprice", "l_quantity"])
    return split.accepted.withColumn("outcome", F.lit("write")).unionByName(split.rejected.withColumn("outcome", F.lit("null_key")))


@query(
    "snk_kafka_batch",
    """SELECT sha256(o_custkey || '|' || o_orderkey) AS key, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS value FROM orders""",
)
def _(t):
    return kafka.encode(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderkey"])


@query(
    "snk_audit_columns",
    """SELECT c_custkey, TIMESTAMP '2024-03-01 06:00:00' AS _audit_ingested_at, TIMESTAMP '2024-02-29 23:15:00' AS _audit_processing_ts, 'load' AS _audit_pipeline, 'task-1' AS _audit_task, 'run-1' AS _audit_run_id,
              'customers_20240229231500.parquet' AS file, DATE '2024-02-29' AS _audit_business_date, 'dag-1' AS _audit_dag_id FROM customer""",
)
def _(t):
    path = scratch_path(t.spark, "audit") + "/customers_20240229231500.parquet"
    tables.write_files(t.customer.select("c_custkey"), path)
    rows = t.spark.read.parquet(path)
    out = tables.add_audit_columns(
        rows.select("c_custkey", "_metadata"), pipeline="load", task="task-1", run_id="run-1", dag_id="dag-1", business_date=date(2024, 2, 29), run_time=datetime(2024, 3, 1, 6),
        processing_time="run_time",
    )
    # The landed name is the directory here, so its digits are read from the recorded path.
    when = F.try_to_timestamp(F.regexp_extract("_audit_source_uri", r"(\d{14})", 1), F.lit("yyyyMMddHHmmss"))
    return out.select(
        "c_custkey", F.col("_audit_ingested_at").cast("timestamp_ntz").alias("_audit_ingested_at"), when.cast("timestamp_ntz").alias("_audit_processing_ts"),
        "_audit_pipeline", "_audit_task", "_audit_run_id", F.regexp_extract("_audit_source_uri", r"([^/]+\.parquet)/", 1).alias("file"), "_audit_business_date", "_audit_dag_id",
    )


@query("snk_table_ddl", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def _(t):
    # An external table created from the contract, filled and read back by name.
    path = scratch_path(t.spark, "ddl")
    name = "millrace_" + path.rsplit("-", 1)[1]
    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag")
    tables.overwrite_partitions(rows, path, ["l_returnflag"])
    t.spark.sql(tables.table_ddl(name, rows.schema, partition_by=["l_returnflag"], location=path))
    t.spark.catalog.recoverPartitions(name)
    return t.spark.table(name).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query(
    "snk_manifest",
    """SELECT 'event_type=' || event_type || '/ds=' || CAST(CAST(ts AS DATE) AS VARCHAR) AS partition, count(*) AS row_count, 'run-9' AS idempotency_key, true AS same_after_reorder FROM events GROUP BY event_type, CAST(ts AS DATE)""",
)
def _(t):
    rows = t.events.withColumn("ds", F.col("ts").cast("date"))
    a = tables.manifest(rows, ["event_type", "ds"], "run-9")
    b = tables.manifest(rows.repartition(5, "value"), ["event_type", "ds"], "run-9").select("partition", F.col("content_checksum").alias("again"))
    return a.join(b, "partition").select("partition", "row_count", "idempotency_key", (F.col("content_checksum") == F.col("again")).alias("same_after_reorder"))


@query(
    "snk_evolution",
    "SELECT c_custkey AS k, c_acctbal AS balance, NULL AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
)
def _(t):
    path = scratch_path(t.spark, "evolve")
    tables.write_files(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance")), path)
    tables.evolve_write(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), path, "add_columns")
    return t.spark.read.option("mergeSchema", "true").parquet(path)


@query("snk_compact", "SELECT l_orderkey, l_partkey, l_quantity, 1 AS enough_files FROM lineitem")
def _(t):
    path = scratch_path(t.spark, "small-files")
    t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").repartition(24).write.parquet(path)
    done = tables.compact(t.spark, path, target_files=4, cluster_by=["l_partkey"])
    count = loads.list_files(t.spark, done).agg((F.count(F.lit(1)) <= 4).cast("int").alias("n")).scalar()
    return t.spark.read.parquet(done).withColumn("enough_files", count)


@query("snk_gold_contract", "SELECT n_nationkey, n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "gold")
    gold = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("customers"))
    name = "millrace_gold_" + path.rsplit("-", 1)[1]
    tables.publish_table(gold, name, path=path)
    return t.spark.table(name)
