"""Streaming queries: the tables are streamed from files with availableNow; results equal the batch."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs
from .registry import query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def stream(t, table, schema):
    return jobs.read_files_stream(t.spark, f"{t.path}/{table}*.parquet", schema)


def events(t):
    return stream(t, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def messages(t):
    """Events as broker messages; errors carry a broken payload."""
    body = F.to_json(F.struct("event_id", "user_id", "value"))
    return events(t).select(
        F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", F.concat(F.lit("!"), body)).otherwise(body).alias("value"),
        F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"),
    )


def finish(started):
    started.awaitTermination()


def drain(t, frame, label, **options):
    """Run a stream over everything there is and read what it wrote."""
    path, check = scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-checkpoint")
    finish(jobs.append_stream(frame, path, check, available_now=True, **options))
    return t.spark.read.schema(frame.schema).parquet(path)


@query(
    "str_json_ingest",
    """SELECT 'events' AS topic, event_id AS "offset", CAST(user_id AS VARCHAR) AS message_key, CASE WHEN event_type <> 'error' THEN event_id END AS event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
              event_type = 'error' AS is_raw, CAST(ts AS DATE) AS ds FROM events""",
)
def _(t):
    out = drain(t, jobs.parse_messages(messages(t), "event_id BIGINT, user_id BIGINT, value DOUBLE"), "json-ingest", partition_by=["ds"])
    return out.select("topic", "offset", "message_key", "payload.event_id", "payload.value", F.col("raw_payload").isNotNull().alias("is_raw"), "ds")


def change_messages(t):
    """Customers as change envelopes: created, and for some segments updated or deleted."""
    c = stream(t, "customer", CUSTOMERS)
    row = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))
    last = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("u")).when(F.col("c_mktsegment") == "FURNITURE", F.lit("d"))
    ops = F.filter(F.array(F.lit("c"), last), lambda x: x.isNotNull())
    changes = c.withColumn("images", row).select("c_custkey", "images", F.posexplode(ops).alias("seq", "op"))
    ts_ms = F.lit(1704067200000).cast("long") + F.col("seq") * 86400000
    value = F.to_json(
        F.struct(
            "op", F.when(F.col("op") != "c", F.col("images")).alias("before"), F.when(F.col("op") != "d", F.col("images")).alias("after"),
            ts_ms.alias("ts_ms"), F.lit("erp").alias("source"),
        )
    )
    return changes.select(
        F.col("c_custkey").cast("string").alias("key"), value.alias("value"), F.lit("customers").alias("topic"), F.lit(0).alias("partition"),
        (F.col("c_custkey") * 2 + F.col("seq")).alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"),
    )


CHANGES_SQL = """SELECT c_custkey, 'UPSERT' AS op, DATE '2024-01-01' AS ds FROM customer UNION ALL SELECT c_custkey, 'UPSERT', DATE '2024-01-02' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 'DELETE', DATE '2024-01-02' FROM customer WHERE c_mktsegment = 'FURNITURE'"""


@query("str_cdc_ingest", CHANGES_SQL)
def _(t):
    out = drain(t, jobs.parse_changes(change_messages(t), "id BIGINT, balance DOUBLE"), "cdc-ingest")
    return out.select(F.coalesce("after.id", "before.id").alias("c_custkey"), "op", "ds")


@query("str_cdc_apply", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_mktsegment <> 'FURNITURE'")
def _(t):
    path, check = scratch_path(t.spark, "state"), scratch_path(t.spark, "state-checkpoint")
    changes = jobs.parse_changes(change_messages(t), "id BIGINT, balance DOUBLE")
    empty = t.spark.createDataFrame([], "id long, balance double")

    def flatten(batch):
        return batch.select(F.coalesce("after.id", "before.id").alias("id"), "after.balance", "op", "offset")

    finish(jobs.apply_changes_stream(changes, empty, path, check, ["id"], "op", ["offset"], available_now=True, flatten=flatten))
    return jobs.current_state(t.spark, path, empty.schema)


@query("str_dedupe", "SELECT DISTINCT event_id, user_id, ts FROM events")
def _(t):
    twice = events(t).select("event_id", "user_id", "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = drain(t, jobs.dedupe_stream(twice, ["event_id"], "ts", "40 days"), "dedupe")
    return out.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("str_late_split", "SELECT event_id, CASE WHEN CAST(trunc(value) AS INTEGER) > 72 THEN 'late' ELSE 'on_time' END AS lateness FROM events")
def _(t):
    path, check = scratch_path(t.spark, "late"), scratch_path(t.spark, "late-checkpoint")
    arrived = events(t).withColumn("arrived_at", F.expr("ts + make_dt_interval(0, cast(value as int), 0, 0)"))
    finish(jobs.late_split_stream(arrived, "ts", "arrived_at", 72, path, check, available_now=True))
    return t.spark.read.parquet(path).select("event_id", "lateness")


@query(
    "str_window_agg",
    "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def _(t):
    made = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("seen")]
    hourly = jobs.window_aggregate(events(t), "ts", "1 hour", ["event_type"], made, watermark="40 days")
    path, check = scratch_path(t.spark, "hourly"), scratch_path(t.spark, "hourly-checkpoint")
    keys = ["event_type", "window_start"]
    finish(jobs.rollup_stream(hourly, path, check, keys, end="window_end", seen="seen", delay="40 days", available_now=True))
    out = jobs.read_rollup(t.spark, path, hourly.schema)
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query(
    "str_session_agg",
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS is_new FROM events),
       s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
       SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""",
)
def _(t):
    made = {"n": ("count", "event_id"), "total": ("sum", "value")}
    path, check = scratch_path(t.spark, "sessions"), scratch_path(t.spark, "sessions-checkpoint")
    finish(jobs.session_store(events(t), path, check, "ts", "6 hours", ["user_id"], made, delay="40 days", available_now=True))
    out = jobs.read_rollup(t.spark, path, jobs.session_schema(events(t), "ts", ["user_id"], made))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", F.round("total", 4).alias("total"))


PUBLISH_SQL = """SELECT sha256(user_id || '|' || event_id) AS key, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS value FROM events"""


@query("str_publish", PUBLISH_SQL)
def _(t):
    path, check = scratch_path(t.spark, "publish"), scratch_path(t.spark, "publish-checkpoint")
    rows = events(t).select("event_id", "user_id")
    finish(jobs.publish_stream(rows, ["user_id", "event_id"], "parquet", check, available_now=True, path=path))
    return t.spark.read.schema("key string, value string").parquet(path)


@query(
    "snk_stream_publish",
    """SELECT sha256(CAST(c_custkey AS VARCHAR)) AS key, '{"id":' || c_custkey || ',"op":"UPSERT"}' AS value FROM customer
       UNION ALL SELECT sha256(CAST(c_custkey AS VARCHAR)), '{"id":' || c_custkey || ',"op":"UPSERT"}' FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(t):
    # Inserts and post-images of a change stream; deletes have no post-image.
    path, check = scratch_path(t.spark, "post-images"), scratch_path(t.spark, "post-images-checkpoint")
    changes = jobs.parse_changes(change_messages(t), "id BIGINT, balance DOUBLE")
    images = changes.filter("after IS NOT NULL").select("after.id", "op")
    finish(jobs.publish_stream(images, ["id"], "parquet", check, available_now=True, path=path))
    return t.spark.read.schema("key string, value string").parquet(path)
