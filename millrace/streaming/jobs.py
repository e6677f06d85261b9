"""Structured Streaming jobs. Sources and sinks are parameters: Kafka on a cluster, files in tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import need
from ..operators.merge import apply_changes

ENVELOPE = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
CHANGE = "op string, before string, after string, ts_ms long, source string, transaction string"


def read_kafka(spark: SparkSession, servers: str, topic: str, *, starting: str = "latest", max_offsets: int | None = None) -> DataFrame:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})


def read_files_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", str(max_files)).load(path)


def parse_messages(messages: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Envelope columns, parsed payload, raw text where it does not parse, and the event day."""
    from ..operators.nested import parsed_once

    return parsed_once(messages, "value", schema).select(
        "topic", "partition", "offset", F.col("timestamp").alias("event_ts"), F.col("key").alias("message_key"),
        F.when(F.col("__ok"), F.col("__e")).alias("payload"), F.when(~F.col("__ok"), F.col("value")).alias("raw_payload"),
        F.col("timestamp").cast("date").alias("ds"),
    )


# Fixed operation codes of a change envelope.
CHANGE_OPS = {"c": "UPSERT", "u": "UPSERT", "r": "UPSERT", "d": "DELETE", "t": "TRUNCATE"}


def parse_changes(messages: DataFrame, row_schema: T.StructType | str) -> DataFrame:
    """Change envelope to rows: operation, images, source time, and the day of the change."""
    e = F.from_json("value", CHANGE)
    op = F.lit(None).cast("string")
    for code, name in CHANGE_OPS.items():
        op = F.when(F.col("e.op") == code, F.lit(name)).otherwise(op)
    changed = F.timestamp_millis("e.ts_ms")
    return messages.withColumn("e", e).select(
        op.alias("op"),
        F.from_json("e.before", row_schema).alias("before"),
        F.from_json("e.after", row_schema).alias("after"),
        changed.alias("changed_at"), F.col("e.source").alias("source"), F.col("e.transaction").alias("transaction"),
        "topic", "partition", "offset", changed.cast("date").alias("ds"),
    )


def dedupe_stream(stream: DataFrame, keys: Sequence[str], time: str, horizon: str = "1 day") -> DataFrame:
    """Drop copies of a message that arrive within the horizon; state is bounded by it."""
    need(bool(keys), "MISSING_KEYS", "stream dedupe needs keys")
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(keys))


def window_aggregate(
    stream: DataFrame, time: str, width: str, dimensions: Sequence[str], aggregates: Sequence[Column], *, watermark: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Tumbling (or sliding) event-time rollup with late data bounded by the watermark."""
    w = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    grouped = stream.withWatermark(time, watermark).groupBy(w.alias("w"), *dimensions).agg(*aggregates)
    return grouped.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def session_aggregate(
    stream: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], *, watermark: str = "1 hour"
) -> DataFrame:
    """Activity sessions per key, closed after a gap without events."""
    need(bool(keys), "MISSING_KEYS", "sessions need keys")
    w = F.session_window(F.col(time), gap)
    grouped = stream.withWatermark(time, watermark).groupBy(w.alias("w"), *keys).agg(*aggregates)
    return grouped.withColumns({"session_start": F.col("w.start"), "session_end": F.col("w.end")}).drop("w")


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, *, partition_by: Sequence[str] = (), available_now: bool = False, interval: str = "1 minute", mode: str = "append"
) -> StreamingQuery:
    """Checkpointed append to files."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start(path)


OPEN, CLOSED, PART, BATCH = "open", "closed", "part", "batch"


def rollup_stream(
    grouped: DataFrame, path: str, checkpoint: str, keys: Sequence[str], *, end: str, seen: str, delay: str, available_now: bool = False
) -> StreamingQuery:
    """Store a windowed rollup: closed windows are appended once, open ones are a small part that each batch replaces.

    ``grouped`` comes from ``window_aggregate``; ``seen`` is its column with the latest event time of a group,
    ``end`` the end of its window, ``delay`` the watermark that it was built with. Update mode hands over the
    groups that a batch changed. A window is closed once the watermark of the batch before has passed its end:
    later rows for it are dropped by Spark, so its row is final. That watermark follows from the open part
    itself, because the window of the latest event ends after it. Batch n reads the open part before it only.
    """
    need(bool(keys), "MISSING_KEYS", "a rollup needs keys")
    schema = grouped.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        before = _open_part(batch.sparkSession, path, schema, batch_id)
        if before is None:
            return _write_parts(batch, F.lit(False), path, batch_id)
        both = before.withColumn("__v", F.lit(0)).unionByName(batch.withColumn("__v", F.lit(1)))
        newest = F.max_by(F.struct(*schema.names), "__v").alias("row")
        merged = both.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(newest).select("row.*")
        _write_parts(merged, F.col(end) <= _passed(before, F.max(seen), delay), path, batch_id)

    writer = grouped.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: How partial results of a session combine.
COMBINE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def session_store(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    time: str,
    gap: str,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, str]],
    *,
    delay: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Store sessions the same way: ``{name: (count|sum|min|max, column)}`` per key, closed after a gap without events.

    A batch is reduced to its own sessions first. They merge with the open ones, as intervals that overlap,
    so what is kept and read again is one row for each open session, never its events. A row that lies more
    than gap and delay behind the latest event of the batches before is late and dropped; one within the
    delay always finds its session open.
    """
    need(bool(keys), "MISSING_KEYS", "sessions need keys")
    unknown = {fn for fn, _ in aggregates.values()} - set(COMBINE)
    need(not unknown, "INVALID_AGGREGATE", str(sorted(unknown)))
    schema = _sessions(stream, F.session_window(F.col(time), gap), keys, aggregates).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        before = _open_part(batch.sparkSession, path, schema, batch_id)
        if before is None:
            return _write_parts(_sessions(batch, F.session_window(F.col(time), gap), keys, aggregates), F.lit(False), path, batch_id)
        passed = _passed(before, F.max(F.col("session_end") - F.expr(f"INTERVAL {gap}")), delay)
        fresh = batch.filter(F.coalesce(F.col(time) + F.expr(f"INTERVAL {gap}") > passed, F.lit(True)))
        parts = before.unionByName(_sessions(fresh, F.session_window(F.col(time), gap), keys, aggregates))
        length = F.concat((F.unix_micros("session_end") - F.unix_micros("session_start")).cast("string"), F.lit(" microseconds"))
        again = {name: (COMBINE[fn], name) for name, (fn, _) in aggregates.items()}
        merged = _sessions(parts, F.session_window(F.col("session_start"), length), keys, again)
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
        _write_parts(merged.select(*typed), F.col("session_end") <= passed, path, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def session_schema(stream: DataFrame, time: str, keys: Sequence[str], aggregates: Mapping[str, tuple[str, str]]) -> T.StructType:
    """Columns of a session store, for ``read_rollup``."""
    return _sessions(stream, F.session_window(F.col(time), "1 second"), keys, aggregates).schema


def _sessions(rows: DataFrame, window: Column, keys: Sequence[str], aggregates: Mapping[str, tuple[str, str]]) -> DataFrame:
    made = [getattr(F, fn)(c).alias(n) for n, (fn, c) in aggregates.items()]
    grouped = rows.groupBy(window.alias("__w"), *keys).agg(*made)
    return grouped.select(*keys, F.col("__w.start").alias("session_start"), F.col("__w.end").alias("session_end"), *aggregates)


def _passed(before: DataFrame, latest: Column, delay: str) -> Column:
    """The watermark after the batch before, in whole milliseconds as Spark keeps it."""
    return before.select(F.date_trunc("millisecond", latest) - F.expr(f"INTERVAL {delay}")).scalar()


def _write_parts(rows: DataFrame, closed: Column, path: str, batch_id: int) -> None:
    """Write a batch; a batch that runs again replaces itself. Open parts that no repeat needs are deleted."""
    part = F.when(F.coalesce(closed, F.lit(False)), CLOSED).otherwise(OPEN)
    target = f"{path}/{BATCH}={batch_id}"
    rows.withColumn(PART, part).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(PART).parquet(target)
    fs, old = _filesystem(rows.sparkSession, f"{path}/{BATCH}={batch_id - 2}/{PART}={OPEN}")
    if fs.exists(old):
        fs.delete(old, True)


def _open_part(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame | None:
    """Open windows as the batch before left them; nothing before the first batch."""
    if batch_id == 0:
        return None
    folder = f"{path}/{BATCH}={batch_id - 1}"
    fs, done = _filesystem(spark, f"{folder}/_SUCCESS")
    need(fs.exists(done), "NO_VERSION", folder)
    part = f"{folder}/{PART}={OPEN}"
    if not fs.exists(_filesystem(spark, part)[1]):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(part)


def read_rollup(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All windows of a store, with ``part`` closed or open, as of its newest finished batch."""
    fs = _filesystem(spark, path)[0]
    done = [n for n in _numbered(spark, path, BATCH) if fs.exists(_filesystem(spark, f"{path}/{BATCH}={n}/_SUCCESS")[1])]
    need(bool(done), "NO_VERSION", path)
    kept = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(PART, T.StringType())])
    rows = spark.read.schema(kept).parquet(path)
    last = max(done)
    return rows.filter(((F.col(PART) == CLOSED) & (F.col(BATCH) <= last)) | ((F.col(PART) == OPEN) & (F.col(BATCH) == last))).drop(BATCH)


def publish_stream(stream: DataFrame, keys: Sequence[str], fmt: str, checkpoint: str, *, available_now: bool = False, **options: str) -> StreamingQuery:
    """Encode rows as messages and publish them with a checkpoint."""
    from ..sinks.kafka import encode

    writer = encode(stream, keys).writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**options)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_split_stream(
    stream: DataFrame, event_time: str, processing_time: str, threshold_hours: int, path: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Write on-time and late rows side by side, ``lateness=on_time|late``, one write per batch.

    The batch number is a partition, so a batch that runs again replaces itself.
    """
    late = F.col(processing_time) > F.col(event_time) + F.expr(f"INTERVAL {int(threshold_hours)} HOURS")

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumns(
            {"lateness": F.when(F.coalesce(late, F.lit(False)), "late").otherwise("on_time"), "batch_id": F.lit(batch_id)}
        )
        (
            tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", "lateness").parquet(path)
        )

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def apply_changes_stream(
    changes: DataFrame,
    initial: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    op: str,
    order: Sequence[str],
    *,
    available_now: bool = False,
    flatten: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """Keep a current-state table of which a batch rewrites only the buckets that its keys fall into.

    Keys are hashed into ``buckets``, a number to be kept for the life of the table: choose it so that
    one bucket suits one task. Batch n reads the touched buckets as manifest n-1 names them, writes them
    below ``version=n`` and then manifest n, which names the live version of every bucket. A batch that
    runs again after a lost driver thus rebuilds the same version from the same input. A truncation
    touches every bucket. What only manifest n-2 names is deleted.
    """
    need(buckets > 0, "INVALID_BUCKETS", str(buckets))
    spark, schema = initial.sparkSession, initial.schema
    own = F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in keys]), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = flatten(batch) if flatten else batch
        live = _live_buckets(spark, path, batch_id - 1) if batch_id else {}
        if batch_id:
            asked = rows.select(F.when(F.col(op) == "TRUNCATE", -1).otherwise(own).alias("b")).distinct().collect()
            touched = {r["b"] for r in asked}
            touched = set(range(buckets)) if -1 in touched else touched
            base = _read_buckets(spark, path, schema, {b: v for b, v in live.items() if b in touched})
        else:
            touched, base = set(range(buckets)), initial
        version = f"{path}/version={batch_id}"
        if touched:
            state = apply_changes(base, rows, keys, op, order).state.withColumn(BUCKET, own)
            (
                state.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static")
                .partitionBy(BUCKET).parquet(version)
            )
        written = _numbered(spark, version, BUCKET) if touched else []
        now = {b: v for b, v in live.items() if b not in touched} | dict.fromkeys(written, batch_id)
        named = spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1)
        named.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{MANIFESTS}/version={batch_id}")
        # A repeated batch needs the manifest before its own and what that one names, nothing older.
        older = f"{path}/{MANIFESTS}/version={batch_id - 2}"
        fs, root = _filesystem(spark, older)
        if fs.exists(root):
            for b, v in _live_buckets(spark, path, batch_id - 2).items():
                if live.get(b) != v:
                    fs.delete(_filesystem(spark, f"{path}/version={v}/{BUCKET}={b}")[1], True)
            fs.delete(root, True)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


BUCKET, MANIFESTS, MANIFEST = "state_bucket", "manifest", "bucket int, live long"


def _live_buckets(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Version that holds each bucket which has rows: at most one entry for each bucket."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/{MANIFESTS}/version={version}").collect()
    return {r["bucket"]: r["live"] for r in rows}


def _read_buckets(spark: SparkSession, path: str, schema: T.StructType, live: dict[int, int]) -> DataFrame:
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/version={v}/{BUCKET}={b}" for b, v in sorted(live.items())])


def current_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The state of the newest finished batch of ``apply_changes_stream``."""
    folder = f"{path}/{MANIFESTS}"
    fs = _filesystem(spark, folder)[0]
    done = [n for n in _numbered(spark, folder, "version") if fs.exists(_filesystem(spark, f"{folder}/version={n}/_SUCCESS")[1])]
    need(bool(done), "NO_VERSION", path)
    return _read_buckets(spark, path, schema, _live_buckets(spark, path, max(done)))


def _filesystem(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root  # type: ignore[attr-defined]


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=<number>`` below a path."""
    fs, root = _filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return [int(n.split("=")[1]) for n in names if n.startswith(f"{name}=")]
