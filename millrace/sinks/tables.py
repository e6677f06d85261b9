"""Table sinks: partitioned files, idempotent partition replacement, merges, manifests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, need, need_columns
from ..functions.keys import row_hash
from ..operators.columns import Split
from ..operators.merge import upsert
from ..operators.windows import dedupe, row_fallback
from ..session import materialise, scratch_path


def write_files(
    df: DataFrame,
    path: str,
    *,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> None:
    need(mode in ("append", "overwrite", "error", "ignore"), "INVALID_MODE", mode)
    need_columns(df, partition_by)
    writer = df.write.format(fmt).mode(mode).options(**dict(options or {}))
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """Replace only the partitions present in the frame: running a date again gives the same table."""
    need(bool(partition_by), "MISSING_PARTITIONS", "partition overwrite needs partition columns")
    need_columns(df, partition_by)
    (
        df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by).save(path)
    )


#: What the folder of a table's key filters (see ``merge_files``) has in its name behind the table's.
KEY_FILTERS = ".keys"
#: Keys for each filter block of 32,768 bits (16 bits a key), and bits set for a key.
BLOCK_KEYS, KEY_BITS = 2048, 4


def merge_files(
    spark: SparkSession, path: str, delta: DataFrame, keys: Sequence[str], order: Sequence[str], partition_by: Sequence[str]
) -> None:
    """Upsert into a partitioned table: rewrite the partitions the delta names or its keys stand in.

    A key that moves to another partition leaves the old one, which is rewritten too, or removed
    where nothing stays in it. The new partitions are staged in the shared folder and read back
    before the overwrite, so the job never reads the files it replaces, and running it again after
    a failure gives the same table.

    Which partitions hold keys of the delta is looked up in Bloom filters kept beside the table, one
    for each partition. A filter names the files it was made from; where these have changed, or no
    filter is there, the partition is read, and gets a filter afterwards. Staged data is deleted.
    """
    need_columns(delta, [*keys, *partition_by])
    target = spark.read.parquet(path)
    wanted = delta.select(*[F.col(k).cast(target.schema[k].dataType).alias(k) for k in keys]).distinct()
    named = lambda df: df.select(_partition_name(df, partition_by).alias("p")).distinct()
    current = _partition_files(spark, path, partition_by)
    stale, may_hold = _candidates(spark, path, wanted, keys, current)
    # Names of partitions only: their number is that of the table's folders.
    held = target.filter(_is_in(target, partition_by, stale | may_hold)).select(*keys, *partition_by).join(wanted, list(keys), "left_semi")
    kinds = [F.col(c).cast(target.schema[c].dataType).alias(c) for c in partition_by]
    touched = {r["p"] for r in named(delta.select(*kinds).union(held.select(*partition_by))).collect()}
    staged = scratch_path(spark, "merge")
    merged = upsert(target.filter(_is_in(target, partition_by, touched)), delta, keys, order)
    merged.write.parquet(staged)
    merged = spark.read.schema(merged.schema).parquet(staged)
    emptied = touched - {r["p"] for r in named(merged.select(*kinds)).collect()}
    overwrite_partitions(merged, path, partition_by)
    for folder in [f for p, _, f in current if p in emptied]:
        _delete(spark, folder)
    _write_filters(spark, path, keys, partition_by, (touched | stale) - emptied)
    _delete(spark, staged)


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))  # type: ignore[union-attr]
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # type: ignore[attr-defined]


def _partition_name(df: DataFrame, partition_by: Sequence[str]) -> Column:
    """The values of a partition as one text; null, as its folder, is apart from all of them."""
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c in partition_by]))


def _is_in(target: DataFrame, partition_by: Sequence[str], names: set[str]) -> Column:
    """A predicate on partition columns alone, so that only these partitions are read."""
    return _partition_name(target, partition_by).isin(sorted(names)) if names else F.lit(False)


def _partition_files(spark: SparkSession, path: str, partition_by: Sequence[str]) -> list[tuple[str, int, str]]:
    """Name, stamp of the files and folder of each partition, from their listing; no file is opened."""
    schema = spark.read.parquet(path).schema
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).drop("content")
    listed = listed.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in partition_by], "path", "length", "modificationTime")
    stamp = F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
    rows = listed.groupBy(_partition_name(listed, partition_by).alias("p")).agg(stamp.alias("s"), F.min(F.regexp_replace("path", "/[^/]*$", "")).alias("f"))
    return [(r["p"], r["s"], r["f"]) for r in rows.collect()]


def _key_bits(keys: Sequence[str], blocks: Column) -> list[Column]:
    """Block of a key among ``blocks``, and its bits there."""
    h = F.xxhash64(*keys)
    block = F.pmod(F.xxhash64(F.lit(1), *keys), blocks)
    bits = F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(32767) for i in range(KEY_BITS)])
    return [block.alias("block"), bits.alias("bits")]


def _candidates(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], current: Sequence[tuple[str, int, str]]) -> tuple[set[str], set[str]]:
    """Partitions without a valid filter, and those whose filter lets some of the wanted keys pass."""
    try:
        filters = spark.read.parquet(path.rstrip("/") + KEY_FILTERS)
    except AnalysisException:  # no filters yet
        return {p for p, _, _ in current}, set()
    now = spark.createDataFrame([(p, s) for p, s, _ in current], "p string, s long")
    valid = filters.join(F.broadcast(now), ["p", "s"])
    sizes = valid.select("p", "blocks").distinct().collect()
    stale = {p for p, _, _ in current} - {r["p"] for r in sizes}
    kinds = sorted({r["blocks"] for r in sizes})  # powers of two
    if not kinds:
        return stale, set()
    asked = wanted.withColumn("blocks", F.explode(F.array(*[F.lit(k) for k in kinds])))
    asked = asked.select("blocks", *_key_bits(keys, F.col("blocks")))
    # Bit i of a bitmap is bit i % 8 of byte i / 8.
    found = valid.join(asked, ["blocks", "block"])
    passes = F.lit(True)
    for i in range(KEY_BITS):
        passes = passes & (F.expr(f"shiftright(cast(conv(hex(substring(bitmap, cast(shiftright(bits[{i}], 3) as int) + 1, 1)), 16, 10) as int), cast(bits[{i}] & 7 as int)) & 1 = 1"))
    return stale, {r["p"] for r in found.filter(passes).select("p").distinct().collect()}


def _write_filters(spark: SparkSession, path: str, keys: Sequence[str], partition_by: Sequence[str], names: set[str]) -> None:
    """Filters of these partitions, sized by their rows; each replaces the one before."""
    if not names:
        return
    target = spark.read.parquet(path)
    rows = target.filter(_is_in(target, partition_by, names)).select(_partition_name(target, partition_by).alias("p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    size = rows.groupBy("p").agg(F.expr(f"cast(pow(2, ceil(log2(greatest(count(*) / {BLOCK_KEYS}, 1)))) as long)").alias("blocks"))
    stamps = [(p, s) for p, s, _ in _partition_files(spark, path, partition_by) if p in names]
    # One row for each partition.
    size = size.join(spark.createDataFrame([(p, s, i) for i, (p, s) in enumerate(sorted(stamps))], "p string, s long, __id int"), "p")
    # A block is made where all its keys meet, of narrow rows: bitmaps are aggregated by sorting, and before a shuffle
    # that would sort all rows of a scan. Each bit of a key has a bitmap of its own, put together afterwards.
    placed = rows.join(F.broadcast(size), "p").select("__id", *_key_bits([f"__k{i}" for i in range(len(keys))], F.col("blocks"))).select("__id", "block", *[F.col("bits")[i].cast("int").alias(f"b{i}") for i in range(KEY_BITS)])
    each = placed.repartition("__id", "block").groupBy("__id", "block").agg(*[F.bitmap_construct_agg(f"b{i}").alias(f"m{i}") for i in range(KEY_BITS)])
    whole = each.select("__id", "block", F.explode(F.array(*[f"m{i}" for i in range(KEY_BITS)])).alias("m")).groupBy("__id", "block").agg(F.bitmap_or_agg("m").alias("bitmap"))
    made = whole.join(F.broadcast(size), "__id").select("p", "s", "blocks", "block", "bitmap")
    made = made.withColumn("folder", F.sha1("p"))
    overwrite_partitions(made, path.rstrip("/") + KEY_FILTERS, ["folder"])


def prepare_upsert(df: DataFrame, keys: Sequence[str], updated_at: str, tie: Sequence[str] = ()) -> Split:
    """Rows for a database upsert: null keys rejected, the latest update per key wins."""
    need_columns(df, [*keys, updated_at])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull() | (F.col(k).cast("string") == "")
    good = df.filter(~missing)
    return Split(dedupe(good, keys, [f"{updated_at} desc", *tie]), df.filter(missing))


def jdbc_write_options(connection: Mapping[str, str], table: str, mode: str = "append", batch_size: int = 10_000, partitions: int = 8) -> dict[str, str]:
    """Writer options; ``upsert`` targets a staging table that a database-side merge reads."""
    need(mode in ("append", "overwrite", "upsert"), "INVALID_MODE", mode)
    target = f"{table}_staging" if mode == "upsert" else table
    return {**connection, "dbtable": target, "batchsize": str(batch_size), "numPartitions": str(partitions), "truncate": "true"}


def upsert_statement(table: str, columns: Sequence[str], keys: Sequence[str], dialect: str = "postgres") -> str:
    """Statement that moves the staging table into the target."""
    others = [c for c in columns if c not in keys]
    names = ", ".join(columns)
    if dialect == "postgres":
        updates = ", ".join(f"{c} = EXCLUDED.{c}" for c in others)
        action = f"DO UPDATE SET {updates}" if others else "DO NOTHING"
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {table}_staging ON CONFLICT ({', '.join(keys)}) {action}"
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    updates = ", ".join(f"t.{c} = s.{c}" for c in others)
    matched = f"WHEN MATCHED THEN UPDATE SET {updates} " if others else ""
    values = ", ".join(f"s.{c}" for c in columns)
    return (
        f"MERGE INTO {table} t USING {table}_staging s ON {on} {matched}"
        f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )


# Fixed connector formats of warehouses.
WAREHOUSES = {"snowflake": "net.snowflake.spark.snowflake", "bigquery": "bigquery", "redshift": "io.github.spark_redshift_community.spark.redshift"}


def warehouse_writer(df: DataFrame, warehouse: str, table: str, mode: str = "append", **options: str):
    """Configured writer for a warehouse connector (the jar comes from the cluster)."""
    need(warehouse in WAREHOUSES, "UNKNOWN_WAREHOUSE", warehouse)
    name = "table" if warehouse == "bigquery" else "dbtable"
    return df.write.format(WAREHOUSES[warehouse]).mode(mode).options(**{name: table, **options})


# -- audit columns, manifests -------------------------------------------------

AUDIT_COLUMNS = ("ingested_at", "processing_ts", "pipeline", "task", "run_id", "source_uri", "business_date", "dag_id")


def add_audit_columns(
    df: DataFrame,
    *,
    pipeline: str,
    task: str,
    run_id: str,
    dag_id: str,
    business_date: date,
    run_time: datetime,
    source_uri: str | None = None,
    processing_time: str = "run_time",
    prefix: str = "_audit_",
) -> DataFrame:
    """Eight audit columns. ``processing_time``: run time, file modification time, or the
    14-digit time in the file name; file sources name their file in ``source_uri``."""
    need(processing_time in ("run_time", "file_modified", "file_name"), "INVALID_PROCESSING_TIME", processing_time)
    from_file = source_uri is None
    uri = F.col("_metadata.file_path") if from_file else F.lit(source_uri)
    now = F.lit(run_time).cast("timestamp")
    if processing_time == "run_time":
        when = now
    else:
        need(from_file, "NOT_A_FILE_SOURCE", processing_time)
        if processing_time == "file_modified":
            when = F.col("_metadata.file_modification_time")
        else:
            when = F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{14})", 1), F.lit("yyyyMMddHHmmss"))
    values = {
        "ingested_at": now, "processing_ts": when, "pipeline": F.lit(pipeline), "task": F.lit(task), "run_id": F.lit(run_id),
        "source_uri": uri, "business_date": F.lit(business_date).cast("date"), "dag_id": F.lit(dag_id),
    }
    return df.select("*", *[values[n].alias(prefix + n) for n in AUDIT_COLUMNS])


def manifest(df: DataFrame, partition_by: Sequence[str], idempotency_key: str) -> DataFrame:
    """One row per partition: rows and an order-insensitive content checksum."""
    need_columns(df, partition_by)
    checksum = F.sum(row_hash(df.columns).cast("decimal(38,0)"))
    label = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in partition_by])
    return df.groupBy(label.alias("partition")).agg(
        F.count(F.lit(1)).alias("row_count"), checksum.alias("content_checksum")
    ).withColumn("idempotency_key", F.lit(idempotency_key))


def evolve_write(df: DataFrame, path: str, policy: str = "strict", mode: str = "append") -> None:
    """Append with schema rules: refuse differences, add columns, or replace the schema."""
    spark = df.sparkSession
    need(policy in ("strict", "add_columns", "overwrite_schema"), "INVALID_EVOLUTION_POLICY", policy)
    if policy == "overwrite_schema":
        write_files(df, path, mode="overwrite")
        return
    have = spark.read.option("mergeSchema", "true").parquet(path).schema
    names = set(have.names)
    extra = [c for c in df.columns if c not in names]
    changed = [f.name for f in df.schema.fields if f.name in names and f.dataType != have[f.name].dataType]
    need(not changed, "SCHEMA_CHANGED", f"types differ: {changed}")
    if policy == "strict":
        missing = [c for c in have.names if c not in df.columns]
        need(not extra and not missing, "SCHEMA_CHANGED", f"added {extra}, missing {missing}")
    padded = df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in have.fields], *extra
    )
    write_files(padded, path, mode=mode)


#: Rows, and bytes as stored, up to which a file is sorted by the task that writes it.
SORT_ROWS, SORT_BYTES = 2_000_000, 64 << 20


def compact(
    spark: SparkSession, path: str, *, target_files: int, cluster_by: Sequence[str] = (),
    partition: Mapping[str, object] | None = None, partition_by: Sequence[str] = (),
) -> str:
    """Replace a table's files by fewer, clustered ones; returns its path.

    A table in partitions keeps them: ``partition_by`` names all its partition columns, and
    ``partition`` limits the work to some of them, leaving the others as they are. The rows
    are copied to the shared folder first, from which a failed replacement can be repeated.

    Files of more than ``SORT_ROWS`` rows or ``SORT_BYTES`` are not sorted by the tasks that write them: the copy is
    made of sorted slices in several times as many tasks, and each file is put together from its slices in their order.
    Files of a table in partitions that ``partition`` does not name in full are always sorted where they are written.
    """
    need(not partition or bool(partition_by), "MISSING_PARTITIONS", "a part of a table needs its partition columns")
    rows = spark.read.parquet(path)
    need_columns(rows, [*partition_by, *(partition or {})])
    outside = [c for c in partition or {} if c not in partition_by]
    need(not outside, "NOT_A_PARTITION", f"{outside}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    for c, v in (partition or {}).items():
        rows, files = rows.filter(F.col(c) == F.lit(v)), files.filter(F.col(c) == F.lit(v))
    stored = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    slices = math.ceil(max(rows.count() / SORT_ROWS, stored / SORT_BYTES) / target_files)
    inner = [*partition_by, *cluster_by]
    if slices > 1 and cluster_by and set(partition or {}) == set(partition_by):
        laid_out = _from_slices(rows.drop(*partition_by), cluster_by, target_files, slices)
        # Constants, by which the writer need not sort.
        laid_out = laid_out.select("*", *[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in (partition or {}).items()])
    else:
        staged = materialise(rows, "compact")
        laid_out = staged.repartitionByRange(target_files, *inner).sortWithinPartitions(*inner) if inner else staged.repartition(target_files)
    if partition_by:
        overwrite_partitions(laid_out, path, partition_by)
    else:
        write_files(laid_out, path)
    return path


def _from_slices(rows: DataFrame, cluster_by: Sequence[str], target_files: int, slices: int) -> DataFrame:
    """The rows in order, one partition for each file; they are read from sorted slices in the shared folder."""
    spark, folder = rows.sparkSession, scratch_path(rows.sparkSession, "compact")
    # The hash cuts a frequent value, too, into several slices.
    ranges = rows.repartitionByRange(target_files * slices, *cluster_by, row_fallback(rows))
    ranges.sortWithinPartitions(*cluster_by).write.parquet(folder)
    # Written files are numbered by their range; ranges without rows have none.
    names = {name: int(name.split("-")[1]) for name in (f.rsplit("/", 1)[1] for f in spark.read.parquet(folder).inputFiles())}
    each = math.ceil((max(names.values()) + 1) / target_files)
    groups: dict[int, list[DataFrame]] = {}
    for name in sorted(names, key=lambda n: (names[n], n)):
        groups.setdefault(names[name] // each, []).append(spark.read.schema(rows.schema).parquet(f"{folder}/{name}"))
    # A union of single partitions alone would be one partition; a scan of no file beside them keeps them apart.
    nothing = spark.read.schema(rows.schema).parquet(folder).filter(F.col("_metadata.file_name") == "")
    return reduce(DataFrame.union, [*[reduce(DataFrame.union, group).coalesce(1) for group in groups.values()], nothing])


def table_ddl(
    name: str, schema: T.StructType, *, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), buckets: int = 32, location: str | None = None, fmt: str = "parquet"
) -> str:
    """``CREATE TABLE`` for a contract: managed, or external with a location."""
    missing = [c for c in [*partition_by, *cluster_by] if c not in schema.names]
    need(not missing, "UNKNOWN_COLUMN", f"not in the contract: {missing}")
    columns = ",\n  ".join(
        f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema.fields
    )
    parts = [f"CREATE TABLE IF NOT EXISTS {name} (\n  {columns}\n) USING {fmt}"]
    if partition_by:
        parts.append(f"PARTITIONED BY ({', '.join(partition_by)})")
    if cluster_by:
        parts.append(f"CLUSTERED BY ({', '.join(cluster_by)}) INTO {buckets} BUCKETS")
    if location:
        parts.append(f"LOCATION '{location}'")
    return "\n".join(parts)


def publish_table(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite", path: str | None = None
) -> None:
    """Publish a relation under a name: rows and columns stay as they are."""
    writer = df.write.mode(mode).format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def append_quarantine(rejected: DataFrame, path: str, run_id: str, business_date: date) -> None:
    """Append rejected rows with run and date; earlier runs stay untouched."""
    stamped = rejected.withColumns({"quarantine_run_id": F.lit(run_id), "quarantine_ds": F.lit(business_date).cast("date")})
    stamped.write.mode("append").partitionBy("quarantine_ds").parquet(path)


def append_report(report: DataFrame, path: str, run_id: str, business_date: date) -> None:
    report.withColumns({"run_id": F.lit(run_id), "ds": F.lit(business_date).cast("date")}).write.mode("append").parquet(path)


def retain(df: DataFrame, column: str, business_date: date, days: int) -> DataFrame:
    """Rows still inside the retention period."""
    if days <= 0:
        raise ConfigError("INVALID_RETENTION", str(days))
    return df.filter(F.col(column) > F.date_sub(F.lit(business_date), days))
