"""Sources, sinks and streams."""

import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConfigError
from millrace.functions.catalog import missing_functions
from millrace.sinks import kafka, tables
from millrace.sources import files, jdbc, loads
from millrace.streaming import jobs

SCHEMA = "id string, at timestamp, n int, price double"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_tolerant_csv(spark, tmp_path, values):
    write(tmp_path / "good.csv", "id,at,n,price", "a,2024-05-01T09:00:00Z,1,1.5", "b,2024-05-01T09:00:00Z,2,2.5")
    write(tmp_path / "corrupt.csv", "id,at,n,price", "z,not-a-time,many,1.0", "c,2024-05-01T09:00:00Z,3,3.5")
    write(tmp_path / "header.csv", "id,at,n", "q,2024-05-01T09:00:00Z,1")
    write(tmp_path / "empty.csv", "id,at,n,price")
    load = files.read_tolerant_csv(spark, str(tmp_path), T.StructType.fromDDL(SCHEMA))
    assert values(load.accepted, "id", "n") == [("a", 1), ("b", 2), ("c", 3)]
    assert load.rejected.first()["corrupt_record"].startswith("z,")
    assert [r["file"].rsplit("/", 1)[1] for r in load.bad_files.collect()] == ["header.csv"]


def test_paged_json(spark, tmp_path, values):
    for i in range(3):
        write(tmp_path / f"page{i}.json", json.dumps({"result": {"rows": [{"id": i * 10 + j, "u": j} for j in range(2)]}}, indent=1))
    got = files.read_paged_json(spark, str(tmp_path), "result STRUCT<rows: ARRAY<STRUCT<id: INT, u: INT>>>", "result.rows", incremental="u", after=0)
    assert values(got) == [(1, 1), (11, 1), (21, 1)]


def test_inventory(spark, tmp_path):
    for name in ("in/feed_20260506.csv", "in/feed_20260506.csv.tmp", "in/sub/feed_20260506.csv", "other/feed_20260506.csv"):
        write(tmp_path / name, "x")
    listed = loads.list_files(spark, str(tmp_path))
    prefix = f"{tmp_path}/in"
    ready = loads.file_readiness(loads.match_files(listed, prefix, "feed_{yyyyMMdd}.csv", business_date=date(2026, 5, 6))).first()
    assert (ready["file_count"], ready["is_ready"]) == (1, True)
    late = loads.match_files(listed, prefix, "feed_*.csv", kind="glob", max_age_minutes=60, now=datetime(2099, 1, 1))
    assert loads.file_readiness(late, "many").first()["is_ready"] is False
    with pytest.raises(ConfigError, match="INVALID_PATTERN_KIND"):
        loads.match_files(listed, prefix, "x", kind="sql")


def test_jdbc_options():
    c = jdbc.connection_options("postgres", "db", "sales", user="u")
    assert c == {"driver": "org.postgresql.Driver", "url": "jdbc:postgresql://db:5432/sales", "user": "u"}
    p = jdbc.partitioned_options(c, "t", "id", 1, 100)
    assert (p["numPartitions"], p["fetchsize"], p["lowerBound"], p["dbtable"]) == ("8", "10000", "1", "t")
    q = jdbc.query_options(c, "SELECT * FROM t WHERE d >= '[[BOM]]'", {"BOM": date(2024, 1, 1)})
    assert q["query"].endswith("'2024-01-01'")
    with pytest.raises(ConfigError, match="UNKNOWN_MNEMONIC"):
        jdbc.query_options(c, "SELECT [[XX]]")
    with pytest.raises(ConfigError, match="UNKNOWN_CONNECTOR"):
        jdbc.connection_options("paper", "h", "d")


def test_write_options(rows):
    assert tables.jdbc_write_options({"url": "x"}, "t", "upsert")["dbtable"] == "t_staging"
    assert "ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v" in tables.upsert_statement("t", ["id", "v"], ["id"])
    assert tables.upsert_statement("t", ["id", "v"], ["id"], "oracle").startswith("MERGE INTO t t USING t_staging s ON t.id = s.id")
    assert kafka.writer_options("b:1", "t", "exactly_once")["kafka.enable.idempotence"] == "true"
    with pytest.raises(ConfigError, match="UNKNOWN_WAREHOUSE"):
        tables.warehouse_writer(rows("a int", (1,)), "shed", "t")
    assert tables.warehouse_writer(rows("a int", (1,)), "bigquery", "t") is not None
    ddl = tables.table_ddl("x.y", T.StructType.fromDDL("a INT NOT NULL, ds DATE"), partition_by=["ds"], cluster_by=["a"], location="/p")
    assert "`a` int NOT NULL" in ddl and "PARTITIONED BY (ds)" in ddl and "CLUSTERED BY (a) INTO 32 BUCKETS" in ddl


def test_pre_upsert(rows, values):
    df = rows("id string, amt double, u timestamp", ("1", 1.0, "2026-05-01"), ("1", 2.0, "2026-05-03"), ("2", 8.0, "2026-05-02"), ("2", 8.0, "2026-05-02"), (None, 3.0, "2026-05-04"), ("", 4.0, "2026-05-04"))
    split = tables.prepare_upsert(df, ["id"], "u")
    assert values(split.accepted, "id", "amt") == [("1", 2.0), ("2", 8.0)] and split.rejected.count() == 2


def test_evolution_policies(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    tables.write_files(rows("a int, b string", (1, "x")), path)
    with pytest.raises(ConfigError, match="SCHEMA_CHANGED"):
        tables.evolve_write(rows("a int, c string", (2, "y")), path, "strict")
    with pytest.raises(ConfigError, match="SCHEMA_CHANGED"):
        tables.evolve_write(rows("a string, b string", ("2", "y")), path, "add_columns")
    tables.evolve_write(rows("a int, c string", (2, "y")), path, "add_columns")
    assert spark.read.option("mergeSchema", "true").parquet(path).columns == ["a", "b", "c"]
    tables.evolve_write(rows("z int", (9,)), path, "overwrite_schema")
    assert spark.read.parquet(path).columns == ["z"]
    with pytest.raises(ConfigError, match="SCHEMA_CHANGED"):
        files.evolve_union(rows("a int", (1,)), rows("b int", (1,)), "strict")


def test_audit_columns_from_file_names(spark, tmp_path, rows):
    tables.write_files(rows("a int", (1,)).coalesce(1), str(tmp_path / "stage"))
    source = next((tmp_path / "stage").glob("part-*.parquet"))
    target = tmp_path / "in" / "feed_20240229231500.parquet"
    target.parent.mkdir()
    target.write_bytes(source.read_bytes())
    df = spark.read.parquet(str(target.parent))
    args = dict(pipeline="p", task="t", run_id="r", dag_id="d", business_date=date(2024, 2, 29), run_time=datetime(2024, 3, 1))
    named = tables.add_audit_columns(df, processing_time="file_name", **args).first()
    assert named["_audit_processing_ts"] == datetime(2024, 2, 29, 23, 15) and named["_audit_source_uri"].endswith("feed_20240229231500.parquet")
    assert tables.add_audit_columns(df, processing_time="file_modified", **args).first()["_audit_processing_ts"] is not None
    assert len(tables.add_audit_columns(df, source_uri="jdbc:x", **args).columns) == 9
    with pytest.raises(ConfigError, match="NOT_A_FILE_SOURCE"):
        tables.add_audit_columns(df, source_uri="jdbc:x", processing_time="file_name", **args)


def test_functions_exist(spark):
    assert missing_functions(spark) == []


def test_state_stream_survives_a_restart(spark, tmp_path, rows, values):
    """Three batches; the second start finds the checkpoint and applies only the new file."""
    schema = "id int, v string, op string, seq int"
    source, path, check = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check")
    empty = spark.createDataFrame([], "id int, v string")

    def land(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = jobs.read_files_stream(spark, source, schema, max_files=1)
        jobs.apply_changes_stream(stream, empty, path, check, ["id"], "op", ["seq"], available_now=True).awaitTermination()
        return values(jobs.current_state(spark, path, empty.schema))

    land((1, "a", "UPSERT", 1), (2, "b", "UPSERT", 2))
    land((1, "c", "UPSERT", 3), (3, "d", "UPSERT", 4))
    assert run() == [(1, "c"), (2, "b"), (3, "d")]
    land((2, None, "DELETE", 5), (4, "e", "UPSERT", 6))
    assert run() == [(1, "c"), (3, "d"), (4, "e")]
    assert run() == [(1, "c"), (3, "d"), (4, "e")]


def test_state_stream_rewrites_only_touched_buckets(spark, tmp_path):
    schema = "id int, v string, op string, seq int"
    source, path, check = str(tmp_path / "in"), tmp_path / "state", tmp_path / "check"
    empty = spark.createDataFrame([], "id int, v string")

    def run(*data):
        if data:
            spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_files_stream(spark, source, schema, max_files=1)
        jobs.apply_changes_stream(stream, empty, str(path), str(check), ["id"], "op", ["seq"], available_now=True, buckets=8).awaitTermination()
        return sorted(tuple(r) for r in jobs.current_state(spark, str(path), empty.schema).collect())

    files = lambda: {str(f): f.stat().st_mtime_ns for f in path.rglob("version=*/state_bucket=*/*.parquet")}
    every = [(i, f"v{i}") for i in range(40)]
    assert run(*[(i, v, "UPSERT", i) for i, v in every]) == every
    first = files()
    assert run((7, "new", "UPSERT", 50)) == [(i, "new" if i == 7 else v) for i, v in every]
    after = files()
    assert {f: t for f, t in after.items() if f in first} == first and len(after) == len(first) + 1
    want = [(i, "new" if i == 7 else v) for i, v in every if i != 8]
    assert run((8, None, "DELETE", 60), (99, None, "DELETE", 61)) == want
    # The last batch runs again, as after a driver lost before it could report.
    for name in ("2", ".2.crc"):
        (check / "commits" / name).unlink(missing_ok=True)
    assert run() == want
    assert run((None, None, "TRUNCATE", 70), (3, "kept", "UPSERT", 71)) == [(3, "kept")]
    assert run((3, None, "DELETE", 80)) == []
    assert run((5, "again", "UPSERT", 90)) == [(5, "again")]


def test_merge_files_touches_only_its_partitions(spark, tmp_path, rows, values):
    path = str(tmp_path / "t")
    tables.overwrite_partitions(rows("id int, v int, ds date", (1, 1, "2024-01-01"), (2, 2, "2024-01-02")), path, ["ds"])
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "ds=2024-01-02").iterdir()}
    delta = rows("id int, v int, ds date", (1, 9, "2024-01-01"), (5, 5, "2024-01-01"))
    for _ in range(2):
        tables.merge_files(spark, path, delta, ["id"], ["v desc"], ["ds"])
    assert values(spark.read.parquet(path), "id", "v") == [(1, 9), (2, 2), (5, 5)]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "ds=2024-01-02").iterdir()} == before


def test_merge_files_follows_a_key_to_its_new_partition(spark, tmp_path, rows, values):
    path = str(tmp_path / "t")
    tables.overwrite_partitions(rows("id int, v int, ds date", (1, 1, "2024-01-01"), (2, 2, "2024-01-02"), (3, 3, "2024-01-02"), (4, 4, None)), path, ["ds"])
    delta = rows("id int, v int, ds date", (1, 9, "2024-01-02"), (5, 5, None))
    for _ in range(2):
        tables.merge_files(spark, path, delta, ["id"], ["v desc"], ["ds"])
    assert values(spark.read.parquet(path), "id", "v") == [(1, 9), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["ds=2024-01-02", "ds=__HIVE_DEFAULT_PARTITION__"]


def test_compact_keeps_partitions(spark, tmp_path, rows, values):
    path = str(tmp_path / "t")
    tables.overwrite_partitions(rows("id int, ds date", *[(i, f"2024-01-0{1 + i % 2}") for i in range(20)]).repartition(5), path, ["ds"])
    done = tables.compact(spark, path, target_files=1, cluster_by=["id"], partition={"ds": date(2024, 1, 1)}, partition_by=["ds"])
    assert done == path and sorted(values(spark.read.parquet(path), "id")) == [(i,) for i in range(20)]
    assert len(list((tmp_path / "t" / "ds=2024-01-01").glob("*.parquet"))) == 1
    assert len(list((tmp_path / "t" / "ds=2024-01-02").glob("*.parquet"))) > 1
    with pytest.raises(ConfigError, match="MISSING_PARTITIONS"):
        tables.compact(spark, path, target_files=1, partition={"ds": date(2024, 1, 1)})


@pytest.mark.parametrize("partitioned", [False, True])
def test_compact_puts_large_files_together_from_sorted_slices(spark, tmp_path, values, monkeypatch, partitioned):
    # Half of the rows have one value of the cluster column, some have none.
    made = spark.range(6000).select("id", F.expr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 9 > 0 THEN id * 37 % 1000 END").alias("k"))
    path, folder = str(tmp_path / "t"), tmp_path / "t"
    if partitioned:
        made.withColumn("ds", F.expr("date_add(DATE '2024-01-01', cast(id % 3 as int))")).repartition(7).write.partitionBy("ds").parquet(path)
        folder = folder / "ds=2024-01-02"
    else:
        made.repartition(7).write.parquet(path)
    rows = values(spark.read.parquet(path))
    folders = []
    real = tables.scratch_path
    monkeypatch.setattr(tables, "scratch_path", lambda s, label: folders.append(real(s, label)) or folders[-1])
    monkeypatch.setattr(tables, "SORT_ROWS", 100)
    part = {"partition": {"ds": date(2024, 1, 2)}, "partition_by": ["ds"]} if partitioned else {}
    others = {p.name for p in tmp_path.glob("t/ds=*/*.parquet") if p.parent != folder}
    tables.compact(spark, path, target_files=3, cluster_by=["k"], **part)
    assert values(spark.read.parquet(path)) == rows
    assert {p.name for p in tmp_path.glob("t/ds=*/*.parquet") if p.parent != folder} == others
    # No slice holds much more than its share, even of the frequent value.
    slices = spark.read.parquet(folders[0]).groupBy(F.col("_metadata.file_name")).count()
    assert slices.count() >= 15 and slices.agg(F.max("count")).first()[0] <= 400
    # Each file is in order, and files follow each other.
    files = sorted(folder.glob("*.parquet"))
    assert len(files) == 3
    inside = [[r["k"] for r in spark.read.parquet(str(f)).select("k").coalesce(1).collect()] for f in files]
    key = lambda v: (v is not None, v or 0)
    assert [v for f in inside for v in f] == sorted((v for f in inside for v in f), key=key)
    assert min(map(len, inside)) > max(map(len, inside)) / 2


def parts_by_batch(path):
    return {(p.parent.name, p.name) for p in path.glob("batch=*/part=*")}


def test_rollup_store_closes_windows_once_and_drops_late_rows(spark, tmp_path, rows, values):
    from pyspark.sql import functions as F

    from millrace.streaming import jobs

    source, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run(*times):
        rows("id int, ts timestamp", *enumerate(times)).write.mode("append").parquet(source)
        stream = jobs.read_files_stream(spark, source, "id int, ts timestamp")
        made = [F.count(F.lit(1)).alias("n"), F.max("ts").alias("seen")]
        hourly = jobs.window_aggregate(stream, "ts", "1 hour", [], made, watermark="2 hours")
        started = jobs.rollup_stream(hourly, path, check, ["window_start"], end="window_end", seen="seen", delay="2 hours", available_now=True)
        started.awaitTermination()
        out = jobs.read_rollup(spark, path, hourly.schema)
        return values(out.select(F.hour("window_start").alias("h"), "n", "part"), "h", "n", "part")

    assert run("2024-01-01 08:10:00", "2024-01-01 14:10:00") == [(14, 1, "open"), (8, 1, "closed")]
    # Two hours before 14:10 a window that ended at 9:00 is closed, that of 13:00 is not.
    assert run("2024-01-01 08:20:00", "2024-01-01 13:20:00", "2024-01-01 14:20:00") == [(13, 1, "open"), (14, 2, "open"), (8, 1, "closed")]
    assert run("2024-01-02 01:00:00") == [(1, 1, "open"), (13, 1, "closed"), (14, 2, "closed"), (8, 1, "closed")]
    found = parts_by_batch(tmp_path / "out")
    last = max(int(b.split("=")[1]) for b, _ in found)
    assert {b for b, p in found if p == "part=open"} <= {f"batch={last}", f"batch={last - 1}"}
    assert len([b for b, p in found if p == "part=closed"]) == 2


def test_session_store_equals_sessions_of_all_rows(spark, tmp_path, values):
    import random

    from pyspark.sql import functions as F

    from millrace.streaming import jobs

    source, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rng, start = random.Random(5), datetime(2024, 1, 1)
    made = {"n": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}
    schema, data = "k int, ts timestamp, v int", []
    for day in range(4):  # days overlap by less than the delay
        batch = [(rng.choice([1, 1, 1, 2, None]), start + timedelta(minutes=day * 1440 + rng.randrange(-300, 1440)), rng.choice([None, *range(9)])) for _ in range(60)]
        data += batch
        spark.createDataFrame([*batch, (1, None, 5)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_files_stream(spark, source, schema)
        jobs.session_store(stream, path, check, "ts", "40 minutes", ["k"], made, delay="1 day", available_now=True).awaitTermination()
    late = spark.createDataFrame([(1, start + timedelta(minutes=5), 3)], schema)
    late.coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_files_stream(spark, source, schema)
    jobs.session_store(stream, path, check, "ts", "40 minutes", ["k"], made, delay="1 day", available_now=True).awaitTermination()
    got = jobs.read_rollup(spark, path, jobs.session_schema(stream, "ts", ["k"], made))
    w = F.session_window("ts", "40 minutes")
    plain = spark.createDataFrame(data, schema).groupBy(w.alias("w"), "k").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    plain = plain.select("k", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *made)
    assert values(got.drop("part")) == values(plain)
    assert {r["part"] for r in got.select("part").distinct().collect()} == {"open", "closed"}
    assert len([p for _, p in parts_by_batch(tmp_path / "out") if p == "part=open"]) <= 2


def test_a_repeated_batch_of_a_store_replaces_itself(spark, tmp_path, rows, values):
    from pyspark.sql import functions as F

    from millrace.streaming import jobs

    path = str(tmp_path / "out")
    day = rows("k int, at timestamp, n long", (1, "2024-01-01", 3), (2, "2024-01-05", 1))
    jobs._write_parts(day, F.col("k") == 1, path, 0)
    for _ in range(2):
        base = jobs._open_part(spark, path, day.schema, 1)
        jobs._write_parts(base.withColumn("n", F.col("n") + 1), F.lit(False), path, 1)
    assert values(jobs.read_rollup(spark, path, day.schema), "k", "n", "part") == [(1, 3, "closed"), (2, 2, "open")]
    with pytest.raises(ConfigError, match="NO_VERSION"):
        jobs._open_part(spark, path, day.schema, 7)


def test_backfill_plan(spark):
    plan = loads.plan_chunks(spark, date(2024, 1, 1), date(2024, 1, 10), 4).collect()
    assert [(r["chunk_start"].day, r["chunk_end"].day) for r in plan] == [(1, 4), (5, 8), (9, 10)]
    with pytest.raises(ConfigError, match="INVALID_RANGE"):
        loads.plan_chunks(spark, date(2024, 1, 2), date(2024, 1, 1), 4)


def test_poll_without_rows_keeps_the_mark(rows):
    df = rows("t timestamp", ("2024-01-01",))
    assert loads.poll(df, "t", datetime(2024, 6, 1)).mark == datetime(2024, 6, 1)
    assert loads.poll(df, "t", datetime(2023, 6, 1)).mark == datetime(2024, 1, 1)


def test_interleave(rows):
    a, b = rows("id int", (1,), (2,), (3,)), rows("id int", (10,), (20,))
    got = files.fan_in({"a": a, "b": b}, "interleave", order="id").collect()
    assert [r["id"] for r in got] == [1, 10, 2, 20, 3]


@pytest.mark.parametrize("kind", ["epoch", "fifty", "hot", "text", "double", "date"])
def test_even_slices(spark, kind):
    """Slices rise with (value, tie) and are balanced, whatever the range; a value in a third of the rows is split."""
    import random

    from millrace.functions.quantiles import with_even_slices

    rng = random.Random(11)
    n = 6000
    data = {
        "epoch": [1_700_000_000_000_000 + rng.randrange(10**9) for _ in range(n)], "fifty": [rng.randrange(50) for _ in range(n)],
        "hot": [7 if i % 3 == 0 else None if i % 3 == 1 else rng.randrange(10**6) for i in range(n)], "text": [f"{rng.randrange(10**6):06d}é" for _ in range(n)],
        "double": [rng.choice([float("nan"), float("inf"), -0.0, rng.lognormvariate(0, 5)]) if i % 9 == 0 else rng.lognormvariate(0, 5) for i in range(n)],
        "date": [date(2024, 1, 1) + timedelta(days=rng.randrange(4000)) for _ in range(n)],
    }[kind]
    types = {"text": "string", "double": "double", "date": "date"}
    df = spark.createDataFrame([(v, i) for i, v in enumerate(data)], f"a {types.get(kind, 'long')}, id int").withColumn("t", F.xxhash64("id"))
    got = [r["s"] for r in with_even_slices(df, "a", F.col("t"), "s", 200).orderBy("a", "t").collect()]
    assert got == sorted(got)
    sizes = {s: got.count(s) for s in set(got)}
    assert max(sizes.values()) <= 600 and 20 <= len(sizes)
    empty = with_even_slices(df.limit(0), "a", F.col("t"), "s", 200)
    assert empty.collect() == [] and empty.columns == ["a", "id", "t", "s"]


def test_interleave_numbers_every_row_once(spark):
    a = spark.createDataFrame([(i % 7 or None, i) for i in range(300)], "k int, id int")
    b = spark.createDataFrame([(5, 1000 + i) for i in range(50)], "k int, id int")
    got = files.fan_in({"a": a, "b": b}, "interleave", order="k", rows_per_slice=20).collect()
    assert [r["source"] for r in got[:100]] == ["a", "b"] * 50
    own = [(r["k"] or 0, r["position"]) for r in got if r["source"] == "a"]
    assert [p for _, p in own] == list(range(1, 301)) and own == sorted(own)


def test_infer_types(rows):
    df = rows("a string, b string, c string", ("1", "2024-01-01", "x"), ("-2.5", "", "1"), ("3", None, "2"))
    got = {r["column_name"]: (r["inferred_type"], r["is_nullable"]) for r in files.infer_types(df).collect()}
    assert got == {"a": ("decimal", False), "b": ("date", True), "c": ("string", False)}


def test_steps(rows):
    from millrace.plans.steps import apply_steps

    df = rows("a int, b string", (1, " x "), (2, "y"))
    out = apply_steps(df, [("trim", {"columns": ["b"]}), ("filter_sql", {"predicate": "a < 2"}), ("rename", {"names": {"b": "c"}})])
    assert [tuple(r) for r in out.collect()] == [(1, "x")]
    with pytest.raises(ConfigError, match="UNKNOWN_STEP"):
        apply_steps(df, [("fly", {})])
    assert F is not None


def test_merge_reads_only_partitions_that_may_hold_the_keys(spark, rows, tmp_path):
    import glob

    path = f"file://{tmp_path}/t"
    table = [(i, i % 5 if i % 5 else None, 0.0) for i in range(3000)]
    kinds = "id long, p int, v double"
    tables.overwrite_partitions(spark.createDataFrame(table, kinds), path, ["p"])
    want = {i: (p, v) for i, p, v in table}
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/t/p=*/*.parquet")}

    def merge(*delta):
        want.update({i: (p, v) for i, p, v in delta})
        tables.merge_files(spark, path, spark.createDataFrame([(*d, 1) for d in delta], kinds + ", seq int"), ["id"], ["seq desc"], ["p"])
        got = {r["id"]: (r["p"], r["v"]) for r in spark.read.parquet(path).collect()}
        assert got == want and spark.read.parquet(path).count() == len(want)

    merge((7, 2, 1.0))  # no filters yet: all partitions are looked into and get one
    current = tables._partition_files(spark, path, ["p"])
    keys = lambda *k: spark.createDataFrame([(i,) for i in k], "id long")
    name = {p: f'{{"p":"{p if p else "__HIVE_DEFAULT_PARTITION__"}"}}' for p in (None, 1, 2, 3, 4)}
    for k in range(0, 3000, 97):  # a filter never hides a key
        stale, found = tables._candidates(spark, path, keys(k), ["id"], current)
        assert not stale and name[want[k][0]] in found
    stale, found = tables._candidates(spark, path, keys(*range(10_000, 10_020)), ["id"], current)
    assert not stale and len(found) <= 2
    before = files()
    merge((8, 4, 2.0), (8 + 3000, 4, 2.0))  # moves from 3 to 4; 1, 2 and the null partition stay as they are
    after = files()
    assert {f for f in before if f in after and before[f] == after[f]} >= {f for f in before if "p=1/" in f or "p=2/" in f or "p=__" in f}
    spark.createDataFrame([(5000, 9.0)], "id long, v double").write.mode("append").parquet(f"{path}/p=1")
    want[5000] = (1, 9.0)
    merge((5000, 2, 3.0))  # files that a filter does not know are read
    merge(*[(i, 3, 4.0) for i, (p, _) in list(want.items()) if p is None])  # the null partition is left empty
    assert not glob.glob(f"{tmp_path}/t/p=__HIVE*")
    merge(*[(i, None, 5.0) for i in range(3)])


def test_key_filters_meet_their_block_before_they_are_aggregated(spark, tmp_path, monkeypatch):
    import re

    path = f"file://{tmp_path}/t"
    tables.overwrite_partitions(spark.range(5000).selectExpr("id", "id % 3 AS p"), path, ["p"])
    names = {p for p, _, _ in tables._partition_files(spark, path, ["p"])}
    made = []
    monkeypatch.setattr(tables, "overwrite_partitions", lambda df, *_: made.append(df))
    tables._write_filters(spark, path, ["id"], ["p"], names)
    found = made[0].collect()
    assert len(found) == 3 and {r["blocks"] for r in found} == {1}  # up to 2,048 keys have one block
    for r in found:
        part = int(re.search(r"\d+", r["p"]).group())
        keys = spark.range(5000).filter(F.col("id") % 3 == part).select(*tables._key_bits(["id"], F.lit(1)))
        want = {b for k in keys.collect() for b in k["bits"]}
        assert {i for i in range(32768) if r["bitmap"][i // 8] >> i % 8 & 1} == want
    # No task of a scan sorts its rows for the bitmaps: they are shuffled by block first.
    plan = made[0]._jdf.queryExecution().sparkPlan().toString() + made[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    below = plan[plan.rindex("partial_bitmap_construct_agg") :]
    assert re.search(r"Exchange hashpartitioning|HashJoin", below).group().startswith("Exchange")
