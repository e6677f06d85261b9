"""Joins over time, history, merges, models and as-of state."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.operators import aggregates, history, joins, merge, modeling, timestate

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)


def test_scd2_runs_are_repeatable(rows, values):
    day1 = rows("id string, tier string, n int", ("a", "S", 1), ("b", "G", None), ("c", "B", 3))
    day2 = rows("id string, tier string, n int", ("a", "G", 1), ("b", "G", None), ("d", "B", 4))
    h1 = history.start_history(day1, ["id"], F.lit(T0))
    h2 = history.track_history(h1, day2, ["id"], ["tier", "n"], T1)
    again = history.track_history(h2, day2, ["id"], ["tier", "n"], T2)
    assert values(again) == values(h2)
    got = [(r["id"], r["tier"], r["valid_from"], r["valid_to"]) for r in h2.orderBy("id", "valid_from").collect()]
    assert got == [("a", "S", T0, T1), ("a", "G", T1, None), ("b", "G", T0, None), ("c", "B", T0, None), ("d", "B", T1, None)]
    closed = history.track_history(h1, day2, ["id"], ["tier", "n"], T1, invalidate_hard_deletes=True)
    assert closed.filter("id = 'c'").first()["valid_to"] == T1
    assert h2.select("version_id").distinct().count() == 5
    with pytest.raises(ConfigError, match="MISSING_BUSINESS_KEY"):
        history.track_history(h1, day2, [], ["tier"], T1)


@pytest.mark.parametrize("unit", [None, "month", "year"])
def test_effective_history(rows, values, unit):
    df = rows(
        "id string, tier string, d date",
        ("a", "S", "2024-01-01"), ("b", "G", "2024-01-01"), ("a", "G", "2024-02-01"), ("b", "G", "2024-02-01"), ("c", "B", "2024-02-01"), ("a", "G", "2025-06-01"), ("a", None, "2025-07-01"),
    )
    got = values(history.effective_history(df, ["id"], ["tier"], "d", slice_by=unit))
    d = date
    assert got == [
        ("a", None, d(2025, 7, 1), None, True), ("a", "G", d(2024, 2, 1), d(2025, 6, 30), False), ("a", "S", d(2024, 1, 1), d(2024, 1, 31), False),
        ("b", "G", d(2024, 1, 1), None, True), ("c", "B", d(2024, 2, 1), None, True),
    ]


def test_bitemporal_correction(rows, values):
    cols = "id string, plan string, eff timestamp, upd timestamp"
    runs = [
        [("s1", "BASIC", "2026-01-01", "2026-01-01 08:00:00"), ("s2", "BASIC", "2026-01-01", "2026-01-01 08:15:00")],
        [("s1", "PRO", "2026-02-01", "2026-02-01 08:00:00"), ("s2", "BASIC", "2026-01-01", "2026-01-01 08:15:00")],
        [("s1", "PLUS", "2026-01-15", "2026-02-10 08:00:00")],
    ]
    everything = rows(cols, *[r for run in runs for r in run])
    twice = everything.unionByName(everything)
    got = history.bitemporal_history(twice, ["id"], "eff", "upd").select("id", "plan", "valid_to", "version", "current_flag")
    assert values(got) == [
        ("s1", "BASIC", datetime(2026, 1, 15), 1, False), ("s1", "PLUS", datetime(2026, 2, 1), 2, False), ("s1", "PRO", None, 3, True), ("s2", "BASIC", None, 1, True),
    ]
    with pytest.raises(ConfigError, match="DUPLICATE_BUSINESS_KEY_IN_RUN"):
        history.check_run_keys(rows("id string", ("a",), ("a",)), ["id"])
    with pytest.raises(ConfigError, match="MISSING_BUSINESS_KEY"):
        history.check_run_keys(rows("id string", ("a",), (None,)), ["id"])


def test_cdc(rows, values):
    target = rows("id string, c string, bal double, st string", ("1", "x", 100.0, "OPEN"), ("2", "y", 250.0, "OPEN"), ("3", "z", 80.0, "OPEN"))
    changes = rows(
        "id string, c string, bal double, st string, op string, seq int",
        ("2", "y", 1.0, "OPEN", "UPSERT", 1), ("2", "y", 275.0, "OPEN", "UPSERT", 2), ("3", "z", None, "CLOSED", "DELETE", 1), ("4", "w", 40.0, "OPEN", "UPSERT", 1), ("5", "v", 1.0, "OPEN", "DELETE", 1),
    )
    done = merge.apply_changes(target, changes, ["id"], "op", ["seq"])
    assert values(done.state) == [("1", "x", 100.0, "OPEN"), ("2", "y", 275.0, "OPEN"), ("4", "w", 40.0, "OPEN")]
    assert values(done.report) == [("2", "updated"), ("3", "deleted"), ("4", "inserted")]
    assert values(merge.apply_changes(done.state, changes, ["id"], "op", ["seq"]).state) == values(done.state)
    soft = merge.apply_changes(target, changes, ["id"], "op", ["seq"], deletes="soft_delete").state
    assert values(soft, "id", "is_deleted") == [("1", False), ("2", False), ("3", True), ("4", False)]
    kept = merge.apply_changes(target, changes, ["id"], "op", ["seq"], deletes="ignore").state
    assert kept.filter("id = '3'").first()["bal"] == 80.0
    with pytest.raises(ConfigError, match="INVALID_MERGE_OPERATION"):
        merge.apply_changes(target, changes.withColumn("op", F.lit("RETRACT")), ["id"], "op", ["seq"])


def test_high_water_of_an_empty_target_means_full_load(rows):
    empty = rows("ts timestamp", ("2024-01-01",)).filter("false")
    mark = merge.high_water(empty, "ts")
    assert merge.newer_than(rows("ts timestamp", ("2024-01-01",)), "ts", mark).count() == 1


@pytest.mark.parametrize("policy,counts", [("recompute", (3, 0, 1)), ("flag_only", (3, 0, 0)), ("quarantine", (2, 1, 0)), ("ignore", (3, 0, 0))])
def test_late_policy(rows, policy, counts):
    df = rows("e timestamp, p timestamp", ("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-04"), ("2024-01-01", "2024-01-04 00:00:01"))
    out = merge.late_policy(df, "e", "p", policy)
    assert (out.accepted.count(), out.quarantined.count(), out.recompute.count()) == counts


@pytest.mark.parametrize("limit", [0, 1000])
def test_temporal_join_both_ways(spark, rows, values, limit):
    facts = rows("k string, t timestamp, n int", ("a", "2024-01-05", 1), ("a", "2024-03-10", 2), ("a", "2023-01-01", 3), ("b", "2024-01-01", 4), (None, "2024-01-01", 5), ("a", "2024-02-01", 6))
    dim = rows("k string, f timestamp, u timestamp, g string", ("a", "2024-01-01", "2024-02-01", "old"), ("a", "2024-03-01", None, "new"), ("b", "2023-01-01", "2024-01-01", "gone"))
    got = joins.join_temporal(facts, dim, ["k"], "t", "f", "u", ["g"], max_broadcast=limit)
    assert values(got, "n", "g") == [(1, "old"), (2, "new"), (3, None), (4, None), (5, None), (6, None)]
    inner = joins.join_temporal(facts, dim, ["k"], "t", "f", "u", ["g"], how="inner", max_broadcast=limit)
    assert values(inner, "n") == [(1,), (2,)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_temporal_join_overlaps_and_nulls(rows, values, limit):
    facts = rows("k string, t timestamp, n int", ("a", "2024-02-10", 1), ("a", "2024-02-25", 2), ("a", "2024-01-05", 3), (None, "2024-02-10", 4), ("a", None, 5), ("c", "2024-06-01", 6))
    dim = rows("k string, f timestamp, u timestamp, g string", ("a", "2024-01-01", None, "A1"), ("a", "2024-02-01", "2024-02-20", "A2"), (None, "2024-01-01", None, "N"),
               ("a", None, None, "T"), ("c", "2024-05-01", None, "C1"), ("c", "2024-05-01", None, "C1"))
    got = joins.join_temporal(facts, dim, ["k"], "t", "f", "u", ["g"], max_broadcast=limit)
    assert values(got, "n", "g") == [(1, "A2"), (2, None), (3, "A1"), (4, None), (5, None), (6, "C1")]


def test_history_keeps_one_snapshot_a_day(rows, values):
    df = rows("id int, d timestamp, seq int, tier string", (1, "2024-01-01 08:00:00", 1, "x"), (1, "2024-01-01 09:00:00", 1, "y"), (1, "2024-01-02 09:00:00", 2, "z"), (1, "2024-01-02 09:00:00", 1, "q"))
    out = history.effective_history(df, ["id"], ["tier"], "d", tie_break=["seq"])
    assert [(t, str(a), str(b)) for t, a, b in values(out, "tier", "effective_start", "effective_end")] == [("y", "2024-01-01", "2024-01-01"), ("z", "2024-01-02", "None")]


def test_fuzzy_keeps_nameless_rows(rows, values):
    from millrace.operators import fuzzy

    df = rows("id int, k string, name string", (1, "a", None), (2, "a", None), (3, "a", "bob"), (4, "a", "bobb"))
    assert values(fuzzy.dedupe_fuzzy(df, "name", exact=["k"], order=["id"]), "id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, values, how):
    left = spark.range(2000).select(F.when(F.col("id") < 800, 1).when(F.col("id") < 900, None).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.salted_join(left, right, ["k"], how, hot_rows=100, salts=4)
    assert values(got, "k", "id", "v") == values(left.join(right, "k", how), "k", "id", "v")


def test_join_names(rows):
    left, right = rows("id int, name string", (1, "a")), rows("id int, name string, x int", (1, "b", 2))
    out = joins.join_equi(left, right, ["id"], "left")
    assert out.columns == ["id", "name", "right_id", "right_name", "x"]
    with pytest.raises(ConfigError, match="MISSING_JOIN_KEYS"):
        joins.join_equi(left, right, [])
    right = left.sparkSession.range(10).toDF("z")
    assert joins.join_cross(left, right, max_rows=5).count() == joins.join_cross(left, right).count() == 10 * left.count()


def test_features(rows, values):
    cut = rows("a string, c timestamp", ("x", "2026-05-10"), ("y", "2026-05-10"))
    tx = rows("a string, t timestamp, v double, land string", ("x", "2026-05-02 10:00:00", 100.0, "US"), ("x", "2026-05-08 12:00:00", 50.0, "CA"), ("x", "2026-05-11 09:00:00", 999.0, "US"))
    got = aggregates.windowed_features(
        cut, tx, ["a"], "c", "t",
        {"n7": ("count", 7, None), "s7": ("sum", 7, F.col("v")), "n30": ("count", 30, None), "m30": ("max", 30, F.col("v")), "x30": ("count", 30, F.col("land") != "US")},
    )
    assert values(got.drop("c")) == [("x", 1, 50.0, 2, 100.0, 1), ("y", 0, 0.0, 0, 0.0, 0)]


def test_features_at_many_cutoffs_equal_a_join(spark):
    rng = random.Random(3)
    start = datetime(2024, 3, 1)
    moment = lambda: start + timedelta(minutes=rng.choice([0, 1, 720, 1440]) * rng.randrange(40))
    events = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None] + [moment() for _ in range(9)]), rng.choice([None, 1.5, -2.0, 4.25])) for _ in range(500)]
    cuts = [(k, m) for k in ("a", "hot", "new", None) for m in [moment() for _ in range(12)] + [start + timedelta(days=9)]] + [("a", None)]
    want = {}
    for k, c in set(cuts):
        near = lambda days: [v for ek, t, v in events if k is not None and c is not None and ek == k and t is not None and c - timedelta(days=days) < t <= c]  # noqa: B023, E731
        v1, v5, v9 = ([x for x in near(d) if x is not None] for d in (1, 5, 9))
        want[(k, c)] = (len(near(1)), sum(v1), min(v5, default=0), sum(v5) / len(v5) if v5 else 0, max(v9, default=0), len([x for x in v9 if x > 0]))
    got = aggregates.windowed_features(
        spark.createDataFrame(cuts + cuts[:3], "k string, c timestamp"), spark.createDataFrame(events, "k string, t timestamp, v double"), ["k"], "c", "t",
        {"n1": ("count", 1, None), "s1": ("sum", 1, F.col("v")), "lo5": ("min", 5, F.col("v")), "a5": ("avg", 5, F.col("v")), "hi9": ("max", 9, F.col("v")), "p9": ("count", 9, F.col("v") > 0)},
    ).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[2:] == pytest.approx(want[(r["k"], r["c"])])


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_lists_of_hot_groups_come_in_parts(spark, size):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 5, 5, 5, *range(40)])) for _ in range(600)] + [("void", None)]
    frame = spark.createDataFrame(data, "g string, v int")
    wanted = [{"function": "count", "column": "*", "alias": "n"}, {"function": "collect_list", "column": "v", "alias": "all"}, {"function": "collect_set", "column": "v", "alias": "set"}]
    rows = aggregates.group_aggregate(frame, ["g"], wanted, part_rows=size).collect()
    for g in {g for g, _ in data}:
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["part"])
        values = sorted(v for k, v in data if k == g and v is not None)
        assert [r["part"] for r in mine] == list(range(max(1, -(-len(values) // size))))
        assert all(len(r["all"]) <= size and r["n"] == sum(k == g for k, _ in data) for r in mine)
        assert [v for r in mine for v in r["all"]] == values
        assert [v for r in mine for v in r["set"]] == sorted(set(values))


def test_fact_and_mart(rows, values):
    lines = rows("s string, l string, p string, q int, price double", ("1", "a", "P1", 2, 10.0), ("1", "b", "PX", 1, 5.0), ("9", "a", "P1", 1, 1.0), ("9", "a", "P1", 1, 1.0))
    dim = rows("pid string, sku string", ("P1", "SKU-1"), ("P2", None))
    fact, rejected = modeling.build_fact(lines, ["s", "l"], [modeling.Dimension(dim, [("p", "pid")], ["sku"])], {"gross": "q * price", "net": "gross - 1"})
    assert values(fact, "s", "l", "sku", "net") == [("1", "a", "SKU-1", 19.0), ("1", "b", "UNKNOWN", 4.0)]
    assert rejected.count() == 2
    double = dim.unionByName(dim)
    with pytest.raises(ConfigError, match="DUPLICATE_DIMENSION_KEY"):
        modeling.wide_mart(lines, ["s", "l"], [modeling.Dimension(double, [("p", "pid")], ["sku"])], [], {})


def test_late_dimension_retry_keeps_the_key(rows):
    events = rows("id string, c string, t timestamp, ds date", ("e1", "c1", "2024-01-10", "2024-01-10"))
    none_yet = rows("c string, valid_from timestamp, valid_to timestamp, sk string", ("zz", "2020-01-01", None, "Z"))
    day1 = modeling.fact_with_late_dimension(events, events.withColumn("dim_resolved_at", F.lit(None).cast("timestamp")).filter("false"), none_yet, "c", "t", ["id"], "sk", date(2024, 1, 10))
    first = day1.first()
    assert first["sk"] is None and first["gave_up"] is False
    known = none_yet.unionByName(rows("c string, valid_from timestamp, valid_to timestamp, sk string", ("c1", "2020-01-01", None, "S1")))
    day5 = modeling.fact_with_late_dimension(events.filter("false"), day1, known, "c", "t", ["id"], "sk", date(2024, 1, 15)).first()
    assert day5["sk"] == "S1" and day5["fact_pk"] == first["fact_pk"]
    day8 = modeling.fact_with_late_dimension(events.filter("false"), day1, none_yet, "c", "t", ["id"], "sk", date(2024, 1, 18)).first()
    assert day8["gave_up"] is True


def test_reference_validity_sees_long_periods(rows, values):
    pub = rows("code string, s date, e date", ("US", "2020-01-01", None))
    new = rows(
        "code string, s date, e date",
        ("US", "2021-01-01", None), ("CA", "2022-01-01", "2030-01-01"), ("CA", "2023-01-01", "2023-02-01"), ("CA", "2025-01-01", "2025-02-01"), ("XK", "2027-01-01", None), ("MX", "2020-01-01", "2020-12-31"), ("MX", "2021-01-01", None),
    )
    split = modeling.publish_reference_validity(pub, new, ["code"], "s", "e")
    assert values(split.accepted, "code") == [("MX",), ("MX",), ("US",), ("XK",)]
    assert values(split.rejected, "code", "reject_reason") == [("CA", "overlapping-validity")] * 3 + [("US", "duplicate-key")]


def test_hierarchy(rows, values):
    chain = [(str(i), str(i - 1) if i else None) for i in range(30)] + [("x", "missing")]
    assert dict(values(modeling.hierarchy_depth(rows("n string, p string", *chain), "n", "p"), "n", "depth")) == {**{str(i): i for i in range(30)}, "x": 0}
    with pytest.raises(ConfigError, match="CYCLIC_HIERARCHY"):
        modeling.hierarchy_depth(rows("n string, p string", ("a", "b"), ("b", "a")), "n", "p", max_rounds=5)


def test_advance(rows, values):
    state = rows("dataset string, current_asof date", ("loans", "2026-04-29"), ("cards", "2026-04-30"))
    ask = rows(
        "dataset string, requested_asof date, run_id string, actor string, requested_at timestamp",
        ("loans", "2026-04-30", "r1", "job", "2026-05-06"), ("cards", "2026-04-29", "r2", "job", "2026-05-06"),
    )
    done = timestate.advance(state, ask)
    assert values(done.state) == [("cards", date(2026, 4, 30)), ("loans", date(2026, 4, 30))]
    assert values(done.audit, "dataset", "status") == [("cards", "REJECTED"), ("loans", "ACCEPTED")]
    assert timestate.advance(done.state, ask, done.audit).audit.count() == 0


def test_window_on_a_clock_change(rows):
    state = rows("dataset string, current_asof date, timezone string", ("d", "2026-03-08", "America/New_York"))
    at = rows("dataset string, t timestamp, n int", ("d", "2026-03-08 04:59:59", 1), ("d", "2026-03-08 05:00:00", 2), ("d", "2026-03-09 03:59:59", 3), ("d", "2026-03-09 04:00:00", 4))
    assert [r["n"] for r in timestate.select_window(at, "t", state).orderBy("n").collect()] == [2, 3]


def test_next_asof(rows, values):
    df = rows(
        "id int, current_asof timestamp, time_grain string, timezone string",
        (1, "2024-03-29 00:00:00", "DAILY_BUSINESS_DAY", "UTC"), (2, "2024-01-31 00:00:00", "END_OF_MONTH", "UTC"), (3, "2024-03-31 00:00:00", "END_OF_QUARTER", "UTC"),
        (4, "2024-11-15 00:00:00", "BEG_OF_QUARTER", "UTC"), (5, "2024-03-10 05:00:00", "DAILY", "America/New_York"), (6, "2024-05-01 00:00:00", "WEEKLY", "UTC"),
        (7, "2024-03-10 05:00:00", "EVERY_N_HOURS", "America/New_York"), (8, "2024-05-01 00:00:00", "CONTINUOUS", "UTC"),
    )
    df = df.withColumns({"weekdays": F.array(F.lit("MON"), F.lit("WED")), "interval_hours": F.lit(2)})
    got = dict(values(timestate.next_asof(df), "id", "next_asof"))
    assert got == {
        1: datetime(2024, 4, 1), 2: datetime(2024, 2, 29), 3: datetime(2024, 6, 30), 4: datetime(2025, 1, 1), 5: datetime(2024, 3, 11, 4),
        6: datetime(2024, 5, 6), 7: datetime(2024, 3, 10, 7), 8: datetime(2024, 5, 1),
    }


@pytest.mark.parametrize("deletes,left", [("hard_delete", [(2, "b2", None), (5, "e", None)]), ("ignore", [(1, "a", "x"), (2, "b2", "y"), (3, "c", "z"), (4, "d", None), (5, "e", None)])])
def test_truncate_clears_what_came_before(rows, values, deletes, left):
    target = rows("id int, v string, own string", (1, "a", "x"), (2, "b", "y"), (3, "c", "z"))
    changes = rows(
        "id int, v string, op string, seq int",
        (4, "d", "UPSERT", 1), (None, None, "TRUNCATE", 1), (None, None, "TRUNCATE", 3), (3, "c3", "DELETE", 3), (2, "b2", "UPSERT", 4), (5, "e", "UPSERT", 4),
    )
    done = merge.apply_changes(target, changes, ["id"], "op", ["seq"], deletes=deletes)
    assert values(done.state, "id", "v", "own") == left
    soft = merge.apply_changes(target, changes, ["id"], "op", ["seq desc"], deletes="soft_delete").state
    assert values(soft, "id", "is_deleted") == [(1, True), (2, False), (3, True), (5, False)]
    if deletes == "hard_delete":
        assert values(done.report, "id", "action") == [(1, "deleted"), (2, "updated"), (3, "deleted"), (5, "inserted")]


def test_validity_by_slices_equals_the_broadcast_join(spark):
    rng = random.Random(5)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(400))
    left = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *[day() for _ in range(8)]])) for i in range(400)]
    spans = [(rng.choice(["hot", "b", None]), day(), rng.choice([None, day()]), f"p{i}") for i in range(12)] + [("hot", None, day(), "x"), ("b", date(2030, 1, 1), None, "y")]
    rows = spark.createDataFrame(left, "id int, k string, d date")
    periods = spark.createDataFrame(spans, "k string, s date, e date, p string")
    both = [joins.join_validity(rows, periods, ["k"], "d", "s", "e", ["p"], **how) for how in ({}, {"max_broadcast": 0, "hot_rows": 5, "salts": 3})]
    plain, sliced = (sorted(map(str, map(tuple, df.collect()))) for df in both)
    assert plain == sliced and both[0].columns == both[1].columns


def test_cut_periods_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    # No key is hot, so Spark drops the join to the hot ones and sizes the other side anew.
    spark.range(300).selectExpr("id AS k", "DATE '2000-01-01' AS s", "CAST(NULL AS DATE) AS e", "concat('p', id) AS p").write.parquet(f"{tmp_path}/periods")
    spark.range(3000).selectExpr("id % 300 AS k", "date_add(DATE '2000-01-01', CAST(id AS INT)) AS d").write.parquet(f"{tmp_path}/rows")
    done = joins.join_validity(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/periods"), ["k"], "d", "s", "e", ["p"], max_broadcast=0)
    assert done.count() == 3000
    ran = done.filter("p IS NOT NULL")
    assert len(ran.collect()) == 3000
    plan = ran._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_sweep_sorts_each_row_once(spark):
    data = spark.createDataFrame([(1, 0, t, 10 * t) for t in (1, 2, 2, 5)], "k int, __s int, __t int, v int")
    probes = spark.createDataFrame([(1, 0, t, kind, f"{t}-{kind}") for t in (0, 2, 9) for kind in (1, 2)], "k int, __s int, __t int, __kind int, name string")
    met = aggregates._sweep(data, probes, ["k", "__s"], {"v": ("sum", 1, F.col("v"))})
    assert {r["name"]: r["v"] for r in met.collect()} == {"0-1": None, "2-1": 50, "9-1": 100, "0-2": 100, "2-2": 50, "9-2": None}
    lines = [x.strip(" :+-") for x in met._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert not any(a.startswith("Window") and b.startswith("Window") for a, b in zip(lines, lines[1:]))
