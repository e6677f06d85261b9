"""Sliced windows must equal plain windows, with ties, nulls and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.operators import windows as W


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        day = rng.randrange(40) if rng.random() < 0.9 else rng.choice([0, 39])
        value = None if rng.random() < 0.1 else float(rng.randrange(100))
        data.append((i, key, day, value))
    df = spark.createDataFrame(data, "id int, k string, d int, v double")
    return df.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))


def both(series, values, call, slice_by=lambda: F.trunc("day", "week")):
    names = lambda df: [c for c in df.columns if c not in ("k", "d", "v", "day")]
    plain, sliced = call(None), call(slice_by())
    assert values(sliced, *names(sliced)) == values(plain, *names(plain))


@pytest.mark.parametrize("order", [["day", "id"], ["day desc", "id"]])
def test_rolling_rows(series, values, order):
    both(series, values, lambda s: W.rolling_rows(series, ["k"], order, {"s": F.sum("v"), "n": F.count("v"), "m": F.max("v")}, 5, slice_by=s))


@pytest.mark.parametrize("order", [["day", "id"], ["day desc", "id"]])
def test_lag_lead(series, values, order):
    both(series, values, lambda s: W.lag_lead(series, ["k"], order, {"l1": ("v", 1), "l4": ("id", 4)}, {"n2": ("id", 2)}, slice_by=s))


def test_long_lag_crosses_many_short_slices(series, values):
    both(series, values, lambda s: W.lag_lead(series, ["k"], ["day", "id"], {"far": ("id", 200)}, slice_by=s), lambda: F.col("day"))


@pytest.mark.parametrize("order", [["day", "id"], ["day desc", "id"]])
def test_running(series, values, order):
    both(series, values, lambda s: W.running(series, ["k"], order, {"s": ("sum", F.col("v")), "x": ("max", F.col("v"))}, slice_by=s))


@pytest.mark.parametrize("order", [["day"], ["day desc"], ["day", "id"]])
def test_rank_family(series, values, order):
    made = {"r": "rank", "d": "dense_rank", "c": "cume_dist", "p": "percent_rank"}
    if len(order) > 1:
        made |= {"n": "row_number", "t": "ntile(9)", "t2": "ntile(5000)"}
    both(series, values, lambda s: W.rank_family(series, ["k"], order, made, slice_by=s))


def test_specs(series, values):
    by = {"partition_by": ["k"], "order_by": ["day", "id"]}
    specs = [
        {"column": "a", "function": "sum", "argument": "v", "frame": "rows between 3 preceding and 2 following", **by},
        {"column": "b", "function": "lead", "argument": "id", "offset": 3, **by},
        {"column": "c", "function": "ntile(4)", **by},
        {"column": "e", "function": "count", "argument": "v", **by},
    ]
    both(series, values, lambda s: W.apply_specs(series, specs, slice_by=s))


FRAMES = [
    ("rows", "unbounded preceding", "3 following"), ("rows", "unbounded preceding", "2 preceding"), ("rows", "current row", "unbounded following"),
    ("rows", "4 preceding", "unbounded following"), ("rows", "2 following", "unbounded following"), ("rows", "unbounded preceding", "unbounded following"),
    ("rows", "5 preceding", "2 preceding"), ("rows", "1 following", "6 following"), ("range", "unbounded preceding", "current row"), ("range", "current row", "unbounded following"),
]


@pytest.mark.parametrize("order", [["day", "id"], ["day desc", "id desc"]])
def test_frames_to_either_end_equal_plain_frames(series, values, order):
    timed = series.withColumn("day", F.when(F.col("id") % 9 != 0, F.col("day")))
    specs, plain = [], []
    for i, (kind, first, last) in enumerate(FRAMES):
        by = order[:1] if kind == "range" else order
        for fn in ("sum", "count", "max", "avg"):
            specs.append({"column": f"{fn}_{i}", "function": fn, "argument": "v", "frame": f"{kind} between {first} and {last}", "partition_by": ["k"], "order_by": by})
            plain.append(f"{fn}(v) over (partition by k order by {', '.join(by)} {kind} between {first} and {last}) as {fn}_{i}")
    specs += [{"column": "back", "function": "lag", "argument": "id", "offset": 3, "default": -1, "partition_by": ["k"], "order_by": order},
              {"column": "on", "function": "lead", "argument": "v", "offset": 2, "default": 0.5, "partition_by": ["k"], "order_by": order}]
    by = ", ".join(order)
    plain += [f"lag(id, 3, -1) over (partition by k order by {by}) as back", f"lead(v, 2, 0.5D) over (partition by k order by {by}) as on"]
    names = ["id", *[s["column"] for s in specs]]
    want = values(timed.selectExpr("id", *plain), *names)
    assert values(W.apply_specs(timed, specs, slice_by=F.trunc("day", "week")), *names) == want
    assert values(W.apply_specs(timed, specs), *names) == want


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_days_ahead_equal_a_range_frame(series, values, kind):
    timed = series.withColumn("at", F.when(F.col("id") % 9 != 0, F.col("day").cast(kind)))
    spec = {"column": "s", "function": "sum", "argument": "v", "frame": "range between current row and 3 days following", "partition_by": ["k"], "order_by": ["at"]}
    want = timed.selectExpr("id", "sum(v) over (partition by k order by at range between current row and interval 3 days following) as s")
    assert values(W.apply_specs(timed, [spec]), "id", "s") == values(want, "id", "s")


@pytest.mark.parametrize("frame", ["rows between 2 following and 1 following", "rows between unbounded following and current row", "range between 2 days preceding and 1 days following", "all"])
def test_frames_refused(series, frame):
    with pytest.raises(ConfigError, match="INVALID_FRAME"):
        W.apply_specs(series, [{"column": "x", "function": "sum", "argument": "v", "frame": frame, "partition_by": ["k"], "order_by": ["day"]}])


@pytest.mark.parametrize("days", [1, 3, 10])
def test_rolling_days_equals_range_frame(series, values, days):
    made = {"s": ("sum", "v"), "a": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "n": ("count", "id")}
    got = W.rolling_days(series, ["k"], "day", made, days).select("id", *made)
    over = f"OVER (PARTITION BY k ORDER BY day RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND CURRENT ROW)"
    want = series.select("id", *[F.expr(f"{fn}({c}) {over}").alias(n) for n, (fn, c) in made.items()])
    rounded = lambda df: df.withColumns({c: F.round(c, 6) for c in ("s", "a")})
    assert values(rounded(got)) == values(rounded(want))


def test_rolling_days_on_zoned_timestamps(spark, series, values):
    timed = series.withColumn("ts", F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.col("id") % 24))
    got = W.rolling_days(timed, ["k"], "ts", {"n": ("count", "id")}, 2).select("id", "n")
    want = timed.selectExpr("id", "count(id) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS n")
    assert values(got) == values(want)


@pytest.mark.parametrize("days", [1, 4])
def test_rolling_days_with_null_times(series, values, days):
    holed = series.withColumn("day", F.when(F.col("id") % 3 != 0, F.col("day")))
    made = {"s": ("sum", "v"), "lo": ("min", "v"), "n": ("count", "id")}
    got = W.rolling_days(holed, ["k"], "day", made, days).select("id", *made)
    over = f"OVER (PARTITION BY k ORDER BY day RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND CURRENT ROW)"
    want = holed.select("id", *[F.expr(f"{fn}({c}) {over}").alias(n) for n, (fn, c) in made.items()])
    rounded = lambda df: df.withColumn("s", F.round("s", 6))
    assert values(rounded(got)) == values(rounded(want))


def test_dedupe_does_not_depend_on_layout(series, values):
    one = W.dedupe(series.repartition(1), ["k"], ["day desc"])
    many = W.dedupe(series.repartition(17, "v"), ["k"], ["day desc"])
    assert values(one) == values(many)
    assert one.count() == 5


def test_dedupe_is_pruned_before_the_shuffle(series):
    plan = W.dedupe(series, ["k"], ["day desc"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


@pytest.mark.parametrize(("method", "order", "top"), [("row_number", ["d desc"], 2), ("rank", ["d"], 1), ("dense_rank", ["d", "v"], 3)])
def test_dedupe_of_a_large_input_sorts_in_pieces(spark, series, values, tmp_path, monkeypatch, method, order, top):
    from millrace.functions import sizes

    path = str(tmp_path / "series")
    series.unionAll(series.filter("id < 100")).repartition(3).write.parquet(path)
    large = spark.read.parquet(path)
    plain = values(W.dedupe(large, ["k"], order, method, top))
    assert sizes.sort_pieces(large) == 0
    monkeypatch.setattr(sizes, "SORT_BYTES", 512)
    cut = W.dedupe(large, ["k"], order, method, top)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    # No sort stands on the scan, and no partition of either shuffle is left to be joined with others.
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    assert values(cut) == plain
    assert sizes.sort_pieces(spark.createDataFrame(large.rdd, large.schema)) == 0  # of unknown size


def test_priority(rows, values):
    df = rows("k string, src string, v int", ("a", "crm", 1), ("a", "erp", 2), ("b", "web", 3), ("b", "x", 4))
    assert values(W.dedupe_priority(df, ["k"], "src", ["erp", "crm", "web"])) == [("a", "erp", 2), ("b", "web", 3)]


def test_quarantine(rows, values):
    df = rows(
        "id string, ver timestamp, name string, price double, prio int",
        ("A", "2024-05-01 10:00:00", "Lamp", 1.0, 2), ("A", "2024-05-02 10:00:00", "Lamp X", 2.0, 1),
        ("B", "2024-05-01 09:00:00", "Desk", 5.0, 1), ("B", "2024-05-01 09:00:00", "Desk", 5.0, 1),
        (None, "2024-05-04 10:00:00", "Lost", 3.0, 1),
        ("C", "2024-05-05 10:00:00", "One", 7.0, 1), ("C", "2024-05-05 10:00:00", "Two", 8.0, 1), ("C", "2024-05-01 10:00:00", "Old", 1.0, 1),
    )
    good, bad = W.dedupe_quarantine(df, ["id"], "ver", ["prio"])
    assert values(good, "id", "name") == [("A", "Lamp X"), ("B", "Desk")]
    assert values(bad.select("id", "reason").distinct()) == [(None, "null-key"), ("C", "same-timestamp-conflict")]


def test_refused_settings(series):
    with pytest.raises(ConfigError, match="MISSING_PARTITION"):
        W.apply_specs(series, [{"column": "x", "function": "sum", "argument": "v"}])
    with pytest.raises(ConfigError, match="INVALID_METHOD"):
        W.dedupe(series, ["k"], ["day"], "qualify")
    with pytest.raises(ConfigError, match="UNKNOWN_COLUMN"):
        W.dedupe(series, ["nope"], ["day"])
