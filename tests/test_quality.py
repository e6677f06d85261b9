"""Expectations, checks, profiles, quantiles and fuzzy names."""

import itertools
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConfigError
from millrace.functions.quantiles import exact_quantiles
from millrace.operators import checks, fuzzy, profiling, quality


def test_validate_splits_every_row(rows, values):
    df = rows("id string, who string, amount double, st string", ("1", "a", 5.0, "OK"), ("2", None, 5.0, "OK"), ("3", "b", -1.0, "??"), ("4", "c", None, None))
    rules = [
        {"type": "not_null", "name": "who_given", "column": "who"}, {"type": "between", "name": "floor", "column": "amount", "min": 0},
        {"type": "in_set", "name": "known", "column": "st", "values": ["OK"]}, {"type": "row_count_between", "min": 10},
    ]
    v = quality.validate(df, rules)
    assert values(v.accepted, "id") == [("1",), ("4",)]
    assert {r["id"]: r["failed_rules"] for r in v.rejected.collect()} == {"2": ["who_given"], "3": ["floor", "known"]}
    assert {r["expectation"]: r["success"] for r in v.report.collect()} == {"who_given": False, "floor": False, "known": False, "row_count_between": False}
    assert quality.validate(df, rules, on_failure="warn").accepted.count() == 4
    assert quality.validate(df, rules, on_failure="block", threshold_percent=50).accepted.count() == 2
    with pytest.raises(ConfigError, match="VALIDATION_BLOCKED"):
        quality.validate(df, rules, on_failure="block", threshold_percent=49)


def test_one_scan_for_a_whole_suite(rows):
    df = rows("id int, v double", (1, 2.0))
    rules = [{"type": "not_null", "column": "id"}, {"type": "mean_between", "column": "v", "min": 0}, {"type": "column_exists", "column": "v"}, {"type": "between", "column": "v", "max": 3}]
    plan = quality.run_suite(df, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_empty_table(rows):
    df = rows("id int", (1,)).filter("false")
    got = {r["expectation"]: r["success"] for r in quality.run_suite(df, [{"type": "not_null", "column": "id"}, {"type": "unique", "column": "id"}, {"type": "mean_between", "column": "id", "min": 0}]).collect()}
    assert got == {"not_null": True, "unique": True, "mean_between": False}
    assert checks.freshness(df.withColumn("t", F.current_timestamp()), "t", datetime(2024, 1, 1), 5).first()["is_fresh"] is False


def test_unique_ignores_nulls(rows):
    df = rows("a string, b int", ("x", 1), ("x", 1), (None, 1), (None, 1), ("y", 2))
    r = quality.run_suite(df, [{"type": "unique", "column": "a", "mostly": 0.4}]).first()
    assert (r["element_count"], r["unexpected_count"], r["success"]) == (5, 2, False)


def test_unknown_expectation(rows):
    with pytest.raises(ConfigError, match="UNKNOWN_EXPECTATION"):
        quality.run_suite(rows("a int", (1,)), [{"type": "to_be_happy", "column": "a"}])


def test_freshness_limit_is_inclusive(rows, values):
    df = rows("b string, t timestamp", ("new", "2024-03-01 03:30:00"), ("edge", "2024-03-01 03:00:00"), ("old", "2024-03-01 02:59:59"))
    got = checks.flag_freshness(df, "t", datetime(2024, 3, 1, 5), 120)
    assert values(got, "b", "is_fresh") == [("edge", True), ("new", True), ("old", False)]


def test_drift(rows):
    want = T.StructType.fromDDL("id string, vendor string, amount double, cur string")
    extra = rows("id string, vendor string, amount double, cur string, note string", ("1", "v", 1.0, "x", None))
    assert [(r["column_name"], r["severity"]) for r in checks.schema_drift(extra, want).collect()] == [("note", "WARN")]
    assert [(r["change"], r["severity"]) for r in checks.schema_drift(extra.drop("amount", "note"), want).collect()] == [("missing", "FAIL")]
    assert checks.adapt_to_contract(extra.drop("amount"), want, "auto_adapt").schema.names == want.names
    with pytest.raises(ConfigError, match="SCHEMA_DRIFT"):
        checks.adapt_to_contract(extra.drop("amount"), want, "block")
    moved = checks.schema_drift(extra.select("vendor", "id", "amount", "cur"), want, strict_order=True)
    assert {r["change"] for r in moved.collect()} == {"reordered"}


def test_spikes_need_a_full_baseline(rows, values):
    df = rows("d string, t timestamp, v double", *[("a", f"2024-04-01 0{i}:00:00", 40.0 + i) for i in range(5)], ("a", "2024-04-02 01:00:00", 95.0), ("b", "2024-04-01 00:00:00", 900.0))
    for unit in (None, F.col("t").cast("date")):
        got = checks.anomaly_spikes(df, ["d"], "t", "v", baseline_events=3, factor=2.0, slice_by=unit)
        assert values(got, "d", "v") == [("a", 95.0)]
    with pytest.raises(ConfigError, match="MISSING_PRIMARY_METRIC"):
        checks.anomaly_spikes(df, ["d"], "t", "", baseline_events=3, factor=2.0)


def test_band_without_rows_today(rows):
    df = rows("d date, v double", ("2024-01-01", 1.0))
    assert checks.anomaly_band(df, "d", "v", date(2024, 1, 5)).isEmpty()


def test_referential_and_reconcile(rows, values):
    child, parent = rows("k int", (1,), (2,), (None,), (9,)), rows("p int", (1,), (2,), (2,))
    kept = checks.referential(child, parent, [("k", "p")])
    assert values(kept.rows) == [(None,), (1,), (2,)] and kept.report.first()["orphan_rows"] == 1
    strict = checks.referential(child, parent, [("k", "p")], nulls_allowed=False)
    assert strict.rows.count() == 2 and strict.report.first()["orphan_rows"] == 2
    a, b = rows("k int, v double", (1, 1.0), (2, 2.0), (3, None)), rows("k int, v double", (1, 1.0), (2, 2.5), (4, 1.0), (3, None))
    assert values(checks.reconcile_rows(a, b, ["k"], ["v"])) == [(1, "match"), (2, "differs:v"), (3, "match"), (4, "missing_in_source")]


def test_profile(rows):
    df = rows("a string, b string, c string", ("1", "x", None), ("2", " ", ""), ("q", "x", None), ("2", "x", None))
    p = {r["column_name"]: r for r in profiling.profile(df, {"a": "int"}).collect()}
    assert (p["a"]["distinct_count"], p["a"]["valid_count"], p["a"]["valid_share"]) == (3, 3, 0.75)
    assert (p["b"]["null_count"], p["c"]["null_rate"], p["c"]["top_count"]) == (1, 1.0, 0)
    flags = {(r["column_name"], r["warning"]) for r in profiling.profile_flags(profiling.profile(df, {"a": "int"})).collect()}
    assert flags == {("a", "type_mismatch"), ("c", "mostly_null")}
    assert profiling.empty_rows(df).count() == 0


@pytest.mark.parametrize("kind", ["even", "odd", "skewed", "one", "wide"])
def test_exact_quantiles(spark, kind):
    rng = random.Random(3)
    data = {
        "even": [float(i) for i in range(1000)], "odd": [rng.random() for _ in range(1001)], "skewed": [1.0] * 900 + [float(i) for i in range(100)], "one": [5.0],
        "wide": [rng.lognormvariate(0, 6) for _ in range(4000)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(exact_quantiles(df, "v", probs), np.quantile(data, probs), rtol=1e-12)
    assert exact_quantiles(df.filter("v IS NULL"), "v", [0.5]) == [None]


def soundex(text):
    codes = {c: d for d, cs in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in cs}
    out, last = text[0].upper(), codes.get(text[0].upper(), "")
    for ch in text[1:].upper():
        d = codes.get(ch, "")
        if ch in "HW":
            continue
        if d and d != last:
            out += d
        last = d
    return (out + "000")[:4]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("k,sound", [(1, False), (2, False), (1, True), (4, False), (6, False)])
def test_similar_pairs_equal_brute_force(spark, k, sound):
    rng = random.Random(11)
    base = ["martin", "marten", "robert", "rupert", "smith", "smyth", "jonson", "johnson", "aa", "a", "ab"]
    names = set(base)
    for w in base:
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("aeirst")
            names.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:] or c, w[:i] + c + w[i + 1:]]))
    want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if edits(a, b) <= k and (not sound or soundex(a) == soundex(b))}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["left_name"], r["right_name"]) for r in fuzzy.similar_pairs(df, "name", max_edits=k, same_soundex=sound).collect()}
    assert got == want


def test_connected_groups(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "z")]
    df = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in chain], "left_name string, right_name string")
    got = {r["name"]: r["group_name"] for r in fuzzy.connected_groups(df).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(41)}, "x": "x", "y": "x", "z": "x"}


def test_short_names_are_linked_without_pairs(spark):
    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(100, "abcdefgh"), (101, "abcdxfgh")], "id int, name string")
    links = fuzzy._similar_links(df, "name", (), 2, False)
    assert links.count() <= len(names) + 1
    got = {(r["id"], r["group_name"]) for r in fuzzy.dedupe_fuzzy(df, "name", order=["id"], max_edits=2, same_soundex=False).collect()}
    assert got == {(0, "ak"), (100, "abcdefgh")}


def test_profile_tells_long_texts_apart(rows):
    from millrace.operators import profiling

    long = "x" * 500
    df = rows("t string, n string", (long + "a", "1"), (long + "b", "x"), (long + "a", " "), (None, "2"), ("", None))
    got = {r["column_name"]: r for r in profiling.profile(df, {"n": "int"}).collect()}
    t, n = got["t"], got["n"]
    assert (t["row_count"], t["null_count"], t["distinct_count"], t["max_length"], t["valid_count"], t["top_count"]) == (5, 2, 2, 501, 3, 2)
    assert (n["row_count"], n["null_count"], n["distinct_count"], n["max_length"], n["valid_count"], n["top_count"]) == (5, 2, 3, 1, 2, 1)


def test_broadcast_needs_few_rows_and_bytes(rows):
    from millrace.functions.sizes import fits

    df = rows("t string, n int", ("x" * 5000, 1), ("y" * 5000, 2))
    assert fits(df, 2) and not fits(df, 1)
    assert not fits(df, 2, max_bytes=10_000) and fits(df.select("n"), 2, max_bytes=10_000)
