"""Date tokens and calendars against plain Python."""

import calendar as pycal
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.functions import calendar as cal
from millrace.functions.dates import mnemonic


def shift(d, n):
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, pycal.monthrange(y, m + 1)[1]))


def month_end(d):
    return date(d.year, d.month, pycal.monthrange(d.year, d.month)[1])


def begin(d, months):
    return date(d.year, (d.month - 1) // months * months + 1, 1)


def fiscal(d, months, offset):
    return shift(begin(shift(d.replace(day=1), -offset), months), offset)


EXPECT = {
    "T+45": lambda d: d + timedelta(45), "BOW-1": lambda d: d - timedelta(d.weekday() + 7), "EOW": lambda d: d + timedelta(6 - d.weekday()),
    "BOM+2": lambda d: begin(shift(d, 2), 1), "EOM-1": lambda d: month_end(shift(d, -1)), "BOQ-2": lambda d: begin(shift(d, -6), 3),
    "EOQ": lambda d: month_end(shift(begin(d, 3), 2)), "BOH+1": lambda d: begin(shift(d, 6), 6), "EOH": lambda d: month_end(shift(begin(d, 6), 5)),
    "BOY-3": lambda d: date(d.year - 3, 1, 1), "EOY+1": lambda d: date(d.year + 1, 12, 31), "SAME_DAY_LAST_YEAR": lambda d: shift(d, -12),
    "SAME_DAY_LAST_MONTH": lambda d: shift(d, -1), "LAST_COMPLETED_QUARTER_END": lambda d: begin(d, 3) - timedelta(1),
}
FISCAL = {
    "BOFY": lambda d, o: fiscal(d, 12, o), "EOFY+1": lambda d, o: month_end(shift(fiscal(d, 12, o), 23)),
    "BOFQ-1": lambda d, o: shift(fiscal(d, 3, o), -3), "EOFQ": lambda d, o: month_end(shift(fiscal(d, 3, o), 2)), "FYTD_START": lambda d, o: fiscal(d, 12, o),
}


@pytest.fixture(scope="module")
def days(spark):
    return spark.range(1).select(F.explode(F.sequence(F.lit("2023-01-01").cast("date"), F.lit("2025-01-31").cast("date"))).alias("d"))


def test_mnemonics(days):
    got = days.select("d", *[mnemonic(t, F.col("d")).alias(f"c{i}") for i, t in enumerate(EXPECT)]).collect()
    for r in got:
        for i, (token, want) in enumerate(EXPECT.items()):
            assert r[f"c{i}"] == want(r["d"]), (token, r["d"])


@pytest.mark.parametrize("offset", [0, 3, 9])
def test_fiscal_mnemonics(days, offset):
    got = days.select("d", *[mnemonic(t, F.col("d"), fiscal_offset=offset).alias(f"c{i}") for i, t in enumerate(FISCAL)]).collect()
    for r in got:
        for i, (token, want) in enumerate(FISCAL.items()):
            assert r[f"c{i}"] == want(r["d"], offset), (token, r["d"])


def test_bad_tokens(days):
    for token, code in (("", "MISSING_TOKEN"), ("BOX", "UNKNOWN_MNEMONIC"), ("TODAY+1", "OFFSET_NOT_ALLOWED"), ("PREVIOUS_RUN_DATE", "MISSING_PREVIOUS_RUN"), ("BOFH", "UNKNOWN_MNEMONIC")):
        with pytest.raises(ConfigError, match=code):
            mnemonic(token, F.col("d"))


def nth(y, m, weekday, n):
    d = date(y, m, 1)
    return d + timedelta((weekday - d.weekday()) % 7 + 7 * (n - 1))


def observed(d):
    return d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d


def closed(year, kind):
    may31 = date(year, 5, 31)
    out = {observed(date(year, 1, 1)), nth(year, 1, 0, 3), nth(year, 2, 0, 3), may31 - timedelta(may31.weekday()), observed(date(year, 7, 4)), nth(year, 9, 0, 1), nth(year, 11, 3, 4), observed(date(year, 12, 25))}
    if year >= 2021:
        out.add(observed(date(year, 6, 19)))
    if kind == "US-FED":
        out |= {nth(year, 10, 0, 2), observed(date(year, 11, 11))}
    return out


@pytest.mark.parametrize("kind", ["US", "US-FED"])
def test_holidays(spark, kind):
    got = {r["holiday"] for r in cal.holidays(spark, kind).collect()}
    want = set().union(*[closed(y, kind) for y in range(1900, 2101)])
    assert got == want


def test_good_friday(spark):
    got = {r["holiday"] for r in cal.holidays(spark, "US-NYSE").collect()}
    known = [date(1954, 4, 16), date(1981, 4, 17), date(2000, 4, 21), date(2011, 4, 22), date(2019, 4, 19), date(2024, 3, 29), date(2025, 4, 18), date(2038, 4, 23), date(2049, 4, 16), date(2076, 4, 17)]
    assert all(d in got for d in known)
    assert len({r for r in got if r.month in (3, 4)}) == 201


def test_business_days(spark, days):
    frame = cal.calendar(spark, "US-FED")
    shut = set().union(*[closed(y, "US-FED") for y in (2022, 2023, 2024, 2025)])
    is_open = lambda d: d.weekday() < 5 and d not in shut

    def step(d, n):
        while n:
            d += timedelta(1 if n > 0 else -1)
            if is_open(d):
                n -= 1 if n > 0 else -1
        return d

    def in_month(d):
        return [date(d.year, d.month, i) for i in range(1, month_end(d).day + 1) if is_open(date(d.year, d.month, i))]

    out = days
    for name, token in {"p": "PBD", "p4": "PBD-4", "n": "NBD", "n6": "NBD+6", "f": "FBOM", "l": "LBOM", "x": "NBDOM(3)", "none": "NBDOM(30)"}.items():
        out = cal.add_business_date(out, name, token, "d", frame)
    out = cal.add_business_days_between(out, "gap", "d", "n6", frame)
    for r in out.collect():
        d, m = r["d"], in_month(r["d"])
        assert (r["p"], r["p4"], r["n"], r["n6"]) == (step(d, -1), step(d, -4), step(d, 1), step(d, 6)), d
        assert (r["f"], r["l"], r["x"], r["none"], r["gap"]) == (m[0], m[-1], m[2], None, 6), d


def test_alias_with_offset():
    from millrace.functions.dates import split_token

    assert split_token(" mtd_start-1 ") == ("BOM", -1) and split_token("LAST_COMPLETED_MONTH_END-1") == ("EOM", -2)
    assert split_token("T+10") == ("T", 10) and split_token("TODAY") == ("TODAY", 0) and split_token("T-") == ("T-", 0)
