"""Business-date tokens as column expressions: one token, any number of as-of dates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError, need

# Fixed aliases: what they stand for, as a token and its offset.
ALIASES = {
    "WTD_START": ("BOW", 0),
    "MTD_START": ("BOM", 0),
    "QTD_START": ("BOQ", 0),
    "YTD_START": ("BOY", 0),
    "FYTD_START": ("BOFY", 0),
    "LAST_COMPLETED_MONTH_START": ("BOM", -1),
    "LAST_COMPLETED_MONTH_END": ("EOM", -1),
    "LAST_COMPLETED_QUARTER_START": ("BOQ", -1),
    "LAST_COMPLETED_QUARTER_END": ("EOQ", -1),
}

# Period lengths in months, for tokens that begin or end a calendar period.
PERIOD_MONTHS = {"M": 1, "Q": 3, "H": 6, "Y": 12}
# Shifts in months for the "same day" tokens.
SAME_DAY_MONTHS = {"SAME_DAY_LAST_MONTH": 1, "SAME_DAY_LAST_QUARTER": 3, "SAME_DAY_LAST_YEAR": 12}


def period_start(day: Column, months: int) -> Column:
    """First day of the calendar period of ``months`` months (1, 3, 6 or 12) holding the day."""
    first = ((F.month(day) - 1) / months).cast("int") * months + 1
    return F.make_date(F.year(day), first.cast("int"), F.lit(1))


def period_end(day: Column, months: int) -> Column:
    return F.last_day(F.add_months(period_start(day, months), months - 1))


def fiscal_start(day: Column, months: int, offset: int) -> Column:
    """Period start on a fiscal calendar that begins ``offset`` months after January."""
    return F.add_months(period_start(F.add_months(F.trunc(day, "month"), -offset), months), offset)


def split_token(token: str) -> tuple[str, int]:
    """Name and offset of a token; an alias may carry an offset too (``MTD_START-1`` is ``BOM-1``)."""
    name = token.strip().upper()
    digits = len(name) - len(name.rstrip("0123456789"))
    sign = name[-digits - 1 : -digits] if digits else ""
    shift = 0
    if sign and sign in "+-":
        name, shift = name[: -digits - 1], int(name[-digits - 1 :])
    base, own = ALIASES.get(name, (name, 0))
    return base, own + shift


@dataclass(frozen=True)
class _Day:
    """What a token may refer to: the as-of day, the first fiscal month's offset, the run before."""

    day: Column
    fiscal: int
    previous: Column | None


def _week(edge: int):
    return lambda at, n: F.date_add(F.trunc(at.day, "week"), 7 * n + edge)


def _period(months: int, last: bool, fiscal: bool):
    def resolve(at: _Day, n: int) -> Column:
        start = F.add_months(fiscal_start(at.day, months, at.fiscal if fiscal else 0), n * months)
        return F.last_day(F.add_months(start, months - 1)) if last else start

    return resolve


def _previous_run(at: _Day, n: int) -> Column:
    need(at.previous is not None, "MISSING_PREVIOUS_RUN", "the token refers to the run before")
    return at.previous.cast("date")


#: Tokens that take no offset, and those that do, each with what it makes of a day.
PLAIN = {
    "TODAY": lambda at, n: at.day,
    "RUN_DATE": lambda at, n: at.day,
    "PREVIOUS_RUN_DATE": _previous_run,
    "SAME_DAY_LAST_WEEK": lambda at, n: F.date_sub(at.day, 7),
    **{name: (lambda months: lambda at, n: F.add_months(at.day, -months))(months) for name, months in SAME_DAY_MONTHS.items()},
}
SHIFTED = {
    "T": lambda at, n: F.date_add(at.day, n),
    "BOW": _week(0),
    "EOW": _week(6),
    **{f"{edge}O{letter}": _period(months, edge == "E", False) for edge in "BE" for letter, months in PERIOD_MONTHS.items()},
    **{f"{edge}OF{letter}": _period(PERIOD_MONTHS[letter], edge == "E", letter != "M") for edge in "BE" for letter in "MQY"},
}


def mnemonic(
    token: str,
    as_of: Column,
    *,
    fiscal_offset: int = 0,
    previous_run: Column | None = None,
) -> Column:
    """Date a token stands for, relative to each row's as-of date."""
    need(bool(token and token.strip()), "MISSING_TOKEN", "a date token is needed")
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", token.strip()):
        return F.lit(token.strip()).cast("date")
    name, n = split_token(token)
    need(not (n and name in PLAIN), "OFFSET_NOT_ALLOWED", token)
    resolve = PLAIN.get(name) or SHIFTED.get(name)
    if resolve is None:
        raise ConfigError("UNKNOWN_MNEMONIC", token)
    return resolve(_Day(as_of.cast("date"), fiscal_offset, previous_run), n)
