"""Calendar and as-of queries over the dates of the tables."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.dates import mnemonic
from ..operators import timestate
from .registry import query

D = "CAST(o_orderdate AS DATE)"


def _shift(unit: str, amount: int, end: bool, months: int) -> str:
    start = f"date_trunc('{unit}', {D}) + INTERVAL ({amount * months}) MONTH"
    return f"CAST({start} + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE)" if end else f"CAST({start} AS DATE)"


HALF = f"make_date(CAST(year({D}) AS INTEGER), CASE WHEN month({D}) <= 6 THEN 1 ELSE 7 END, 1)"
# Fiscal periods shift the month start, so that month ends cannot spill over.
FQ = f"CAST(date_trunc('quarter', date_trunc('month', {D}) - INTERVAL 1 MONTH) + INTERVAL 1 MONTH AS DATE)"
FYM = f"CAST(date_trunc('year', date_trunc('month', {D}) - INTERVAL 3 MONTH) + INTERVAL 3 MONTH AS DATE)"

# token -> (fiscal offset, reference expression)
TOKENS = {
    "2024-02-29": (0, "DATE '2024-02-29'"),
    "TODAY": (0, D),
    "T+5": (0, f"{D} + 5"),
    "T-3": (0, f"{D} - 3"),
    "RUN_DATE": (0, D),
    "BOW": (0, f"CAST(date_trunc('week', {D}) AS DATE)"),
    "EOW+1": (0, f"CAST(date_trunc('week', {D}) AS DATE) + 13"),
    "BOM-1": (0, _shift("month", -1, False, 1)),
    "EOM": (0, _shift("month", 0, True, 1)),
    "BOQ+1": (0, _shift("quarter", 1, False, 3)),
    "EOQ-1": (0, _shift("quarter", -1, True, 3)),
    "BOH": (0, HALF),
    "EOH": (0, f"CAST({HALF} + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE)"),
    "BOY-1": (0, _shift("year", -1, False, 12)),
    "EOY+2": (0, _shift("year", 2, True, 12)),
    "SAME_DAY_LAST_WEEK": (0, f"{D} - 7"),
    "SAME_DAY_LAST_MONTH": (0, f"CAST({D} - INTERVAL 1 MONTH AS DATE)"),
    "SAME_DAY_LAST_QUARTER": (0, f"CAST({D} - INTERVAL 3 MONTH AS DATE)"),
    "SAME_DAY_LAST_YEAR": (0, f"CAST({D} - INTERVAL 12 MONTH AS DATE)"),
    "BOFY": (3, FYM),
    "EOFY-1": (3, f"CAST({FYM} - INTERVAL 1 DAY AS DATE)"),
    "BOFQ": (1, FQ),
    "EOFQ": (1, f"CAST({FQ} + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"),
    "BOFM+1": (1, _shift("month", 1, False, 1)),
    "EOFM": (1, _shift("month", 0, True, 1)),
    "WTD_START": (0, f"CAST(date_trunc('week', {D}) AS DATE)"),
    "MTD_START": (0, _shift("month", 0, False, 1)),
    "QTD_START": (0, _shift("quarter", 0, False, 3)),
    "YTD_START": (0, _shift("year", 0, False, 12)),
    "FYTD_START": (3, FYM),
    "LAST_COMPLETED_MONTH_START": (0, _shift("month", -1, False, 1)),
    "LAST_COMPLETED_MONTH_END": (0, _shift("month", -1, True, 1)),
    "LAST_COMPLETED_QUARTER_START": (0, _shift("quarter", -1, False, 3)),
    "LAST_COMPLETED_QUARTER_END": (0, _shift("quarter", -1, True, 3)),
}


@query("tim_mnemonic", "SELECT o_orderkey, " + ", ".join(f"{e} AS d{i}" for i, (_, e) in enumerate(TOKENS.values())) + " FROM orders")
def _(t):
    made = [mnemonic(token, F.col("o_orderdate"), fiscal_offset=off).alias(f"d{i}") for i, (token, (off, _)) in enumerate(TOKENS.items())]
    return t.orders.select("o_orderkey", *made)


# Open days in SQL: weekdays minus rule-based holidays of the years the orders span.
HOLIDAYS = """
y AS (SELECT CAST(unnest(range(1994, 2004)) AS INTEGER) AS y),
fixed AS (SELECT make_date(y, m, d) AS h FROM y, (VALUES (1, 1), (7, 4), (12, 25){extra}) v(m, d)),
observed AS (SELECT CASE dayofweek(h) WHEN 6 THEN h - 1 WHEN 0 THEN h + 1 ELSE h END AS h FROM fixed),
mondays AS (SELECT CAST(d AS DATE) AS d, CAST(floor((day(d) - 1) / 7) + 1 AS INTEGER) AS nth, month(d) AS m, month(d + INTERVAL 7 DAY) <> month(d) AS is_last, dayofweek(d) AS w
            FROM range(DATE '1994-01-01', DATE '2004-01-01', INTERVAL 1 DAY) r(d)),
floating AS (SELECT d AS h FROM mondays WHERE (w = 1 AND m = 1 AND nth = 3) OR (w = 1 AND m = 2 AND nth = 3) OR (w = 1 AND m = 5 AND is_last) OR (w = 1 AND m = 9 AND nth = 1) OR (w = 4 AND m = 11 AND nth = 4){floating}),
good_friday AS (SELECT h FROM (VALUES (DATE '1995-04-14'), (DATE '1996-04-05'), (DATE '1997-03-28'), (DATE '1998-04-10'), (DATE '1999-04-02'), (DATE '2000-04-21'), (DATE '2001-04-13'), (DATE '2002-03-29')) g(h) WHERE {easter}),
open_days AS (SELECT d, w NOT IN (0, 6) AND d NOT IN (SELECT h FROM observed UNION SELECT h FROM floating UNION SELECT h FROM good_friday) AS is_open FROM mondays)"""


def holidays_sql(calendar_id: str) -> str:
    fed = calendar_id == "US-FED"
    return HOLIDAYS.format(
        extra=", (11, 11)" if fed else "", floating=" OR (w = 1 AND m = 10 AND nth = 2)" if fed else "", easter="true" if calendar_id == "US-NYSE" else "false"
    )


@query(
    "tim_calendar",
    " UNION ALL ".join(
        f"(WITH {holidays_sql(c)} SELECT '{c}' AS calendar_id, o_orderkey, is_open FROM orders JOIN open_days ON {D} = d)" for c in cal.CALENDARS
    ),
)
def _(t):
    out = None
    for c in cal.CALENDARS:
        days = cal.calendar(t.spark, c)
        one = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("calendar_date")).join(F.broadcast(days), "calendar_date")
        one = one.select("calendar_id", "o_orderkey", "is_open")
        out = one if out is None else out.unionByName(one)
    return out


OPEN = "(SELECT d FROM open_days WHERE is_open)"


@query(
    "tim_business_day",
    f"""WITH {holidays_sql('US-FED')}, o AS (SELECT d, row_number() OVER (ORDER BY d) AS i, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS m FROM {OPEN}),
        a AS (SELECT DISTINCT {D} AS x FROM orders),
        r AS (SELECT x, (SELECT max(i) FROM o WHERE d < x) AS prev_i, (SELECT min(i) FROM o WHERE d > x) AS next_i, (SELECT min(d) FROM o WHERE date_trunc('month', d) = date_trunc('month', x)) AS first_day,
                     (SELECT max(d) FROM o WHERE date_trunc('month', d) = date_trunc('month', x)) AS last_day_open, (SELECT d FROM o WHERE date_trunc('month', d) = date_trunc('month', x) AND m = 5) AS fifth FROM a)
        SELECT o_orderkey, first_day, last_day_open, p.d AS prev3, n.d AS next2, fifth FROM orders JOIN r ON {D} = x LEFT JOIN o p ON p.i = prev_i - 2 LEFT JOIN o n ON n.i = next_i + 1""",
)
def _(t):
    days = cal.calendar(t.spark, "US-FED")
    out = t.orders.select("o_orderkey", "o_orderdate")
    for name, token in {"first_day": "FBOM", "last_day_open": "LBOM", "prev3": "PBD-3", "next2": "NBD+2", "fifth": "NBDOM(5)"}.items():
        out = cal.add_business_date(out, name, token, "o_orderdate", days)
    return out.drop("o_orderdate")


@query(
    "tim_bd_between",
    f"""WITH {holidays_sql('US')}, c AS (SELECT d, CAST(sum(CAST(is_open AS INTEGER)) OVER (ORDER BY d) AS BIGINT) AS n FROM open_days)
        SELECT l_orderkey, l_linenumber, l_shipdate, abs(b.n - a.n) AS business_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c a ON {D} = a.d JOIN c b ON CAST(l_shipdate AS DATE) = b.d""",
)
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")
    return cal.add_business_days_between(rows, "business_days", "o_orderdate", "l_shipdate", cal.calendar(t.spark, "US")).drop("o_orderdate")


# One dataset per order: the grain follows the priority, its as-of is the order date.
GRAIN_OF = {"1-URGENT": "DAILY", "2-HIGH": "DAILY_BUSINESS_DAY", "3-MEDIUM": "END_OF_MONTH", "4-NOT SPECIFIED": "BEG_OF_QUARTER", "5-LOW": "END_OF_QUARTER"}
QUARTER_END = "CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS TIMESTAMP)"


@query(
    "tim_next_asof",
    f"""SELECT o_orderkey, CASE
          WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 6 HOUR
          WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN o_orderdate
          WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH
          WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN o_orderdate + CASE isodow(o_orderdate) WHEN 1 THEN INTERVAL 2 DAY WHEN 2 THEN INTERVAL 1 DAY WHEN 3 THEN INTERVAL 2 DAY WHEN 4 THEN INTERVAL 1 DAY WHEN 5 THEN INTERVAL 5 DAY WHEN 6 THEN INTERVAL 4 DAY ELSE INTERVAL 3 DAY END
          WHEN o_orderpriority = '2-HIGH' THEN o_orderdate + CASE isodow(o_orderdate) WHEN 5 THEN INTERVAL 3 DAY WHEN 6 THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END
          WHEN o_orderpriority = '3-MEDIUM' THEN date_trunc('month', o_orderdate) + INTERVAL 2 MONTH - INTERVAL 1 DAY
          WHEN o_orderpriority = '4-NOT SPECIFIED' THEN date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH
          WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderdate = {QUARTER_END} THEN {QUARTER_END} + INTERVAL 1 DAY + INTERVAL 3 MONTH - INTERVAL 1 DAY ELSE {QUARTER_END} END
          ELSE o_orderdate + INTERVAL 1 DAY END AS next_asof FROM orders""",
)
def _(t):
    grain = F.lit(None).cast("string")
    for priority, g in GRAIN_OF.items():
        grain = F.when(F.col("o_orderpriority") == priority, F.lit(g)).otherwise(grain)
    other = {"1-URGENT": "EVERY_N_HOURS", "2-HIGH": "CONTINUOUS", "3-MEDIUM": "BEG_OF_MONTH", "4-NOT SPECIFIED": "WEEKLY"}
    for priority, g in other.items():
        grain = F.when((F.col("o_orderpriority") == priority) & (F.col("o_orderstatus") == "O"), F.lit(g)).otherwise(grain)
    state = t.orders.select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("current_asof"), grain.alias("time_grain"), F.lit("UTC").alias("timezone"),
        F.array(F.lit("WED"), F.lit("FRI")).alias("weekdays"), F.lit(6).alias("interval_hours"),
    )
    return timestate.next_asof(state).select("o_orderkey", F.col("next_asof").cast("timestamp_ntz").alias("next_asof"))


@query(
    "tim_advance",
    """WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset, DATE '1998-06-30' AS base FROM customer), r AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset, CAST(o_orderdate AS DATE) AS want, 'run-' || o_orderkey AS run_id FROM orders WHERE o_orderstatus <> 'P')
       SELECT dataset, base AS previous_period, want AS new_period, run_id, CASE WHEN want > base THEN 'ACCEPTED' ELSE 'REJECTED' END AS status FROM r JOIN s USING (dataset)
       UNION ALL SELECT dataset, base, greatest(base, coalesce((SELECT max(want) FROM r WHERE r.dataset = s.dataset), base)), 'state', 'STATE' FROM s""",
)
def _(t):
    state = t.customer.select(F.col("c_custkey").cast("string").alias("dataset"), F.lit("1998-06-30").cast("date").alias("current_asof"))
    requests = t.orders.select(
        F.col("o_custkey").cast("string").alias("dataset"), F.col("o_orderdate").cast("date").alias("requested_asof"), F.concat(F.lit("run-"), "o_orderkey").alias("run_id"),
        F.lit("scheduler").alias("actor"), F.lit(datetime(2024, 1, 1)).alias("requested_at"), "o_orderstatus",
    )
    # Runs of pending orders were applied before: they are skipped.
    applied = requests.filter("o_orderstatus = 'P'")
    done = timestate.advance(state, requests.drop("o_orderstatus"), applied)
    audit = done.audit.select("dataset", "previous_period", "new_period", "run_id", "status")
    after = done.state.select(
        "dataset", F.lit("1998-06-30").cast("date").alias("previous_period"), F.col("current_asof").alias("new_period"), F.lit("state").alias("run_id"), F.lit("STATE").alias("status")
    )
    return audit.unionByName(after)


@query(
    "tim_window",
    """SELECT event_id, event_type FROM events WHERE (event_type = 'click' AND ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-11 05:00:00')
       OR (event_type <> 'click' AND ts >= TIMESTAMP '2024-01-12 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00')""",
)
def _(t):
    zone = F.expr("CASE WHEN dataset = 'click' THEN 'America/New_York' ELSE 'UTC' END")
    asof = F.expr("CASE WHEN dataset = 'click' THEN DATE '2024-01-10' ELSE DATE '2024-01-12' END")
    state = t.events.select(F.col("event_type").alias("dataset")).distinct().select("dataset", asof.alias("current_asof"), zone.alias("timezone"))
    rows = t.events.select("event_id", F.col("event_type").alias("dataset"), F.col("ts").cast("timestamp").alias("ts"))
    return timestate.select_window(rows, "ts", state).select("event_id", F.col("dataset").alias("event_type"))
