"""Window queries. Every one cuts its keys into calendar slices."""

from pyspark.sql import functions as F

from ..operators import fuzzy
from ..operators import windows as op
from .registry import query

def day():
    return F.col("ts").cast("date")


def month(c: str):
    return F.trunc(F.col(c).cast("date"), "month")


@query(
    "win_dedupe",
    """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return op.dedupe(rows, ["o_custkey"], ["o_orderdate desc", "o_orderkey desc"])


@query("win_dedupe_distinct", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return op.dedupe(t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag"))


@query(
    "win_dedupe_ranked",
    """SELECT 'rank' AS method, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1
       UNION ALL SELECT 'dense_rank', l_orderkey, l_linenumber, l_quantity FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem) WHERE r <= 2""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    ranked = op.dedupe(rows, ["l_orderkey"], ["l_quantity desc"], "rank").withColumn("method", F.lit("rank"))
    dense = op.dedupe(rows, ["l_orderkey"], ["l_linenumber", "l_quantity"], "dense_rank", 2).withColumn("method", F.lit("dense_rank"))
    return ranked.unionByName(dense)


# Lines repeat (order, line number); the ship date is the version, blank keys come from one flag.
QUARANTINE_SQL = """
WITH r AS (SELECT CASE WHEN l_returnflag = 'A' AND l_quantity = 1 THEN NULL ELSE l_orderkey END AS k, l_linenumber AS ln, l_shipdate AS v, l_partkey, l_suppkey, l_quantity FROM lineitem),
top AS (SELECT k, ln, max(v) AS v FROM r WHERE k IS NOT NULL GROUP BY 1, 2),
latest AS (SELECT DISTINCT r.* FROM r JOIN top USING (k, ln, v)),
bad AS (SELECT k, ln FROM latest GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'accepted' AS outcome, k, ln, v, l_partkey, l_suppkey, l_quantity FROM latest WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.k = latest.k AND bad.ln = latest.ln)
UNION ALL SELECT 'null-key', k, ln, v, l_partkey, l_suppkey, l_quantity FROM r WHERE k IS NULL
UNION ALL SELECT 'same-timestamp-conflict', r.k, r.ln, r.v, l_partkey, l_suppkey, l_quantity FROM r JOIN bad ON bad.k = r.k AND bad.ln = r.ln"""


@query("win_dedupe_quarantine", QUARANTINE_SQL)
def _(t):
    rows = t.lineitem.select(
        F.expr("CASE WHEN NOT (l_returnflag = 'A' AND l_quantity = 1) THEN l_orderkey END").alias("k"),
        F.col("l_linenumber").alias("ln"), F.col("l_shipdate").alias("v"), "l_partkey", "l_suppkey", "l_quantity",
    )
    accepted, quarantine = op.dedupe_quarantine(rows, ["k", "ln"], "v", reason="outcome")
    return accepted.withColumn("outcome", F.lit("accepted")).unionByName(quarantine)


@query(
    "win_dedupe_priority",
    """WITH r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM events)
       SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, ts DESC) AS rn FROM r) WHERE rn = 1""",
)
def _(t):
    return op.dedupe_priority(
        t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id"], "event_type", ["purchase", "signup", "click"], ["ts desc"]
    ).drop("ts")


FUZZY_SQL = """
WITH RECURSIVE names AS (SELECT DISTINCT p_type, lower(trim(p_name)) AS n FROM part),
edges AS (SELECT a.p_type, a.n AS x, b.n AS y FROM names a JOIN names b ON a.p_type = b.p_type AND a.n <> b.n AND levenshtein(a.n, b.n) <= 2),
reach AS (SELECT p_type, n AS x, n AS y FROM names UNION SELECT r.p_type, r.x, e.y FROM reach r JOIN edges e ON r.p_type = e.p_type AND r.y = e.x),
grp AS (SELECT p_type, x, min(y) AS group_name FROM reach GROUP BY 1, 2)
SELECT p_partkey, p_name, p_type, group_name FROM (
  SELECT p.p_partkey, p.p_name, p.p_type, group_name, row_number() OVER (PARTITION BY p.p_type, group_name ORDER BY p_partkey) AS rn
  FROM part p JOIN grp g ON p.p_type = g.p_type AND lower(trim(p.p_name)) = g.x) WHERE rn = 1"""


@query("win_dedupe_fuzzy", FUZZY_SQL)
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_type")
    return fuzzy.dedupe_fuzzy(rows, "p_name", exact=["p_type"], order=["p_partkey"], max_edits=2, same_soundex=False)


# The code of a word: its first letter, then the classes of the others without vowels, H, W and repeats.
SOUNDEX_SQL = """
WITH RECURSIVE codes AS (SELECT DISTINCT p_brand, lower(trim(p_name)) AS n,
  regexp_replace(translate(upper(trim(p_name)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202'), '[^0-9]', '0', 'g') AS c FROM part),
runs AS (SELECT p_brand, n, replace(left(c, 1), '7', '0') || replace(substr(c, 2), '7', '') AS c FROM codes),
single AS (SELECT p_brand, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c,
  '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS c FROM runs),
names AS (SELECT p_brand, n, CASE WHEN regexp_matches(n, '^[a-z]') THEN upper(left(n, 1)) || left(replace(substr(c, 2), '0', '') || '000', 3) ELSE n END AS sound FROM single),
edges AS (SELECT a.p_brand, a.n AS x, b.n AS y FROM names a JOIN names b ON a.p_brand = b.p_brand AND a.sound = b.sound AND a.n <> b.n AND levenshtein(a.n, b.n) <= 1),
reach AS (SELECT p_brand, n AS x, n AS y FROM names UNION SELECT r.p_brand, r.x, e.y FROM reach r JOIN edges e ON r.p_brand = e.p_brand AND r.y = e.x),
grp AS (SELECT p_brand, x, min(y) AS group_name FROM reach GROUP BY 1, 2)
SELECT p_partkey, p_name, p_brand, group_name FROM (
  SELECT p.p_partkey, p.p_name, p.p_brand, group_name, row_number() OVER (PARTITION BY p.p_brand, group_name ORDER BY p_partkey) AS rn
  FROM part p JOIN grp g ON p.p_brand = g.p_brand AND lower(trim(p.p_name)) = g.x) WHERE rn = 1"""


@query("win_dedupe_soundex", SOUNDEX_SQL)
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand")
    return fuzzy.dedupe_fuzzy(rows, "p_name", exact=["p_brand"], order=["p_partkey"], max_edits=1)


# Names cut to seven characters, five edits: most pairs are similar, and many names have no more characters than edits.
SHORT_SQL = FUZZY_SQL.replace("FROM part", "FROM short").replace("<= 2", "<= 5").replace(
    "WITH RECURSIVE", "WITH RECURSIVE short AS (SELECT p_partkey, substring(p_name, 1, 4 + p_partkey % 4) AS p_name, p_type FROM part),"
)


@query("win_dedupe_short", SHORT_SQL)
def _(t):
    rows = t.part.select("p_partkey", F.expr("substring(p_name, 1, 4 + p_partkey % 4)").alias("p_name"), "p_type")
    return fuzzy.dedupe_fuzzy(rows, "p_name", exact=["p_type"], order=["p_partkey"], max_edits=5, same_soundex=False)


@query(
    "win_rolling_null",
    """WITH e AS (SELECT event_id, user_id, value, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts FROM events)
       SELECT event_id, round(sum(value) OVER w, 4) AS sum_2d, count(event_id) OVER w AS n_2d FROM e
       WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)""",
)
def _(t):
    events = t.events.select("event_id", "user_id", "value", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts"))
    out = op.rolling_days(events, ["user_id"], "ts", {"sum_2d": ("sum", "value"), "n_2d": ("count", "event_id")}, 2)
    return out.select("event_id", F.round("sum_2d", 4).alias("sum_2d"), "n_2d")


@query(
    "win_rolling_rows",
    """SELECT event_id, round(avg(value) OVER w, 4) AS avg_3, max(value) OVER w AS max_3, count(*) OVER w AS n_3 FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    out = op.rolling_rows(
        t.events, ["user_id"], ["ts", "event_id"],
        {"avg_3": F.avg("value"), "max_3": F.max("value"), "n_3": F.count(F.lit(1))}, 3, slice_by=day(),
    )
    return out.select("event_id", F.round("avg_3", 4).alias("avg_3"), "max_3", "n_3")


@query(
    "win_rolling_range",
    """SELECT event_id, round(sum(value) OVER w, 4) AS sum_2d, count(event_id) OVER w AS n_2d FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)""",
)
def _(t):
    out = op.rolling_days(t.events, ["user_id"], "ts", {"sum_2d": ("sum", "value"), "n_2d": ("count", "event_id")}, 2)
    return out.select("event_id", F.round("sum_2d", 4).alias("sum_2d"), "n_2d")


@query(
    "win_cumulative",
    """SELECT event_id, round(sum(value) OVER w, 4) AS running_value, count(*) OVER w AS running_count FROM events
       WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(t):
    out = op.running_total(
        t.events, ["event_type"], ["ts", "event_id"], {"running_value": F.col("value"), "running_count": F.lit(1).cast("long")}, slice_by=day()
    )
    return out.select("event_id", F.round("running_value", 4).alias("running_value"), "running_count")


@query(
    "win_lookback",
    """SELECT event_id, n_7d FROM (SELECT event_id, ts, count(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n_7d FROM events)
       WHERE CAST(ts AS DATE) = DATE '2024-01-15'""",
)
def _(t):
    out = op.lookback(
        t.events.select("event_id", "user_id", "ts"),
        lambda df: op.rolling_days(df, ["user_id"], "ts", {"n_7d": ("count", "event_id")}, 7),
        F.col("ts").cast("date") == F.lit("2024-01-15").cast("date"),
        F.col("ts").between(F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-16").cast("timestamp_ntz")),
    )
    return out.select("event_id", "n_7d")


@query(
    "win_spec",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near_sum,
              lag(event_id, 2) OVER (PARTITION BY event_type ORDER BY ts) AS two_back, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS number,
              count(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events""",
)
def _(t):
    by = {"partition_by": ["event_type"], "order_by": ["ts"]}
    out = op.apply_specs(
        t.events,
        [
            {"column": "near_sum", "function": "sum", "argument": "value", "frame": "rows between 2 preceding and 1 following", **by},
            {"column": "two_back", "function": "lag", "argument": "event_id", "offset": 2, **by},
            {"column": "number", "function": "row_number", **by},
            {"column": "seen", "function": "count", "argument": "value", **by},
        ],
        slice_by=day(),
    )
    return out.select("event_id", F.round("near_sum", 4).alias("near_sum"), "two_back", "number", "seen")


@query(
    "win_spec_frames",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW), 4) AS sum_7d,
              count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW) AS n_3d,
              avg(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg_so_far,
              lag(event_id, 3) OVER (ORDER BY ts, event_id) AS three_back, max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top
       FROM events""",
)
def _(t):
    user = {"partition_by": ["user_id"], "order_by": ["ts"]}
    table = {"partition_by": [], "order_by": ["ts", "event_id"]}
    out = op.apply_specs(
        t.events,
        [
            {"column": "sum_7d", "function": "sum", "argument": "value", "frame": "range between 7 days preceding and current row", **user},
            {"column": "n_3d", "function": "count", "argument": "*", "frame": "range between 3 days preceding and current row", **user},
            {"column": "avg_so_far", "function": "avg", "argument": "user_id", "partition_by": ["event_type"], "order_by": ["ts", "event_id"]},
            {"column": "three_back", "function": "lag", "argument": "event_id", "offset": 3, **table},
            {"column": "top", "function": "max", "argument": "value", **table},
        ],
        slice_by=day(),
    )
    return out.select("event_id", F.round("sum_7d", 4).alias("sum_7d"), "n_3d", "avg_so_far", "three_back", "top")


@query(
    "win_spec_following",
    """WITH e AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events)
       SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 2 FOLLOWING), 4) AS sum_past_2,
              count(*) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_left, min(value) OVER (w ROWS BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS min_later,
              count(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS n_before,
              avg(user_id) OVER (w ROWS BETWEEN 3 PRECEDING AND UNBOUNDED FOLLOWING) AS avg_from_3, max(value) OVER (PARTITION BY event_type) AS top,
              lag(event_id, 2, -1) OVER w AS two_back, lead(event_id, 3, 0) OVER w AS three_on, CAST(sum(event_id) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS BIGINT) AS next_ids,
              count(*) OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST) AS n_with_peers,
              round(sum(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAYS FOLLOWING), 4) AS sum_next_2d
       FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id)""",
)
def _(t):
    events = t.events.select("event_id", "user_id", "event_type", "value", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    by = {"partition_by": ["event_type"], "order_by": ["ts", "event_id"]}
    made = op.apply_specs(
        events,
        [
            {"column": "sum_past_2", "function": "sum", "argument": "value", "frame": "rows between unbounded preceding and 2 following", **by},
            {"column": "n_left", "function": "count", "argument": "*", "frame": "rows between current row and unbounded following", **by},
            {"column": "min_later", "function": "min", "argument": "value", "frame": "rows between 3 following and unbounded following", **by},
            {"column": "n_before", "function": "count", "argument": "value", "frame": "rows between unbounded preceding and 2 preceding", **by},
            {"column": "avg_from_3", "function": "avg", "argument": "user_id", "frame": "rows between 3 preceding and unbounded following", **by},
            {"column": "top", "function": "max", "argument": "value", "frame": "rows between unbounded preceding and unbounded following", **by},
            {"column": "two_back", "function": "lag", "argument": "event_id", "offset": 2, "default": -1, **by},
            {"column": "three_on", "function": "lead", "argument": "event_id", "offset": 3, "default": 0, **by},
            {"column": "next_ids", "function": "sum", "argument": "event_id", "frame": "rows between 1 following and 4 following", **by},
            {"column": "n_with_peers", "function": "count", "argument": "*", "frame": "range between unbounded preceding and current row", "partition_by": ["event_type"], "order_by": ["ts"]},
            {"column": "sum_next_2d", "function": "sum", "argument": "value", "frame": "range between current row and 2 days following", "partition_by": ["user_id"], "order_by": ["ts"]},
        ],
        slice_by=day(),
    )
    rounded = {c: F.round(c, n) for c, n in {"sum_past_2": 4, "sum_next_2d": 4}.items()}
    return made.withColumns(rounded).drop("user_id", "event_type", "value", "ts")


@query(
    "win_rank_family",
    """SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS drnk, ntile(7) OVER w2 AS bin, cume_dist() OVER w AS cd, percent_rank() OVER w AS pr, row_number() OVER w2 AS rn
       FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate), w2 AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    ranks = op.rank_family(
        rows, ["o_orderpriority"], ["o_orderdate"], {"rnk": "rank", "drnk": "dense_rank", "cd": "cume_dist", "pr": "percent_rank"}, slice_by=month("o_orderdate")
    )
    out = op.rank_family(ranks, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], {"bin": "ntile(7)", "rn": "row_number"}, slice_by=month("o_orderdate"))
    return out.drop("o_orderpriority", "o_orderdate")


@query(
    "win_rank_desc",
    """SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC) AS rnk, dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC) AS drnk FROM events""",
)
def _(t):
    rows = t.events.select("event_id", "event_type", day().alias("day"))
    return op.rank_family(rows, ["event_type"], ["day desc"], {"rnk": "rank", "drnk": "dense_rank"}, slice_by=F.trunc("day", "week")).drop("event_type", "day")


@query(
    "win_lag_lead",
    """SELECT event_id, lag(value, 1) OVER w AS prev_value, lag(event_type, 3) OVER w AS third_back, lead(ts, 2) OVER w AS next_ts FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t):
    out = op.lag_lead(
        t.events, ["user_id"], ["ts", "event_id"], {"prev_value": ("value", 1), "third_back": ("event_type", 3)}, {"next_ts": ("ts", 2)}, slice_by=day()
    )
    return out.select("event_id", "prev_value", "third_back", "next_ts")
