"""Function-group queries: every offered function over whole tables."""

from pyspark.sql import functions as F

from ..functions.catalog import project, register_tokenizer
from ..operators.windows import lag_lead, rank_family
from .registry import query


def both(key, table, spark_exprs, duck_exprs):
    """Same names on both sides, one expression list per engine."""
    sql = f"SELECT {', '.join(f'{e} AS {n}' for n, e in duck_exprs.items())} FROM {table}"

    @query(key, sql)
    def _(t):
        return project(getattr(t, table), spark_exprs)


def _soundex_sql(c: str) -> str:
    """Codes letter by letter: H and W (7) vanish, other characters and vowels (0) part equal codes."""
    letters = f"translate(regexp_replace(upper({c}), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    codes = f"replace(left({letters}, 1), '7', '0') || replace(substr({letters}, 2), '7', '')"
    for digit in "123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    return f"rpad(upper(left({c}, 1)) || left(replace(substr({codes}, 2), '0', ''), 3), 4, '0')"


SOUNDEX_SQL = _soundex_sql("p_name")

both(
    "fn_string", "part",
    {
        "k": "p_partkey", "a": "upper(p_name)", "b": "lower(p_type)", "c": "trim(concat('  ', p_name, ' '))", "d": "ltrim(concat(' ', p_name))", "e": "rtrim(concat(p_name, ' '))",
        "f": "length(p_name)", "g": "substring(p_name, 2, 3)", "h": "concat(p_brand, '/', p_type)", "i": "concat_ws('-', p_brand, p_type)", "j": "replace(p_brand, '#', '_')",
        "l": "regexp_replace(p_name, '[aeiou]+', '.')", "m": "regexp_extract(p_brand, '#([0-9]+)', 1)", "n": "element_at(split(p_name, ' '), 1)", "o": "lpad(p_size, 4, '0')",
        "p": "rpad(p_type, 8, '.')", "q": "reverse(p_name)", "r": "initcap(p_type)", "s": "translate(p_name, 'aeiou', 'AEIOU')", "u": "soundex(p_name)",
    },
    {
        "k": "p_partkey", "a": "upper(p_name)", "b": "lower(p_type)", "c": "p_name", "d": "ltrim(' ' || p_name)", "e": "rtrim(p_name || ' ')",
        "f": "CAST(length(p_name) AS INTEGER)", "g": "substring(p_name, 2, 3)", "h": "concat(p_brand, '/', p_type)", "i": "concat_ws('-', p_brand, p_type)", "j": "replace(p_brand, '#', '_')",
        "l": "regexp_replace(p_name, '[aeiou]+', '.', 'g')", "m": "regexp_extract(p_brand, '#([0-9]+)', 1)", "n": "string_split(p_name, ' ')[1]", "o": "lpad(CAST(p_size AS VARCHAR), 4, '0')",
        "p": "rpad(p_type, 8, '.')", "q": "reverse(p_name)", "r": "upper(left(p_type, 1)) || lower(substr(p_type, 2))", "s": "translate(p_name, 'aeiou', 'AEIOU')", "u": SOUNDEX_SQL,
    },
)
both(
    "fn_string_sql", "orders",
    {"k": "o_orderkey", "a": "repeat(o_orderstatus, 3)", "b": "o_orderpriority LIKE '%URG%'", "c": "o_orderpriority RLIKE '^[1-3]'"},
    {"k": "o_orderkey", "a": "repeat(o_orderstatus, 3)", "b": "o_orderpriority LIKE '%URG%'", "c": "regexp_matches(o_orderpriority, '^[1-3]')"},
)
both(
    "fn_hash", "documents",
    {"k": "doc_id", "a": "sha2(text, 256)", "b": "md5(text)", "c": "length(sha2(source, 512))"},
    {"k": "doc_id", "a": "sha256(text)", "b": "md5(text)", "c": "128"},
)
both(
    "fn_math", "customer",
    {
        "k": "c_custkey", "a": "abs(c_acctbal)", "b": "ceil(c_acctbal)", "c": "floor(c_acctbal)", "d": "round(c_acctbal, 1)", "e": "round(sqrt(abs(c_acctbal)), 6)", "f": "round(power(c_nationkey, 2), 4)",
        "g": "mod(c_custkey, 7)", "h": "round(ln(abs(c_acctbal) + 1), 6)", "i": "round(log(10, abs(c_acctbal) + 1), 6)", "j": "round(exp(c_nationkey / 10), 6)", "l": "greatest(c_nationkey, 12)",
        "m": "least(c_nationkey, 12)", "n": "sign(c_acctbal)", "o": "round(try_divide(c_acctbal, c_nationkey), 8)",
    },
    {
        "k": "c_custkey", "a": "abs(c_acctbal)", "b": "CAST(ceil(c_acctbal) AS BIGINT)", "c": "CAST(floor(c_acctbal) AS BIGINT)", "d": "round(c_acctbal, 1)", "e": "round(sqrt(abs(c_acctbal)), 6)", "f": "round(power(c_nationkey, 2), 4)",
        "g": "c_custkey % 7", "h": "round(ln(abs(c_acctbal) + 1), 6)", "i": "round(log10(abs(c_acctbal) + 1), 6)", "j": "round(exp(c_nationkey / 10), 6)", "l": "greatest(c_nationkey, 12)",
        "m": "least(c_nationkey, 12)", "n": "CAST(sign(c_acctbal) AS DOUBLE)", "o": "CASE WHEN c_nationkey <> 0 THEN round(c_acctbal / c_nationkey, 8) END",
    },
)
both(
    "fn_date", "orders",
    {
        "k": "o_orderkey", "a": "date_format(o_orderdate, 'yyyy/MM/dd')", "b": "to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy')", "c": "CAST(to_timestamp(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS TIMESTAMP_NTZ)",
        "d": "datediff(DATE '2002-01-01', o_orderdate)", "e": "date_add(o_orderdate, 10)", "f": "date_sub(o_orderdate, 10)", "g": "add_months(o_orderdate, 2)",
        "h": "round(months_between(trunc(o_orderdate, 'MM'), DATE '1995-01-01'), 4)", "i": "current_date() > o_orderdate", "j": "current_timestamp() > o_orderdate",
    },
    {
        "k": "o_orderkey", "a": "strftime(o_orderdate, '%Y/%m/%d')", "b": "CAST(o_orderdate AS DATE)", "c": "o_orderdate",
        "d": "CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS INTEGER)", "e": "CAST(o_orderdate + INTERVAL 10 DAY AS DATE)", "f": "CAST(o_orderdate - INTERVAL 10 DAY AS DATE)", "g": "CAST(o_orderdate + INTERVAL 2 MONTH AS DATE)",
        "h": "CAST(date_diff('month', TIMESTAMP '1995-01-01', date_trunc('month', o_orderdate)) AS DOUBLE)", "i": "true", "j": "true",
    },
)
both(
    "fn_date_part", "events",
    {
        "k": "event_id", "a": "year(ts)", "b": "month(ts)", "c": "day(ts)", "d": "dayofweek(ts)", "e": "hour(ts)", "f": "minute(ts)", "g": "second(ts)", "h": "last_day(ts)", "i": "trunc(ts, 'MM')",
        "j": "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)", "l": "unix_timestamp(ts)", "m": "from_unixtime(unix_timestamp(ts), 'yyyy-MM-dd HH:mm')", "n": "quarter(ts)", "o": "weekofyear(ts)",
        "p": "size(sequence(CAST(ts AS DATE), DATE '2024-02-10', INTERVAL 1 DAY))",
    },
    {
        "k": "event_id", "a": "CAST(year(ts) AS INTEGER)", "b": "CAST(month(ts) AS INTEGER)", "c": "CAST(day(ts) AS INTEGER)", "d": "CAST(dayofweek(ts) + 1 AS INTEGER)", "e": "CAST(hour(ts) AS INTEGER)", "f": "CAST(minute(ts) AS INTEGER)",
        "g": "CAST(second(ts) AS INTEGER)", "h": "last_day(ts)", "i": "CAST(date_trunc('month', ts) AS DATE)", "j": "CAST(date_trunc('hour', ts) AS TIMESTAMP)", "l": "CAST(epoch(date_trunc('second', ts)) AS BIGINT)", "m": "strftime(ts, '%Y-%m-%d %H:%M')",
        "n": "CAST(quarter(ts) AS INTEGER)", "o": "CAST(weekofyear(ts) AS INTEGER)", "p": "CAST(len(range(CAST(ts AS DATE), DATE '2024-02-11', INTERVAL 1 DAY)) AS INTEGER)",
    },
)
both(
    "fn_conditional", "orders",
    {
        "k": "o_orderkey", "a": "coalesce(nullif(o_orderstatus, 'P'), 'none')", "b": "nvl(nullif(o_orderstatus, 'F'), 'closed')", "c": "nvl2(nullif(o_orderstatus, 'F'), 'open', 'closed')", "d": "nullif(o_orderpriority, '5-LOW')",
        "e": "if(o_totalprice > 100000, 'big', 'small')", "f": "CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END", "g": "decode(o_orderstatus, 'F', 'done', 'O', 'open', 'other')",
    },
    {
        "k": "o_orderkey", "a": "coalesce(nullif(o_orderstatus, 'P'), 'none')", "b": "CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END", "c": "CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END", "d": "nullif(o_orderpriority, '5-LOW')",
        "e": "if(o_totalprice > 100000, 'big', 'small')", "f": "CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END", "g": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END",
    },
)
both(
    "fn_cast", "orders",
    {
        "k": "o_orderkey", "a": "int(floor(o_totalprice))", "b": "double(o_custkey)", "c": "string(o_custkey)", "d": "boolean(if(o_orderstatus = 'F', 'true', 'false'))", "e": "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE)",
        "f": "try_cast(o_orderpriority AS INT)", "g": "try_cast(left(o_orderpriority, 1) AS INT)", "h": "CAST(decimal(o_custkey) AS BIGINT)",
    },
    {
        "k": "o_orderkey", "a": "CAST(floor(o_totalprice) AS INTEGER)", "b": "CAST(o_custkey AS DOUBLE)", "c": "CAST(o_custkey AS VARCHAR)", "d": "o_orderstatus = 'F'", "e": "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE)",
        "f": "CAST(NULL AS INTEGER)", "g": "CAST(left(o_orderpriority, 1) AS INTEGER)", "h": "o_custkey",
    },
)
both(
    "fn_array", "part",
    {
        "k": "p_partkey", "a": "size(split(p_name, ' '))", "b": "array_contains(split(p_name, ' '), 'ring')", "c": "concat_ws(',', flatten(array(split(p_name, ' '), array(p_type))))", "d": "concat_ws(',', array_remove(array(p_brand, p_type), 'PROMO'))",
    },
    {
        "k": "p_partkey", "a": "CAST(len(string_split(p_name, ' ')) AS INTEGER)", "b": "list_contains(string_split(p_name, ' '), 'ring')", "c": "array_to_string(list_concat(string_split(p_name, ' '), [p_type]), ',')",
        "d": "array_to_string(list_filter([p_brand, p_type], lambda x: x <> 'PROMO'), ',')",
    },
)


@query("fn_array_explode", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, string_split(p_name, ' ')[i] AS word FROM part, (SELECT unnest([1, 2]) AS i) WHERE i <= len(string_split(p_name, ' '))")
def _(t):
    return t.part.selectExpr("p_partkey", "posexplode(split(p_name, ' ')) AS (pos, word)")


@query(
    "fn_map",
    "SELECT p_partkey, 'brand' AS key, p_brand AS value, 2 AS n FROM part UNION ALL SELECT p_partkey, 'type', p_type, 2 FROM part",
)
def _(t):
    mapped = t.part.selectExpr("p_partkey", "map('brand', p_brand, 'type', p_type) AS m")
    checked = mapped.filter("array_contains(map_keys(m), 'brand') AND array_contains(map_values(m), m['type'])")
    return checked.selectExpr("p_partkey", "size(m) AS n", "explode(m) AS (key, value)")


both(
    "fn_json", "events",
    {
        "k": "event_id", "a": "CAST(get_json_object(props, '$.k') AS INT)", "b": "from_json(props, 'k INT').k", "c": "to_json(named_struct('id', event_id, 'type', event_type))", "d": "named_struct('x', named_struct('y', event_type)).x.y",
    },
    {
        "k": "event_id", "a": "CAST(json_extract_string(props, '$.k') AS INTEGER)", "b": "CAST(json_extract(props, '$.k') AS INTEGER)", "c": "'{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}'", "d": "event_type",
    },
)


@query(
    "fn_aggregate",
    """SELECT event_type, round(sum(value), 4) AS s, count(*) AS c, round(avg(value), 4) AS a, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS d FROM events GROUP BY event_type""",
)
def _(t):
    return t.events.groupBy("event_type").agg(
        F.expr("round(sum(value), 4)").alias("s"), F.expr("count(*)").alias("c"), F.expr("round(avg(value), 4)").alias("a"),
        F.expr("min(value)").alias("lo"), F.expr("max(value)").alias("hi"), F.expr("count(DISTINCT user_id)").alias("d"),
    )


@query(
    "fn_window",
    """SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def _(t):
    day = F.col("ts").cast("date")
    ranked = rank_family(
        t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts"], {"rn": "row_number", "rk": "rank", "dr": "dense_rank"}, slice_by=day
    )
    out = lag_lead(ranked, ["event_type"], ["ts"], {"before": ("value", 1)}, {"after": ("value", 1)}, slice_by=day)
    return out.drop("event_type", "ts", "value")


@query("fn_tokenize", "SELECT c_custkey, sha256('key-2|name|' || c_name) AS token FROM customer")
def _(t):
    register_tokenizer(t.spark, "key-2", "tokenize")
    return project(t.customer, {"c_custkey": "c_custkey", "token": "tokenize('name', c_name)"})
