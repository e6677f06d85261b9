"""Functions user expressions may call, by group. All are Spark built-ins of the same name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import need

# Fixed function names.
GROUPS: Mapping[str, tuple[str, ...]] = {
    "string": (
        "upper", "lower", "trim", "ltrim", "rtrim", "length", "substring", "concat", "concat_ws", "replace", "regexp_replace",
        "regexp_extract", "split", "lpad", "rpad", "reverse", "initcap", "soundex", "translate", "repeat", "like", "rlike",
    ),
    "hash": ("sha2", "md5"),
    "math": ("abs", "ceil", "floor", "round", "sqrt", "power", "mod", "log", "ln", "exp", "greatest", "least", "sign"),
    "date": (
        "current_date", "current_timestamp", "date_format", "to_date", "to_timestamp", "datediff", "date_add", "date_sub",
        "add_months", "months_between", "year", "month", "day", "dayofweek", "hour", "minute", "second", "last_day", "trunc",
        "date_trunc", "from_unixtime", "unix_timestamp", "quarter", "weekofyear", "sequence",
    ),
    "conditional": ("coalesce", "nvl", "nvl2", "nullif", "if", "decode"),
    "cast": ("cast", "try_cast", "int", "double", "string", "boolean", "decimal"),
    "aggregate": (
        "sum", "count", "avg", "min", "max", "count_distinct", "stddev", "variance", "percentile_approx", "first", "last",
        "collect_list", "collect_set",
    ),
    "window": ("row_number", "rank", "dense_rank", "lag", "lead", "ntile", "cume_dist"),
    "array": ("size", "array_contains", "explode", "flatten", "array", "array_remove", "posexplode"),
    "map": ("map", "map_keys", "map_values"),
    "json": ("get_json_object", "from_json", "to_json", "named_struct"),
}
# Grammar, not functions of the session catalogue.
SYNTAX = {"cast", "try_cast", "like", "count_distinct", "if"}


def missing_functions(spark: SparkSession) -> list[str]:
    """Catalogue names this Spark does not know; empty on a supported version."""
    names = {n for group in GROUPS.values() for n in group} - SYNTAX
    return sorted(n for n in names if not spark.catalog.functionExists(n))


def register_tokenizer(spark: SparkSession, key: str, name: str = "tokenize") -> None:
    """Make the keyed token callable from SQL as ``name(label, value)``: a SQL function, no Python."""
    need(bool(key) and "'" not in key, "INVALID_KEY", "the key must be plain text")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(label STRING, value STRING) RETURNS STRING "
        f"RETURN CASE WHEN value <> '' THEN sha2(concat('{key}', '|', label, '|', value), 256) END"
    )


def project(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Named SQL expressions in one projection."""
    need(bool(expressions), "MISSING_EXPRESSIONS", "needs at least one expression")
    return df.select(*[F.expr(e).alias(n) for n, e in expressions.items()])
