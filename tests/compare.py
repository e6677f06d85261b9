"""Row-by-row comparison of a registered query with its reference SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else f"f{int(value)}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, path: str, fn, sql: str | None) -> str:
    """Empty text when equal, else what differs."""
    df = fn(spark, path)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "no reference SQL"
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"values differ in {sorted(df.columns)}: spark {only_a} duckdb {only_b}"
    return ""


def main(argv: list[str]) -> int:
    import importlib

    from millrace.plans.registry import ORACLES, QUERIES
    from millrace.session import build_session

    path, names = argv[0], argv[1:]
    for m in [n[1:] for n in names if n.startswith("@")] or []:
        importlib.import_module(f"millrace.plans.{m}")
    names = [n for n in names if not n.startswith("@")]
    if not QUERIES:
        importlib.import_module("millrace.plans")
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            problem = compare(spark, con, path, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
