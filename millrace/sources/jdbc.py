"""JDBC sources: the options are built here, the driver jar comes from the cluster."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..errors import need

# Fixed drivers and URL heads per connector.
DIALECTS = {
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}/?db={database}", 443),
}
FETCH_SIZE = 10_000
PARTITIONS = 8


def connection_options(connector: str, host: str, database: str, port: int | None = None, **extra: str) -> dict[str, str]:
    need(connector in DIALECTS, "UNKNOWN_CONNECTOR", connector)
    driver, url, default_port = DIALECTS[connector]
    return {"driver": driver, "url": url.format(host=host, port=port or default_port, database=database), **extra}


def table_options(connection: Mapping[str, str], table: str, fetch_size: int = FETCH_SIZE) -> dict[str, str]:
    need(bool(table), "MISSING_TABLE", "a table read needs its name")
    return {**connection, "dbtable": table, "fetchsize": str(fetch_size)}


def substitute_dates(query: str, tokens: Mapping[str, date]) -> str:
    """Replace ``[[TOKEN]]`` by ISO dates; an unknown token is refused."""
    def value(match: re.Match) -> str:
        name = match.group(1).strip()
        need(name in tokens, "UNKNOWN_MNEMONIC", name)
        return tokens[name].isoformat()

    return re.sub(r"\[\[([^\]]+)\]\]", value, query)


def query_options(connection: Mapping[str, str], query: str, tokens: Mapping[str, date] | None = None) -> dict[str, str]:
    need(bool(query.strip()), "MISSING_QUERY", "a query read needs its text")
    return {**connection, "query": substitute_dates(query, tokens or {}), "fetchsize": str(FETCH_SIZE)}


def partitioned_options(
    connection: Mapping[str, str], table: str, column: str, lower: object, upper: object, partitions: int = PARTITIONS, fetch_size: int = FETCH_SIZE
) -> dict[str, str]:
    """Range-partitioned parallel read; bounds only place the cuts, they drop no rows."""
    need(bool(column), "MISSING_PARTITION_COLUMN", "a parallel read needs a partition column")
    need(partitions > 0, "INVALID_PARTITIONS", str(partitions))
    return {
        **table_options(connection, table, fetch_size),
        "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**dict(options)).load()
