import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def rows(spark):
    """Frame from a DDL schema and tuples; dates and timestamps may be given as text."""

    def make(schema: str, *data):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        wanted = T.StructType.fromDDL(schema)
        soft = T.StructType(
            [T.StructField(f.name, T.StringType() if f.dataType.simpleString() in ("date", "timestamp", "timestamp_ntz") else f.dataType) for f in wanted.fields]
        )
        df = spark.createDataFrame(list(data), soft)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])

    return make


def values(df, *columns):
    """Sorted row tuples with nulls first."""
    frame = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="session", name="values")
def values_fixture():
    return values
