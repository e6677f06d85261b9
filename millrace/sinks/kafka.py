"""Message sinks: the encoding is a DataFrame step, the broker connector comes from the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import need, need_columns

# Fixed delivery options per guarantee.
DELIVERY = {
    "at_least_once": {"kafka.acks": "all", "kafka.retries": "10"},
    "exactly_once": {"kafka.acks": "all", "kafka.enable.idempotence": "true"},
    "at_most_once": {"kafka.acks": "0", "kafka.retries": "0"},
}


def encode(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``key``: hash of the pipe-joined key columns; ``value``: the row as JSON."""
    need(bool(keys), "MISSING_KEYS", "messages need key columns")
    need_columns(df, keys)
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), 256)
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def writer_options(servers: str, topic: str, guarantee: str = "at_least_once") -> dict[str, str]:
    need(guarantee in DELIVERY, "INVALID_GUARANTEE", guarantee)
    return {"kafka.bootstrap.servers": servers, "topic": topic, **DELIVERY[guarantee]}


def write_batch(df: DataFrame, keys: Sequence[str], servers: str, topic: str, guarantee: str = "at_least_once") -> None:
    encode(df, keys).write.format("kafka").options(**writer_options(servers, topic, guarantee)).save()
