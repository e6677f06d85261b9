"""Checked sizes: nothing is broadcast unless its rows and bytes have been proven few, no task sorts too large a share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20
#: Bytes of a field beside its text, and of a row beside its fields.
FIELD_BYTES, ROW_BYTES = 8, 32
#: Bytes of input, as stored, for each task of a sort; up to so many tasks' worth Spark's own layout will do, and
#: beyond so many the session's number of shuffle partitions has to.
SORT_BYTES, PLAIN_SORTS, MOST_SORTS = 16 << 20, 4, 8192
#: What Spark says of inputs whose size it does not know is beyond this.
KNOWN_BYTES = 1 << 50


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the frame has at most ``max_rows`` rows and ``max_bytes`` bytes; reads no more than one row beyond."""
    fixed = ROW_BYTES + FIELD_BYTES * len(df.columns)
    wide = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    payload = F.octet_length(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(wide)]))) if wide else F.lit(0)
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(payload), F.lit(0)).alias("b")).first()
    return size["n"] <= max_rows and size["b"] + size["n"] * fixed <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of its size; a larger frame stays on the shuffled path."""
    return F.broadcast(df) if fits(df, max_rows) else df


def one_row(df: DataFrame, **columns: Column) -> Column:
    """A one-row aggregate as a scalar struct: Spark runs it once and reuses the value."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.agg(packed.alias("stats")).scalar()


def sort_pieces(df: DataFrame) -> int:
    """Into how many tasks a sort of the frame is cut; 0 where the input is small or of unknown size.

    The number follows the bytes of the inputs, so a task's share does not grow with them, and no job runs for it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    pieces = -(-size // SORT_BYTES)
    if pieces <= PLAIN_SORTS or size > KNOWN_BYTES:
        return 0
    return max(min(pieces, MOST_SORTS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
