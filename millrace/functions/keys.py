"""Keys and fingerprints built from column values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "<null>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_key(columns: Sequence[str | Column], sep: str = "|") -> Column:
    """Text of the natural key; nulls keep their place so that (a, null) and (null, a) differ."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit(NULL_MARK)) for c in columns]
    return F.concat_ws(sep, *parts)


def surrogate_key(columns: Sequence[str | Column], sep: str = "|") -> Column:
    return F.sha2(joined_key(columns, sep), 256)


def row_hash(columns: Sequence[str | Column]) -> Column:
    """64-bit fingerprint for order-insensitive checksums; never used as a proof of equality."""
    return F.xxhash64(*[_col(c) for c in columns])


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two column lists."""
    result = F.lit(True)
    for a, b in zip(left, right, strict=True):
        result = result & a.eqNullSafe(b)
    return result


def hash_share(key: str | Column) -> Column:
    """A reproducible number in [0, 1) per key, independent of file layout and partitioning."""
    prefix = F.substring(F.md5(_col(key).cast("string")), 1, 8)
    return F.conv(prefix, 16, 10).cast("long") / F.lit(2.0**32)
