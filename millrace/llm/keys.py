"""What names a document where ids may be missing or stand on several texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document_key(own: Column, text: Column) -> Column:
    """What names a document: its id, null last, and a 128-bit digest of its text."""
    return F.struct(own.isNull().alias("none"), own.alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"))


def key_type(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("none", T.BooleanType()), T.StructField("id", kind), T.StructField("digest", T.BinaryType())])
