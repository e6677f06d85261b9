"""File sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, need, need_columns
from ..functions.sizes import broadcast_if_small
from ..session import materialise

FORMATS = ("csv", "json", "parquet", "orc", "avro", "text")


def read_files(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Files of a known format; an unknown format is read as parquet."""
    kind = fmt.lower() if fmt.lower() in FORMATS else "parquet"
    reader = spark.read.format(kind)
    defaults = {"csv": {"header": "true"}, "parquet": {"mergeSchema": "true"}}.get(kind, {})
    for k, v in {**defaults, **options}.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path if isinstance(path, str) else list(path))


class CsvLoad(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    bad_files: DataFrame


def read_tolerant_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    *,
    delimiter: str = ",",
    corrupt: str = "corrupt_record",
) -> CsvLoad:
    """Typed CSV: rows that do not fit the schema are set aside with their raw text.

    A file whose header differs from the schema is rejected as a whole; an empty file is allowed.
    The text is parsed once and landed as parquet in the shared folder: Spark parses only the CSV
    columns a query asks for, so whether a row is corrupt must be settled before any projection.
    """
    paths = [path] if isinstance(path, str) else list(path)
    marked = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    rows = (
        spark.read.schema(marked)
        .option("header", "true").option("sep", delimiter).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .csv(paths)
        .select("*", F.col("_metadata.file_path").alias("__file"))
    )
    bad = first_lines(spark, paths).filter(F.trim("first_line") != delimiter.join(schema.names))
    names = broadcast_if_small(bad.select(F.col("file").alias("__file")))
    usable = materialise(rows.join(names, "__file", "left_anti").drop("__file"), "csv")
    return CsvLoad(
        usable.filter(F.col(corrupt).isNull()).drop(corrupt), usable.filter(F.col(corrupt).isNotNull()), bad
    )


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, first_line``: the earliest line of the block at offset 0, one row per non-empty file."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    # One task reads a block from front to back, so its row ids follow the lines.
    heads = lines.filter(F.col("start") == 0).withColumn("at", F.monotonically_increasing_id())
    return heads.groupBy("file").agg(F.min_by("value", "at").alias("first_line"))


def fan_in(
    frames: Mapping[str, DataFrame], mode: str = "union", order: str | None = None, source: str = "source", rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Several sources as one: plain union, or interleaved by each source's own order.

    Interleaving sorts by (position within the source, source). Positions come from windows over even
    slices of the order column, whose edges one pass over that column finds; rows that tie in it are
    ordered by a hash of the whole row. The sort itself is a range-partitioned sort.
    """
    need(mode in ("union", "interleave"), "INVALID_MODE", mode)
    need(bool(frames), "MISSING_INPUT", "fan-in needs sources")
    tagged = [df.withColumn(source, F.lit(n)) for n, df in frames.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if mode == "union":
        return both
    need(order is not None, "MISSING_ORDER", "interleave needs an order column")
    from ..functions.quantiles import with_even_slices
    from ..operators.windows import rank_family

    whole = [F.col(f"`{f.name}`") for f in both.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tied = both.withColumn("__tie", F.xxhash64(*whole))
    sliced = with_even_slices(tied, str(order), F.col("__tie"), "__even", rows_per_slice)
    numbered = rank_family(sliced, [source], [str(order), "__tie"], {"position": "row_number"}, slice_by=F.col("__even"))
    return numbered.drop("__tie", "__even").orderBy("position", source)


EVOLUTION = ("add_columns", "strict", "log_and_skip")


def evolve_union(base: DataFrame, incoming: DataFrame, policy: str = "add_columns") -> DataFrame:
    """Append a source whose schema may differ: add its new columns, refuse, or leave them out."""
    if policy not in EVOLUTION:
        raise ConfigError("INVALID_EVOLUTION_POLICY", policy)
    have = {f.name: f.dataType for f in base.schema.fields}
    extra = [c for c in incoming.columns if c not in have]
    missing = [c for c in have if c not in incoming.columns]
    changed = [f.name for f in incoming.schema.fields if f.name in have and f.dataType != have[f.name]]
    if policy == "strict":
        need(not (extra or missing or changed), "SCHEMA_CHANGED", f"added {extra}, missing {missing}, changed {changed}")
    fitted = incoming.withColumns({c: F.col(c).try_cast(have[c]) for c in changed}) if changed else incoming
    if policy == "log_and_skip" and extra:
        fitted = fitted.drop(*extra)
    return base.unionByName(fitted, allowMissingColumns=True)


def infer_types(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Narrowest type per text column over the whole table, in one aggregate.

    Integers mixed with decimals widen to decimal, any other mix is a string; blanks make a
    column nullable.
    """
    names = need_columns(df, list(columns) or df.columns)
    # Fixed value patterns.
    patterns = {
        "integer": r"^-?\d+$",
        "decimal": r"^-?\d+\.\d+$",
        "date": r"^\d{4}-\d{2}-\d{2}$",
        "timestamp": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*$",
        "boolean": r"^(?i)(true|false)$",
    }
    rows = []
    for c in names:
        text = F.col(f"`{c}`").cast("string")
        given = F.coalesce(text, F.lit("")) != ""
        seen = F.count(F.when(given, 1))
        hits = {t: F.count(F.when(given & text.rlike(p), 1)) for t, p in patterns.items()}
        kind = F.when(seen == 0, F.lit("string"))
        for t in ("integer", "decimal", "date", "timestamp", "boolean"):
            kind = kind.when(hits[t] == seen, F.lit(t))
        kind = kind.when(hits["integer"] + hits["decimal"] == seen, F.lit("decimal")).otherwise(F.lit("string"))
        rows.append(
            F.struct(F.lit(c).alias("column_name"), kind.alias("inferred_type"), (seen < F.count(F.lit(1))).alias("is_nullable"))
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def read_paged_json(
    spark: SparkSession, path: str, page_schema: T.StructType | str, response_path: str, *, incremental: str | None = None, after: object = None
) -> DataFrame:
    """Landed response pages (one JSON document per file) to rows under ``response_path``."""
    pages = spark.read.text(path, wholetext=True)
    return explode_pages(pages, "value", page_schema, response_path, incremental=incremental, after=after)


def explode_pages(
    pages: DataFrame, column: str, page_schema: T.StructType | str, response_path: str, *, incremental: str | None = None, after: object = None
) -> DataFrame:
    need_columns(pages, [column])
    parsed = pages.select(F.from_json(F.col(column), page_schema).alias("page"))
    rows = parsed.select(F.explode(f"page.{response_path}").alias("row")).select("row.*")
    if incremental:
        need_columns(rows, [incremental])
        rows = rows.filter(F.col(incremental) > F.lit(after)) if after is not None else rows
    return rows
