"""Structs, arrays and JSON: driven by the schema, one select per step."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need, need_columns
from .columns import Split, compute_once


def flatten_fields(df: DataFrame, column: str, fields: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """Expand struct fields behind the other columns and drop the struct.

    Names carry the parent's by default; ``prefix=""`` gives bare names, which must stay unique.
    """
    need_columns(df, [column])
    struct = df.schema[column].dataType
    need(isinstance(struct, T.StructType), "NOT_A_STRUCT", column)
    names = list(fields) or struct.names
    head = f"{column}_" if prefix is None else prefix
    others = [c for c in df.columns if c != column]
    made = [f"{head}{n}" for n in names]
    lowered = [c.lower() for c in others + made]
    need(len(set(lowered)) == len(lowered), "NAME_COLLISION", f"flatten repeats a name: {made}")
    return df.select(*[F.col(f"`{c}`") for c in others], *[F.col(f"{column}.`{n}`").alias(m) for n, m in zip(names, made, strict=True)])


def _leaves(struct: T.StructType, path: tuple[str, ...], depth: int) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in struct.fields:
        here = (*path, f.name)
        if isinstance(f.dataType, T.StructType) and depth > 1:
            out += _leaves(f.dataType, here, depth - 1)
        else:
            out.append((here, f.dataType))
    return out


def _at(path: Sequence[str]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def flatten_deep(
    df: DataFrame, *, max_depth: int = 3, sep: str = "_", prefix: str = "", keep_original: bool = False
) -> DataFrame:
    """Flatten structs to ``max_depth`` levels below the top; deeper structs stay as they are."""
    out: list[Column] = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StructType):
            out.append(_at([f.name]))
            continue
        out += [_at(p).alias(prefix + sep.join(p)) for p, _ in _leaves(f.dataType, (f.name,), max_depth)]
        if keep_original:
            out.append(_at([f.name]))
    return df.select(*out)


def flatten_stringify(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Flatten every struct, turn arrays and maps into JSON text, give unique plain names.

    Also returns the mapping from output name to source path.
    """
    seen: dict[str, int] = {}
    mapping: dict[str, str] = {}
    out = []
    for path, kind in _leaves(df.schema, (), 1_000):
        name = re.sub(r"\W+", "_", "_".join(path)).strip("_").lower() or "column"
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            name = f"{name}_{seen[name]}"
        mapping[name] = ".".join(path)
        value = F.to_json(_at(path)) if isinstance(kind, (T.ArrayType, T.MapType)) else _at(path)
        out.append(value.alias(name))
    return df.select(*out), mapping


def explode_array(
    df: DataFrame, column: str, *, index: str = "item_index", item: str = "item", outer: bool = True
) -> DataFrame:
    """One row per element with its index; ``outer`` keeps parents of empty arrays."""
    need_columns(df, [column])
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    how = F.posexplode_outer if outer else F.posexplode
    return df.select(*others, how(column).alias(index, item))


def array_policy(df: DataFrame, policy: str = "explode") -> DataFrame:
    """Arrays: one row per element, JSON text, or the first element."""
    need(policy in ("explode", "stringify", "first"), "INVALID_ARRAY_POLICY", policy)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    for c in arrays:
        if policy == "explode":
            df = df.withColumn(c, F.explode_outer(c))
        elif policy == "stringify":
            df = df.withColumn(c, F.to_json(c))
        else:
            df = df.withColumn(c, F.try_element_at(F.col(c), F.lit(1)))
    return df


def parse_json(df: DataFrame, column: str, schema: T.StructType | str, *, raw: str = "raw_payload", out: str = "payload") -> DataFrame:
    """Parse a text payload; one that does not parse is kept as raw text."""
    need_columns(df, [column])
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    made = [F.when(F.col("__ok"), F.col("__e")).alias(out), F.when(~F.col("__ok"), F.col(column)).alias(raw)]
    return parsed_once(df, column, schema).select(*others, *made)


def parsed_once(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """The frame with ``__e`` (parsed struct) and ``__ok`` (the text was valid JSON).

    The text is parsed once per row, whatever reads the two columns afterwards.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(F.col(column), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    once = compute_once(df, [parsed.alias("__p")], df.columns)
    ok = F.col("__p").isNotNull() & F.col("__p._corrupt_record").isNull()
    event = F.struct(*[F.col("__p")[f.name].alias(f.name) for f in fields.fields])
    return once.select(*[F.col(f"`{c}`") for c in df.columns], event.alias("__e"), F.coalesce(ok, F.lit(False)).alias("__ok"))


def events_to_lines(
    df: DataFrame,
    payload: str,
    schema: T.StructType | str,
    items: str,
    parents: Mapping[str, str],
    item_fields: Sequence[str],
    required: Sequence[str] = (),
    reason: str = "reject_reason",
) -> Split:
    """Nested event text to one row per item with its parent fields.

    An empty array gives no row; malformed text or a missing required parent rejects the event.
    """
    need_columns(df, [payload])
    shaped = parsed_once(df, payload, schema)
    why = F.when(~F.col("__ok"), F.lit("malformed-json"))
    for r in required:
        why = why.when(F.col(f"__e.{r}").isNull(), F.lit(f"missing-{r}"))
    shaped = shaped.withColumn(reason, why)
    lines = shaped.filter(F.col(reason).isNull()).select(
        *[F.col(f"__e.{path}").alias(name) for name, path in parents.items()],
        F.posexplode(f"__e.{items}").alias("item_index", "__item"),
    )
    lines = lines.select(*parents, "item_index", *[F.col(f"__item.{f}").alias(f) for f in item_fields])
    rejected = shaped.filter(F.col(reason).isNotNull()).drop("__ok", "__e")
    return Split(lines, rejected)


def build_struct(df: DataFrame, name: str, columns: Sequence[str], *, drop_sources: bool = True) -> DataFrame:
    """Pack columns into a struct that takes the place of the first source."""
    need(bool(columns), "MISSING_COLUMNS", "struct needs columns")
    need_columns(df, columns)
    packed = F.struct(*[F.col(c) for c in columns]).alias(name)
    first = min(df.columns.index(c) for c in columns)
    out: list[Column] = []
    for i, c in enumerate(df.columns):
        if i == first:
            out.append(packed)
        if c not in columns or not drop_sources:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def build_json(
    df: DataFrame,
    structs: Mapping[str, Mapping[str, str]],
    *,
    passthrough: Sequence[str] = (),
    output: str = "json_string",
    sort_keys: bool = True,
    keep_nulls: bool = True,
    drop_sources: bool = True,
) -> DataFrame:
    """Several structs ``{name: {field: source column}}`` as structs or JSON text."""
    need(output in ("json_string", "struct"), "INVALID_OUTPUT_FORMAT", output)
    sources = [s for fields in structs.values() for s in fields.values()]
    need_columns(df, [*sources, *passthrough])
    made = []
    for name, fields in structs.items():
        items = sorted(fields.items()) if sort_keys else list(fields.items())
        packed = F.struct(*[F.col(s).alias(f) for f, s in items])
        if output == "json_string":
            packed = F.to_json(packed, {"ignoreNullFields": str(not keep_nulls).lower()})
        made.append(packed.alias(name))
    if passthrough:
        others = list(passthrough)
    else:
        others = [c for c in df.columns if not (drop_sources and c in sources)]
    return df.select(*[F.col(f"`{c}`") for c in others], *made)
