"""Projections, casts and value clean-up. Every step is one narrow select."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, need, need_columns
from ..functions.keys import surrogate_key as key_expr
from ..functions.sizes import broadcast_if_small


class Split(NamedTuple):
    """Two frames that together hold every input row."""

    accepted: DataFrame
    rejected: DataFrame


def compute_once(df: DataFrame, columns: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """Project to kept columns and the given named expressions, each evaluated once per row.

    Catalyst copies the expressions of a projection into later filters and projections. For dear
    ones (parsing, patterns) a one-element generator keeps them in one place. Filters on kept
    columns still reach the scan.
    """
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*columns))))


def add_column(df: DataFrame, name: str = "", expression: str = "") -> DataFrame:
    if not name.strip() or not expression.strip():
        return df
    return df.withColumn(name, F.expr(expression))


def derive(df: DataFrame, derived: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """All expressions see the input schema; drops apply before a same-named derived column."""
    need(bool(derived), "MISSING_EXPRESSIONS", "derive needs at least one expression")
    gone = {c.lower() for c in drop}
    replaced = {c.lower() for c in derived}
    clash = [c for c in df.columns if c.lower() in replaced - gone]
    need(not clash, "COLUMN_EXISTS", f"derived names already present: {clash}")
    kept = [F.col(c) for c in df.columns if c.lower() not in gone]
    return df.select(*kept, *[F.expr(e).alias(n) for n, e in derived.items()])


def transform_values(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    need_columns(df, expressions)
    return df.withColumns({c: F.expr(e) for c, e in expressions.items()})


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    need(bool(columns), "MISSING_COLUMNS", "keep needs a column list")
    return df.select(*need_columns(df, columns))


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    need_columns(df, names)
    renamed = {k.lower(): v for k, v in names.items()}
    out = [renamed.get(c.lower(), c) for c in df.columns]
    lowered = [c.lower() for c in out]
    need(len(set(lowered)) == len(lowered), "NAME_COLLISION", f"rename gives duplicate names: {out}")
    return df.withColumnsRenamed(dict(names))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    need_columns(df, types)
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def try_cast_columns(
    df: DataFrame,
    types: Mapping[str, str],
    failures: str = "cast_failures",
    flag: str = "has_cast_failure",
) -> DataFrame:
    """Bad values become null and the row lists the columns that failed."""
    need_columns(df, types)
    marks = [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()
    ]
    failed = F.filter(F.array(*marks), lambda x: x.isNotNull())
    typed = {c: F.col(c).try_cast(t) for c, t in types.items()}
    return df.withColumns({**typed, failures: failed, flag: F.size(failed) > 0})


def trim(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    need_columns(df, columns)
    return df.withColumns({c: F.trim(c) for c in columns})


def fill_nulls(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    need_columns(df, defaults)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def clean(
    df: DataFrame,
    *,
    trim_columns: Sequence[str] = (),
    defaults: Mapping[str, object] | None = None,
    names: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
    drop_columns: Sequence[str] = (),
    required: Sequence[str] = (),
    dedupe_keys: Sequence[str] = (),
    dedupe_order: Sequence[str] = (),
) -> DataFrame:
    """Trim, fill, rename, cast, drop, drop rows with nulls, keep one row per key: in that order."""
    from .windows import dedupe

    if trim_columns:
        df = trim(df, trim_columns)
    if defaults:
        df = fill_nulls(df, defaults)
    if names:
        df = rename(df, names)
    if types:
        df = cast_columns(df, types)
    if drop_columns:
        df = drop(df, drop_columns)
    if required:
        df = df.dropna(subset=need_columns(df, required))
    if dedupe_keys:
        df = dedupe(df, dedupe_keys, dedupe_order)
    return df


# Fixed patterns for contact checks.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_DIGITS = (10, 11)


def reject_by(df: DataFrame, reasons: Mapping[str, Column], reason_column: str = "reject_reasons") -> Split:
    """Split on named failure conditions; a null condition counts as passed."""
    marks = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()])
    tagged = df.withColumn(reason_column, F.filter(marks, lambda x: x.isNotNull()))
    bad = F.size(reason_column) > 0
    return Split(tagged.filter(~bad).drop(reason_column), tagged.filter(bad))


def standardize(
    df: DataFrame,
    *,
    trim_columns: Sequence[str] = (),
    lower: Sequence[str] = (),
    upper: Sequence[str] = (),
    digits: Sequence[str] = (),
    emails: Sequence[str] = (),
    phones: Sequence[str] = (),
) -> Split:
    """Normalise text columns; rows with an invalid email or phone are rejected, blank phones pass."""
    need_columns(df, [*trim_columns, *lower, *upper, *digits, *emails, *phones])
    raw_phone = {f"__raw_{c}": F.trim(c) for c in phones}
    exprs: dict[str, Column] = {}
    for c in trim_columns:
        exprs[c] = F.trim(c)
    for c in [*lower, *emails]:
        exprs[c] = F.lower(exprs.get(c, F.trim(c)))
    for c in upper:
        exprs[c] = F.upper(exprs.get(c, F.trim(c)))
    for c in [*digits, *phones]:
        exprs[c] = F.regexp_replace(exprs.get(c, F.col(c)), "[^0-9]", "")
    shaped = df
    if exprs:
        made = [v.alias(n) for n, v in {**exprs, **raw_phone}.items()]
        once = compute_once(df, made, [c for c in df.columns if c not in exprs])
        shaped = once.select(*[F.col(f"`{c}`") for c in [*df.columns, *raw_phone]])
    reasons = {f"invalid_email:{c}": ~F.col(c).rlike(EMAIL_PATTERN) for c in emails}
    for c in phones:
        given = F.coalesce(F.col(f"__raw_{c}"), F.lit("")) != ""
        reasons[f"invalid_phone:{c}"] = given & ~F.length(c).isin(*PHONE_DIGITS)
    split = reject_by(shaped, reasons)
    helpers = list(raw_phone)
    return Split(split.accepted.drop(*helpers), split.rejected.drop(*helpers))


def null_policy(df: DataFrame, policy: Mapping[str, object]) -> DataFrame:
    """Per column: ``"keep"``, ``"drop"`` (the row) or ``{"value": v}``."""
    need_columns(df, policy)
    fills, required = {}, []
    for c, p in policy.items():
        if p == "drop":
            required.append(c)
        elif isinstance(p, Mapping) and "value" in p:
            fills[c] = p["value"]
        elif p != "keep":
            raise ConfigError("INVALID_NULL_POLICY", f"{c}: {p!r}")
    if required:
        df = df.dropna(subset=required)
    return fill_nulls(df, fills) if fills else df


def contract(
    df: DataFrame,
    columns: Sequence[Mapping[str, str]],
    *,
    strict: bool = True,
) -> DataFrame:
    """Project to an ordered contract of ``{name, source, type}``; non-strict keeps the rest behind."""
    need(bool(columns), "MISSING_CONTRACT", "contract needs columns")
    sources = need_columns(df, [c.get("source", c["name"]) for c in columns])
    out = []
    for c, s in zip(columns, sources, strict=True):
        value = F.col(s).cast(c["type"]) if c.get("type") else F.col(s)
        out.append(value.alias(c["name"]))
    if not strict:
        used = {s.lower() for s in sources}
        out += [F.col(c) for c in df.columns if c.lower() not in used]
    return df.select(*out)


# Fixed layouts and words accepted when values are normalised.
DATE_LAYOUTS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyy/MM/dd")
TRUE_WORDS = ("y", "yes", "true", "t", "1")
FALSE_WORDS = ("n", "no", "false", "f", "0")


def layout_shape(layout: str) -> str:
    """Regular expression of the texts a layout can match."""
    shape = re.sub(r"[^A-Za-z]", lambda m: re.escape(m.group()), layout)
    for part, digits in (("yyyy", r"\d{4}"), ("MMM", "[A-Za-z]{3}"), ("MM", r"\d{2}"), ("dd", r"\d{2}")):
        shape = shape.replace(part, digits)
    return f"^{shape}$"


def parse_date(value: Column, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """First layout that fits. A parser runs only on texts of its shape: a failed parse is dear."""
    tries = [F.when(value.rlike(layout_shape(p)), F.try_to_timestamp(value, F.lit(p))) for p in layouts]
    return F.coalesce(*tries).cast("date")


def parse_boolean(value: Column) -> Column:
    word = F.lower(value)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def contract_values(df: DataFrame, columns: Sequence[Mapping[str, object]]) -> Split:
    """Contract with value normalisation; a given value that fits no layout rejects the row."""
    need_columns(df, [str(c["source"]) for c in columns])
    given = [F.trim(F.col(f"`{c['source']}`").cast("string")) for c in columns]
    texts = compute_once(df, [F.when(g != "", g).alias(f"__t{i}") for i, g in enumerate(given)])
    typed, reasons = [], {}
    for i, c in enumerate(columns):
        name, kind, raw = str(c["name"]), str(c.get("type", "string")), F.col(f"__t{i}")
        if kind == "date":
            value = parse_date(raw)
        elif kind == "boolean":
            value = parse_boolean(raw)
        elif kind == "string":
            value = F.upper(raw) if c.get("upper") else raw
        else:
            value = raw.try_cast(kind)
        typed += [value.alias(name), raw.isNotNull().alias(f"__given_{name}")]
        if kind != "string":
            reasons[f"bad_cast:{name}"] = F.col(f"__given_{name}") & F.col(name).isNull()
    split = reject_by(compute_once(texts, typed), reasons)
    helpers = [f"__given_{c['name']}" for c in columns]
    return Split(split.accepted.drop(*helpers), split.rejected.drop(*helpers))


def lookup_standardize(
    df: DataFrame,
    column: str,
    lookup: DataFrame,
    raw: str,
    standard: str,
    *,
    unmapped: str = "default",
    default: str = "OTHER",
) -> Split:
    """Replace a dimension value through a lookup; unmapped rows are rejected, bucketed or flagged."""
    need(unmapped in ("reject", "default", "log"), "INVALID_UNMAPPED_POLICY", unmapped)
    need_columns(df, [column])
    need_columns(lookup, [raw, standard])
    side = broadcast_if_small(
        lookup.groupBy(F.col(raw).alias("__raw")).agg(F.min(standard).alias("__std"))
    )
    joined = df.join(side, F.col(column).eqNullSafe(F.col("__raw")), "left")
    mapped = F.col("__std").isNotNull()
    if unmapped == "reject":
        good = joined.filter(mapped).withColumn(column, F.col("__std")).drop("__raw", "__std")
        return Split(good, joined.filter(~mapped).drop("__raw", "__std"))
    if unmapped == "default":
        good = joined.withColumn(column, F.coalesce("__std", F.lit(default)))
    else:
        good = joined.withColumns(
            {column: F.coalesce("__std", F.col(column)), f"{column}_unmapped": ~mapped}
        )
    good = good.drop("__raw", "__std")
    return Split(good, joined.filter(F.lit(False)).drop("__raw", "__std"))


def add_surrogate_key(df: DataFrame, name: str, columns: Sequence[str], sep: str = "|") -> DataFrame:
    need_columns(df, columns)
    return df.withColumn(name, key_expr(columns, sep))
