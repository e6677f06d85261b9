"""Masking of personal data with native expressions: no function leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, need, need_columns
from .columns import EMAIL_PATTERN, Split, reject_by

HASHES = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "md5": F.md5}


def hash_columns(df: DataFrame, columns: Sequence[str], algorithm: str = "sha256") -> DataFrame:
    need(bool(columns), "MISSING_COLUMNS", "masking needs columns")
    need(algorithm in HASHES, "INVALID_ALGORITHM", algorithm)
    need_columns(df, columns)
    return df.withColumns({c: HASHES[algorithm](F.col(c).cast("string")) for c in columns})


def redact(df: DataFrame, columns: Sequence[str], replacement: str = "***") -> DataFrame:
    need_columns(df, columns)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(replacement)) for c in columns})


def last4(df: DataFrame, columns: Sequence[str], prefix: str = "XXX-XX-") -> DataFrame:
    """Keep four trailing digits behind a fixed prefix; a value without them passes unchanged."""
    need_columns(df, columns)

    def masked(c: str) -> Column:
        text = F.col(c).cast("string")
        tail = F.regexp_extract(text, r"(\d{4})$", 1)
        return F.when(tail == "", text).otherwise(F.concat(F.lit(prefix), tail))

    return df.withColumns({c: masked(c) for c in columns})


def format_preserving(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last character kept, the middle starred; up to two characters all starred."""
    need_columns(df, columns)

    def masked(c: str) -> Column:
        text, size = F.col(c).cast("string"), F.length(F.col(c).cast("string"))
        stars = F.repeat(F.lit("*"), F.greatest(size - 2, F.lit(0)))
        middle = F.concat(F.substring(text, 1, 1), stars, F.right(text, F.lit(1)))
        return F.when(size <= 2, F.repeat(F.lit("*"), size)).otherwise(middle)

    return df.withColumns({c: masked(c) for c in columns})


def normalised(value: Column, kind: str) -> Column:
    if kind == "email":
        return F.lower(F.trim(value))
    if kind == "phone":
        return F.regexp_replace(value, "[^0-9]", "")
    if kind == "text":
        return F.upper(F.trim(value))
    if kind == "raw":
        return F.trim(value)
    raise ConfigError("INVALID_NORMALIZATION", kind)


def normalised_hash(df: DataFrame, columns: Mapping[str, str], suffix: str = "_hash") -> DataFrame:
    """``{column: kind}``: hash of the normalised value, blank to null; the raw column is dropped."""
    need_columns(df, columns)
    made = {}
    for c, kind in columns.items():
        norm = normalised(F.col(c).cast("string"), kind)
        made[f"{c}{suffix}"] = F.when(norm != "", F.sha2(norm, 256))
    return df.withColumns(made).drop(*columns)


def token_prefix(df: DataFrame, columns: Mapping[str, str], label: str = "MASKED") -> Split:
    """Deterministic tokens ``LABEL_KIND_<12 hex>`` for ``{column: ssn|email|phone}``.

    Tokens pass unchanged, blanks become null, invalid raw emails and phones are rejected.
    """
    need_columns(df, columns)
    reasons, made = {}, {}
    for c, kind in columns.items():
        text = F.trim(F.col(c).cast("string"))
        given = F.coalesce(text, F.lit("")) != ""
        head = f"{label}_{kind.upper()}_"
        is_token = text.startswith(head)
        if kind == "email":
            norm = normalised(text, "email")
            reasons[f"invalid_email:{c}"] = given & ~is_token & ~text.rlike(EMAIL_PATTERN)
        elif kind == "phone":
            norm = normalised(text, "phone")
            reasons[f"invalid_phone:{c}"] = given & ~is_token & (F.length(norm) != 10)
        else:
            norm = text
        token = F.concat(F.lit(head), F.substring(F.sha2(norm, 256), 1, 12))
        made[f"{c}_masked"] = F.when(given, F.when(is_token, text).otherwise(token))
    split = reject_by(df, reasons) if reasons else Split(df, df.filter(F.lit(False)))
    return Split(split.accepted.withColumns(made).drop(*columns), split.rejected)


def tokenize(df: DataFrame, columns: Mapping[str, str], key: str, suffix: str = "_token") -> DataFrame:
    """Keyed token of the normalised value; equal values give equal tokens under one key."""
    need(bool(key), "MISSING_KEY", "tokenisation needs a key")
    need_columns(df, columns)
    made = {}
    for c, kind in columns.items():
        norm = normalised(F.col(c).cast("string"), kind)
        made[f"{c}{suffix}"] = F.when(norm != "", F.sha2(F.concat(F.lit(key), F.lit(f"|{c}|"), norm), 256))
    return df.withColumns(made).drop(*columns)


def encrypt(df: DataFrame, columns: Sequence[str], key: str, *, preserve_format: bool = False) -> DataFrame:
    """Reversible AES encryption under a key of 16, 24 or 32 bytes.

    By default GCM with a random vector, as base64 text. ``preserve_format`` keeps the length, every
    character that is no ASCII letter or digit, and the class (digit, lower, upper) of the others; equal
    values then stay equal. Null stays null, and a text without letters or digits is its own image. As with
    any such cipher, values of few characters have few images: no secrecy below some six of them.
    """
    need(len(key.encode()) in (16, 24, 32), "INVALID_KEY", "key must have 16, 24 or 32 bytes")
    need_columns(df, columns)
    if preserve_format:
        return df.withColumns({c: _same_format(F.col(c).cast("string"), key, 1) for c in columns})
    return df.withColumns(
        {c: F.base64(F.aes_encrypt(F.col(c).cast("string"), F.lit(key), F.lit("GCM"))) for c in columns}
    )


def decrypt(df: DataFrame, columns: Sequence[str], key: str, *, preserve_format: bool = False) -> DataFrame:
    """What ``encrypt`` hid, given the same key and the same ``preserve_format``."""
    need_columns(df, columns)
    if preserve_format:
        return df.withColumns({c: _same_format(F.col(c).cast("string"), key, -1) for c in columns})
    return df.withColumns(
        {c: F.aes_decrypt(F.unbase64(F.col(c)), F.lit(key), F.lit("GCM")).cast("string") for c in columns}
    )


FEISTEL_ROUNDS = 10
CODED = "[0-9A-Za-z]"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: what stands in a lambda is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _same_format(text: Column, key: str, sign: int) -> Column:
    """An alternating Feistel network over the letters and digits of a text.

    Each round adds to every character of one half, modulo the size of its class, eight hex digits of
    AES over a digest of the other half, the round and the text's shape. Decryption subtracts in the
    reverse order of rounds. A fold carries both halves, so the expression does not grow with the rounds;
    the key stream is made once a round.
    """
    base = lambda c: F.when(c <= "9", F.lit(48)).when(c <= "Z", F.lit(65)).otherwise(F.lit(97))
    rounds = range(FEISTEL_ROUNDS) if sign > 0 else reversed(range(FEISTEL_ROUNDS))

    def stream(size: Column, other: Column, step: Column, shape: Column) -> Column:
        """Eight hex digits for each character of a half: one call of AES, whose blocks stand alone."""
        told = F.concat_ws("|", step.cast("string"), F.array_join(other.cast("array<string>"), ","), shape)
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(size) - 1, F.lit(0)) / 8).cast("int"))
        digest = lambda b, t: F.sha2(F.concat_ws("|", b.cast("string"), t), 256)
        digests = _bound(told, lambda t: F.array_join(F.transform(blocks, lambda b: digest(b, t)), ""))
        return F.hex(F.aes_encrypt(F.unhex(digests), F.lit(key), F.lit("ECB")))

    def moved(half: Column, size: Column, other: Column, step: Column, shape: Column) -> Column:
        def add(s: Column) -> Column:
            added = lambda i: F.conv(F.substring(s, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
            return F.transform(half, lambda v, i: F.pmod(v + F.lit(sign) * added(i), F.get(size, i)))

        return _bound(stream(size, other, step, shape), add)

    def turn(state: Column, step: Column) -> Column:
        a, b, m, n, shape = (state[x] for x in "abmns")
        even = step % 2 == 0
        return F.struct(
            F.when(even, moved(a, m, b, step, shape)).otherwise(a).alias("a"), F.when(even, b).otherwise(moved(b, n, a, step, shape)).alias("b"), m.alias("m"), n.alias("n"), shape.alias("s"),
        )

    def folded(coded: Column) -> Column:
        values = F.transform(coded, lambda c: (F.ascii(c) - base(c)).cast("long"))
        sizes = F.transform(coded, lambda c: F.when(c <= "9", F.lit(10)).otherwise(F.lit(26)).cast("long"))
        cut = F.floor(F.size(coded) / 2).cast("int")
        halves = lambda items, x, y: [F.slice(items, F.lit(1), cut).alias(x), F.slice(items, cut + 1, F.size(coded)).alias(y)]
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
        start = F.struct(*halves(values, "a", "b"), *halves(sizes, "m", "n"), shape.alias("s"))
        done = F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, turn, lambda s: F.concat(s["a"], s["b"]))
        letters = F.zip_with(done, coded, lambda v, c: F.char(v + base(c)))
        return F.array_join(F.zip_with(F.split(text, CODED, -1), letters, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")

    return _bound(F.regexp_extract_all(text, F.lit(f"({CODED})"), F.lit(1)), folded)


def leak_scan(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Cells that equal or contain a raw term, counted per text column in one aggregate."""
    need(bool(terms), "MISSING_TERMS", "leak scan needs terms")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    need(bool(texts), "NO_TEXT_COLUMNS", "nothing to scan")
    counts = []
    for c in texts:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.col(f"`{c}`").contains(t)
        counts.append(F.count(F.when(hit, F.lit(1))).alias(c))
    wide = df.agg(*counts)
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("leak_count")) for c in texts]))
        .alias("r")
    ).select("r.*")


# Fixed column-name patterns.
PII_NAMES = (
    "ssn", "social.?security", "tax.?id", "tin", "first.?name", "last.?name", "full.?name",
    "borrower.?name", "customer.?name", "email", "e.?mail", "phone", "mobile", "cell", "address",
    "zip", "postal", "date.?of.?birth", "dob", "birth.?date", "driver.?license", "passport",
    "account.?number", "account.?no", "routing.?number", "iban", "credit.?card", "card.?number",
)
CONFIDENTIAL_NAMES = (
    "salary", "income", "credit.?score", "fico", "loan.?amount", "debt", "ltv", "dti",
    "interest.?rate", "monthly.?payment", "balance", "principal", "escrow", "appraisal",
    "property.?value",
)
# Fixed value patterns, searched in the whole text.
PII_VALUES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


def classify_name(column: str) -> str | None:
    def hit(names: Sequence[str]) -> bool:
        return re.search(r"(?:^|_|\b)(?:" + "|".join(names) + r")(?:$|_|\b)", column, re.I) is not None

    return "PII" if hit(PII_NAMES) else "CONFIDENTIAL" if hit(CONFIDENTIAL_NAMES) else None


def classify_schema(df: DataFrame) -> DataFrame:
    """The same frame with the class of every column in its field metadata."""
    out = df
    for f in df.schema.fields:
        label = classify_name(f.name)
        if label:
            out = out.withMetadata(f.name, {**f.metadata, "classification": label, "pii": label == "PII"})
    return out


def dataset_class(df: DataFrame) -> str:
    found = {classify_name(c) for c in df.columns}
    return "PII" if "PII" in found else "CONFIDENTIAL" if "CONFIDENTIAL" in found else "INTERNAL"


def classify_values(df: DataFrame) -> DataFrame:
    """Per text column and value pattern: rows that match, and their share, in one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    need(bool(texts), "NO_TEXT_COLUMNS", "nothing to classify")
    total = F.count(F.lit(1))
    rows = []
    for c in texts:
        for kind, pattern in PII_VALUES.items():
            n = F.count(F.when(F.col(f"`{c}`").rlike(pattern), F.lit(1)))
            rows.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(classify_name(c) or "NONE").alias("name_class"),
                    F.lit(kind).alias("value_kind"),
                    n.alias("matches"),
                    F.round(F.try_divide(n, total), 6).alias("share"),
                )
            )
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
