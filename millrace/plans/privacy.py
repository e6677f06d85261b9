"""Masking queries."""

from pyspark.sql import functions as F

from ..operators import masking as op
from .registry import query


@query("msk_hash", "SELECT c_custkey, sha256(c_name) AS c_name, sha256(CAST(c_nationkey AS VARCHAR)) AS c_nationkey FROM customer")
def _(t):
    return op.hash_columns(t.customer.select("c_custkey", "c_name", "c_nationkey"), ["c_name", "c_nationkey"])


@query("msk_hash_algo", "SELECT s_suppkey, md5(s_name) AS s_name, 128 AS sha512_length FROM supplier")
def _(t):
    rows = t.supplier.select("s_suppkey", "s_name", F.col("s_name").alias("long_hash"))
    out = op.hash_columns(op.hash_columns(rows, ["s_name"], "md5"), ["long_hash"], "sha512")
    return out.select("s_suppkey", "s_name", F.length("long_hash").alias("sha512_length"))


@query(
    "msk_redact",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '***' END AS status, '***' AS o_totalprice FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"), "o_totalprice")
    return op.redact(rows, ["status", "o_totalprice"])


@query(
    "msk_last4",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'XXX-XX-' || right(c_name, 4) END AS ssn FROM customer""",
)
def _(t):
    ssn = "CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment WHEN c_mktsegment <> 'MACHINERY' THEN c_name END"
    return op.last4(t.customer.select("c_custkey", F.expr(ssn).alias("ssn")), ["ssn"])


@query(
    "msk_format_preserving",
    """SELECT p_partkey, left(p_name, 1) || repeat('*', length(p_name) - 2) || right(p_name, 1) AS p_name, repeat('*', length(CAST(p_size AS VARCHAR))) AS p_size FROM part""",
)
def _(t):
    return op.format_preserving(t.part.select("p_partkey", "p_name", "p_size"), ["p_name", "p_size"])


@query(
    "msk_normalized_hash",
    """SELECT c_custkey, sha256(lower(c_name)) AS email_hash, sha256(regexp_replace(c_name, '[^0-9]', '', 'g')) AS phone_hash,
              CASE WHEN c_mktsegment <> 'BUILDING' THEN sha256(c_mktsegment) END AS segment_hash FROM customer""",
)
def _(t):
    rows = t.customer.select(
        "c_custkey", F.concat(F.lit("  "), F.upper("c_name")).alias("email"), F.col("c_name").alias("phone"),
        F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE concat(lower(c_mktsegment), ' ') END").alias("segment"),
    )
    return op.normalised_hash(rows, {"email": "email", "phone": "phone", "segment": "text"})


TOKEN_SQL = """
WITH r AS (SELECT c_custkey, right(c_name, 9) AS ssn, CASE WHEN c_acctbal < 0 THEN c_name ELSE 'MASKED_EMAIL_EXISTING' END AS email,
                  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE '1' || right(c_name, 9) END AS phone FROM customer)
SELECT c_custkey, 'MASKED_SSN_' || left(sha256(ssn), 12) AS ssn_masked, email AS email_masked, 'MASKED_PHONE_' || left(sha256(phone), 12) AS phone_masked, '' AS reasons
FROM r WHERE email = 'MASKED_EMAIL_EXISTING'
UNION ALL SELECT c_custkey, NULL, NULL, NULL, 'invalid_email:email' FROM r WHERE email <> 'MASKED_EMAIL_EXISTING'"""


@query("msk_token_prefix", TOKEN_SQL)
def _(t):
    rows = t.customer.select(
        "c_custkey", F.expr("right(c_name, 9)").alias("ssn"), F.expr("CASE WHEN c_acctbal < 0 THEN c_name ELSE 'MASKED_EMAIL_EXISTING' END").alias("email"),
        F.expr("CASE WHEN c_mktsegment <> 'BUILDING' THEN concat('1-', right(c_name, 9)) END").alias("phone"),
    )
    split = op.token_prefix(rows, {"ssn": "ssn", "email": "email", "phone": "phone"})
    bad = split.rejected.select("c_custkey", F.concat_ws(",", "reject_reasons").alias("reasons"))
    return split.accepted.withColumn("reasons", F.lit("")).unionByName(bad, allowMissingColumns=True)


@query(
    "msk_tokenize",
    "SELECT s_suppkey, sha256('key-1|s_name|' || upper(s_name)) AS s_name_token FROM supplier",
)
def _(t):
    return op.tokenize(t.supplier.select("s_suppkey", F.concat(F.lit(" "), "s_name").alias("s_name")), {"s_name": "text"}, "key-1")


@query("msk_encrypt", "SELECT c_custkey, c_name, true AS was_hidden FROM customer")
def _(t):
    key = "0123456789abcdef"
    hidden = op.encrypt(t.customer.select("c_custkey", "c_name", F.col("c_name").alias("plain")), ["c_name"], key)
    shown = op.decrypt(hidden.withColumn("was_hidden", F.col("c_name") != F.col("plain")), ["c_name"], key)
    return shown.drop("plain")


@query(
    "msk_encrypt_format",
    """SELECT c_custkey, c_name, 'C-' || c_custkey || '/' || c_mktsegment AS code, true AS same_shape, true AS was_hidden FROM customer""",
)
def _(t):
    key = "0123456789abcdef"
    plain = t.customer.select("c_custkey", "c_name", F.expr("concat('C-', c_custkey, '/', c_mktsegment)").alias("code"), F.col("c_name").alias("plain"))
    # The rows of a small file stand in one task, and the rounds are work for all cores.
    plain = plain.repartition(t.spark.sparkContext.defaultParallelism, "c_custkey")
    hidden = op.encrypt(plain, ["c_name", "code"], key, preserve_format=True)
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    marked = hidden.withColumns({"same_shape": shape("c_name") == shape("plain"), "was_hidden": F.col("c_name") != F.col("plain")})
    return op.decrypt(marked, ["c_name", "code"], key, preserve_format=True).drop("plain")


@query(
    "msk_leak_scan",
    """SELECT 'text' AS column_name, count(*) FILTER (contains(text, '@') OR contains(text, 'http')) AS leak_count FROM documents
       UNION ALL SELECT 'lang', count(*) FILTER (contains(lang, '@') OR contains(lang, 'http')) FROM documents
       UNION ALL SELECT 'source', count(*) FILTER (contains(source, '@') OR contains(source, 'http')) FROM documents""",
)
def _(t):
    return op.leak_scan(t.documents, ["@", "http"])


def _classify_sql(column: str) -> str:
    n = "(SELECT count(*) FROM documents)"
    parts = []
    for kind, pattern in op.PII_VALUES.items():
        m = f"count(*) FILTER (regexp_matches({column}, '{pattern}'))"
        parts.append(
            f"SELECT '{column}' AS column_name, 'NONE' AS name_class, '{kind}' AS value_kind, {m} AS matches, round({m} / {n}, 6) AS share FROM documents"
        )
    return " UNION ALL ".join(parts)


@query("msk_classify", " UNION ALL ".join(_classify_sql(c) for c in ("text", "lang", "source")))
def _(t):
    return op.classify_values(op.classify_schema(t.documents))
