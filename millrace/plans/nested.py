"""Struct, array and JSON queries. Arrays come from single rows (text lines), never from whole groups."""

from pyspark.sql import functions as F

from ..operators import nested as op
from .registry import query


def order_structs(t):
    """Orders joined to customers, shaped as nested records."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey",
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_mktsegment").alias("code")).alias("segment")).alias("place"),
        ).alias("customer"),
        "o_totalprice",
    )


NESTED_FROM = "FROM orders JOIN customer ON o_custkey = c_custkey"


@query("jsn_flatten_fields", f"SELECT o_orderkey, o_totalprice, c_name AS customer_name, c_nationkey AS customer_nation {NESTED_FROM}")
def _(t):
    rows = order_structs(t).withColumn("customer", F.struct("customer.name", F.col("customer.place.nation").alias("nation")))
    return op.flatten_fields(rows, "customer", ["name", "nation"])


@query(
    "jsn_flatten_deep",
    f"SELECT o_orderkey, c_name AS customer_name, c_nationkey AS customer_place_nation, c_mktsegment AS customer_place_segment_code, o_totalprice {NESTED_FROM}",
)
def _(t):
    return op.flatten_deep(order_structs(t), max_depth=3)


@query(
    "jsn_flatten_stringify",
    """SELECT doc_id, lang AS meta_lang, n_chars AS meta_n_chars, '["' || lang || '","' || source || '"]' AS tags FROM documents""",
)
def _(t):
    rows = t.documents.select("doc_id", F.struct("lang", F.col("n_chars").alias("n-chars")).alias("meta"), F.array("lang", "source").alias("tags"))
    flat, _mapping = op.flatten_stringify(rows)
    return flat


def doc_lines(t):
    return t.documents.select("doc_id", F.split("text", "\n").alias("lines"))


LINES_SQL = """SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"""


@query("jsn_explode", f"SELECT doc_id, line_no, md5(line) AS line_md5, length(line) AS n FROM ({LINES_SQL})")
def _(t):
    rows = op.explode_array(doc_lines(t), "lines", index="line_no", item="line")
    return rows.select("doc_id", "line_no", F.md5("line").alias("line_md5"), F.length("line").cast("long").alias("n"))


@query(
    "jsn_explode_outer",
    f"""SELECT doc_id, line_no, line IS NOT NULL AS has_line FROM (
          SELECT doc_id, line_no, line FROM ({LINES_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')
          UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE lang <> 'en')""",
)
def _(t):
    empty = F.array().cast("array<string>")
    rows = t.documents.select("doc_id", F.when(F.col("lang") == "en", F.split("text", "\n")).otherwise(empty).alias("lines"))
    out = op.explode_array(rows, "lines", index="line_no", item="line")
    return out.select("doc_id", "line_no", F.col("line").isNotNull().alias("has_line"))


@query(
    "jsn_array_policy",
    """SELECT doc_id, 'first' AS policy, string_split(text, ' ')[1] AS word FROM documents
       UNION ALL SELECT doc_id, 'stringify', '["' || lang || '","' || source || '"]' FROM documents
       UNION ALL SELECT doc_id, 'explode', unnest([lang, source]) FROM documents""",
)
def _(t):
    words = t.documents.select("doc_id", F.split("text", " ").alias("word"))
    pairs = t.documents.select("doc_id", F.array("lang", "source").alias("word"))
    out = op.array_policy(words, "first").withColumn("policy", F.lit("first"))
    for p in ("stringify", "explode"):
        out = out.unionByName(op.array_policy(pairs, p).withColumn("policy", F.lit(p)))
    return out


EVENT = (
    "event_id BIGINT, session STRUCT<session_id: STRING>, customer STRUCT<customer_id: STRING>, "
    "items ARRAY<STRUCT<sku: STRING, quantity: BIGINT>>, device STRUCT<type: STRING>"
)


@query(
    "jsn_events_to_lines",
    f"""WITH l AS ({LINES_SQL})
        SELECT doc_id AS event_id, source AS session_id, CAST(line_no AS INTEGER) AS item_index, md5(line) AS sku, length(line) AS quantity, 'line' AS outcome
        FROM l JOIN documents USING (doc_id) WHERE lang NOT IN ('de', 'fr')
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, CASE WHEN lang = 'de' THEN 'malformed-json' ELSE 'missing-customer' END FROM documents WHERE lang IN ('de', 'fr')""",
)
def _(t):
    items = F.transform(F.split("text", "\n"), lambda x: F.struct(F.md5(x).alias("sku"), F.length(x).cast("long").alias("quantity")))
    payload = F.to_json(
        F.struct(
            F.col("doc_id").alias("event_id"),
            F.struct(F.col("source").alias("session_id")).alias("session"),
            F.when(F.col("lang") != "fr", F.struct(F.col("lang").alias("customer_id"))).alias("customer"),
            items.alias("items"),
            F.struct(F.lit("web").alias("type")).alias("device"),
        )
    )
    # A cut-off document is malformed.
    cut = F.when(F.col("lang") == "de", F.expr("left(payload, length(payload) - 1)")).otherwise(F.col("payload"))
    raw = t.documents.select("doc_id", "lang", payload.alias("payload")).withColumn("payload", cut)
    split = op.events_to_lines(
        raw, "payload", EVENT, "items", {"event_id": "event_id", "session_id": "session.session_id"}, ["sku", "quantity"],
        required=["session", "customer"], reason="outcome",
    )
    good = split.accepted.withColumn("outcome", F.lit("line"))
    bad = split.rejected.select(F.col("doc_id").alias("event_id"), "outcome")
    return good.unionByName(bad, allowMissingColumns=True)


@query("jsn_build_struct", "SELECT p_partkey, p_brand AS brand, p_type AS type, p_size, 'p_partkey,p_name,label,p_size,p_retailprice' AS layout FROM part")
def _(t):
    packed = op.build_struct(t.part, "label", ["p_brand", "p_type"])
    return packed.select(
        "p_partkey", F.col("label.p_brand").alias("brand"), F.col("label.p_type").alias("type"), "p_size", F.lit(",".join(packed.columns)).alias("layout")
    )


@query(
    "jsn_build_json",
    """SELECT o_orderkey, '{"key":' || o_custkey || ',"status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS customer,
              '{"level":"' || o_orderpriority || '"}' AS priority FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.expr("nullif(o_orderstatus, 'P')").alias("state"), "o_orderpriority")
    return op.build_json(rows, {"customer": {"status": "state", "key": "o_custkey"}, "priority": {"level": "o_orderpriority"}})


@query(
    "jsn_parse",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
              CASE WHEN event_type = 'error' THEN 'broken ' || props END AS raw_payload FROM events""",
)
def _(t):
    raw = t.events.select("event_id", F.expr("CASE WHEN event_type = 'error' THEN concat('broken ', props) ELSE props END").alias("body"))
    parsed = op.parse_json(raw, "body", "k INT")
    return parsed.select("event_id", F.col("payload.k").alias("k"), "raw_payload")
