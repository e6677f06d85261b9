"""Projections, filters, routing, masking and nested data on small frames."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.operators import columns as C
from millrace.operators import filters, masking, nested, routing, sets


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_standardize(rows, values):
    df = rows(
        "id string, name string, email string, phone string, state string",
        ("1", "  Mary Ng ", "MARY@SITE.ORG", "(415) 555-0101", "ca"), ("2", "Li", " li@site.org ", "+1 415 555 0102", " Wa"),
        ("3", "No Phone", "no.phone@site.org", "", "tx"), ("4", "Null Phone", "np@site.org", None, "tx"),
        ("8", "Bad", "nobody", "4155550103", "ny"), ("9", "Worse", "w@site.org", "abc12", "ny"),
    )
    good, bad = C.standardize(df, trim_columns=["name"], upper=["state"], emails=["email"], phones=["phone"])
    assert values(good, "id", "name", "email", "phone", "state")[:2] == [
        ("1", "Mary Ng", "mary@site.org", "4155550101", "CA"), ("2", "Li", "li@site.org", "14155550102", "WA"),
    ]
    assert [r[0] for r in values(good, "id")] == ["1", "2", "3", "4"]
    assert values(bad.select("id", F.concat_ws(",", "reject_reasons"))) == [("8", "invalid_email:email"), ("9", "invalid_phone:phone")]


def test_contract_values(rows, values):
    df = rows(
        "`Id` string, `Name` string, `Land` string, `Since` string, `Days` string, `On` string",
        ("a", " Acme ", "us", "06/30/2024", "30", "Y"), ("b", "Beta", " ca ", "2024-06-01", "45", "true"), ("c", "Co", "GB", "03-Jun-2024", "60", "N"),
        ("d", "Do", "us", "2024/06/04", "0", "FALSE"), ("x", "Ex", "us", "2024-06-05", "thirty", "Y"), ("y", "Why", "us", "soon", "30", "Y"), ("z", "Zed", "us", None, None, None),
    )
    good, bad = C.contract_values(
        df,
        [
            {"name": "id", "source": "Id"}, {"name": "name", "source": "Name"}, {"name": "land", "source": "Land", "upper": True},
            {"name": "since", "source": "Since", "type": "date"}, {"name": "days", "source": "Days", "type": "int"}, {"name": "on", "source": "On", "type": "boolean"},
        ],
    )
    got = [tuple(str(v) for v in r) for r in values(good)]
    assert got == [
        ("a", "Acme", "US", "2024-06-30", "30", "True"), ("b", "Beta", "CA", "2024-06-01", "45", "True"), ("c", "Co", "GB", "2024-06-03", "60", "False"),
        ("d", "Do", "US", "2024-06-04", "0", "False"), ("z", "Zed", "US", "None", "None", "None"),
    ]
    assert [r[0] for r in values(bad, "id")] == ["x", "y"]


def test_projection_settings(rows):
    df = rows("a int, b string", (1, "x"))
    assert C.add_column(df, "", "").columns == ["a", "b"]
    assert C.keep(df, ["b", "a"]).columns == ["b", "a"]
    assert C.derive(df, {"a": "a + 1"}, drop=["a"]).first()["a"] == 2
    with pytest.raises(ConfigError, match="NAME_COLLISION"):
        C.rename(df, {"a": "B"})
    with pytest.raises(ConfigError, match="COLUMN_EXISTS"):
        C.derive(df, {"a": "1"})
    with pytest.raises(ConfigError, match="UNKNOWN_COLUMN"):
        C.cast_columns(df, {"zz": "int"})


def test_surrogate_key_keeps_nulls_apart(rows):
    df = C.add_surrogate_key(rows("a string, b string", ("x", None), (None, "x"), ("x", "x")), "k", ["a", "b"])
    assert df.select("k").distinct().count() == 3


def test_lookup_policies(rows, values):
    df = rows("id int, v string", (1, "N"), (2, "S"), (3, None))
    lookup = rows("raw string, std string", ("N", "North"), ("N", "North"))
    assert values(C.lookup_standardize(df, "v", lookup, "raw", "std").accepted) == [(1, "North"), (2, "OTHER"), (3, "OTHER")]
    split = C.lookup_standardize(df, "v", lookup, "raw", "std", unmapped="reject")
    assert values(split.accepted) == [(1, "North")] and split.rejected.count() == 2
    logged = C.lookup_standardize(df, "v", lookup, "raw", "std", unmapped="log").accepted
    assert values(logged) == [(1, "North", False), (2, "S", True), (3, None, True)]


def test_filters(rows, values):
    df = rows("id int, s string, n int", (1, "A", 5), (2, "B", 50), (3, None, 7))
    spec = lambda c, o, v=None, logic="AND": {"column": c, "operator": o, "value": v, "logic": logic}
    assert values(filters.filter_conditions(df, [spec("s", "is_null"), spec("n", "gt", 9, "OR"), spec("s", "eq", "B")]), "id") == [(2,), (3,)]
    assert values(filters.filter_conditions(df, [spec("s", "in", "A,B"), spec("n", "lt", 9)]), "id") == [(1,)]
    assert filters.filter_conditions(df, []).count() == 3
    with pytest.raises(ConfigError, match="INVALID_FILTER_OPERATOR"):
        filters.filter_conditions(df, [spec("s", "unsupported", "A")])
    with pytest.raises(ConfigError, match="MISSING_PREDICATE"):
        filters.filter_sql(df, " ")
    clauses = [{"column": "s", "op": "NOT_IN", "values": ["A"], "allow_null": True}, {"column": "n", "op": "BETWIXT", "value": 1}]
    assert filters.filter_clauses(df, clauses).count() == 0
    assert values(filters.filter_clauses(df, clauses, "OR"), "id") == [(2,), (3,)]


def test_routes_are_a_partition(rows):
    df = rows("id int, score int, flag boolean", (1, 810, False), (2, 690, None), (3, None, True), (4, 500, False))
    out = routing.split_routes(df, {"prime": "score >= 780", "low": "score < 600", "flagged": "flag"})
    assert {k: v.count() for k, v in out.items()} == {"prime": 1, "low": 1, "flagged": 1, "default": 1}
    assert out["default"].first()["id"] == 2  # null conditions do not match
    labels = routing.label_routes(df, [("prime", "score >= 780"), ("review", "flag OR score < 600"), ("rest", "default")])
    assert [r["route"] for r in labels.orderBy("id").collect()] == ["prime", "rest", "review", "review"]
    with pytest.raises(ConfigError, match="ROUTE_CONFIG_INVALID"):
        routing.label_routes(df, [("a", "default"), ("b", "default")])


def test_masks(rows, values):
    df = rows("id int, v string", (1, "078-05-1120"), (2, "none"), (3, None), (4, "ab"))
    assert values(masking.last4(df, ["v"])) == [(1, "XXX-XX-1120"), (2, "none"), (3, None), (4, "ab")]
    assert values(masking.format_preserving(df, ["v"])) == [(1, "0*********0"), (2, "n**e"), (3, None), (4, "**")]
    assert values(masking.redact(df, ["v"], "#")) == [(1, "#"), (2, "#"), (3, None), (4, "#")]
    assert values(masking.hash_columns(df, ["v"]))[1] == (2, sha("none"))
    secret = masking.encrypt(df, ["v"], "k" * 16)
    assert secret.filter("v = 'none'").count() == 0
    assert values(masking.decrypt(secret, ["v"], "k" * 16)) == values(df)


def test_tokens(rows, values):
    df = rows(
        "id string, ssn string, email string, phone string",
        ("1", "078-05-1120", "Me@Site.org", "415-555-0101"), ("2", "MASKED_SSN_OLD", "MASKED_EMAIL_OLD", "MASKED_PHONE_OLD"), ("3", "", None, ""), ("9", "078-05-1121", "nobody", "555"),
    )
    split = masking.token_prefix(df, {"ssn": "ssn", "email": "email", "phone": "phone"})
    assert values(split.accepted) == [
        ("1", f"MASKED_SSN_{sha('078-05-1120')[:12]}", f"MASKED_EMAIL_{sha('me@site.org')[:12]}", f"MASKED_PHONE_{sha('4155550101')[:12]}"),
        ("2", "MASKED_SSN_OLD", "MASKED_EMAIL_OLD", "MASKED_PHONE_OLD"), ("3", None, None, None),
    ]
    assert values(split.rejected, "id") == [("9",)]
    assert all(r["leak_count"] == 0 for r in masking.leak_scan(split.accepted, ["078-05-1120", "Me@Site.org"]).collect())
    assert sum(r["leak_count"] for r in masking.leak_scan(df, ["078-05-1120"]).collect()) == 1


@pytest.mark.parametrize(
    "name,label",
    [("borrower_ssn", "PII"), ("email", "PII"), ("home_address_1", "PII"), ("credit_score", "CONFIDENTIAL"), ("salary", "CONFIDENTIAL"), ("tinted", None), ("order_id", None), ("DOB", "PII")],
)
def test_classify_name(name, label):
    assert masking.classify_name(name) == label


def test_classify_schema(rows):
    df = masking.classify_schema(rows("email string, balance double, note string", ("a", 1.0, "b")))
    assert df.schema["email"].metadata["classification"] == "PII" and df.schema["balance"].metadata["classification"] == "CONFIDENTIAL"
    assert masking.dataset_class(df) == "PII" and masking.dataset_class(df.drop("email")) == "CONFIDENTIAL" and masking.dataset_class(df.select("note")) == "INTERNAL"


def test_events_to_lines(spark, values):
    ok = '{"id":"e1","session":{"sid":"s1"},"customer":{"cid":"c1"},"items":[{"sku":"a","q":2},{"sku":"b","q":1}]}'
    texts = [ok, ok.replace("e1", "e2").replace('[{"sku":"a","q":2},{"sku":"b","q":1}]', "[]"), '{"id":"e3","session":{"sid":"s3"},"items":[{"sku":"z","q":1}]}', ok.replace("e1", "e4")[:-1]]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    schema = "id STRING, session STRUCT<sid: STRING>, customer STRUCT<cid: STRING>, items ARRAY<STRUCT<sku: STRING, q: INT>>"
    split = nested.events_to_lines(df, "body", schema, "items", {"id": "id", "sid": "session.sid"}, ["sku", "q"], required=["session", "customer"])
    assert values(split.accepted) == [("e1", "s1", 0, "a", 2), ("e1", "s1", 1, "b", 1)]
    assert [r[0] for r in values(split.rejected, "reject_reason")] == ["malformed-json", "missing-customer"]


def test_build_json_and_struct(rows):
    df = rows("id string, pid string, pname string, dob date, fee double", ("v1", "p1", "Ann", None, 2.5))
    got = nested.build_json(df, {"patient": {"pname": "pname", "pid": "pid", "dob": "dob"}}).first()
    assert got["patient"] == '{"dob":null,"pid":"p1","pname":"Ann"}' and got["fee"] == 2.5
    packed = nested.build_struct(df, "patient", ["pname", "dob"])
    assert packed.columns == ["id", "pid", "patient", "fee"]
    assert nested.build_struct(df, "patient", ["pid", "dob"], drop_sources=False).columns == ["id", "patient", "pid", "pname", "dob", "fee"]


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 2, 'b', named_struct('c', 3, 'd', named_struct('e', 4))) AS s, array(1, 2) AS xs, map('k', 1) AS m, 9 AS `s a`")
    assert nested.flatten_deep(df.drop("s a"), max_depth=2).columns == ["id", "s_a", "s_b_c", "s_b_d", "xs", "m"]
    assert nested.flatten_deep(df.drop("s a"), keep_original=True, prefix="f_").columns == ["id", "f_s_a", "f_s_b_c", "f_s_b_d_e", "s", "xs", "m"]
    flat, mapping = nested.flatten_stringify(df)
    assert flat.columns == ["id", "s_a", "s_b_c", "s_b_d_e", "xs", "m", "s_a_2"]
    assert flat.first()["xs"] == "[1,2]" and flat.first()["m"] == '{"k":1}' and mapping["s_a_2"] == "s a"
    with pytest.raises(ConfigError, match="NAME_COLLISION"):
        nested.flatten_fields(spark.sql("SELECT 1 AS a, named_struct('a', 2) AS s"), "s", prefix="")


def test_sql_chain_checks(rows):
    df = rows("a int", (1,), (2,))
    assert sets.sql_chain(df, []).count() == 2
    with pytest.raises(ConfigError, match="UNNAMED_OUTPUT"):
        sets.sql_chain(df, [("x", "SELECT sum(a) FROM input")])
    with pytest.raises(ConfigError, match="DUPLICATE_OUTPUT"):
        sets.sql_chain(df, [("x", "SELECT a, a + 1 AS A FROM input")])


def test_sample_is_repeatable(spark, values):
    df = spark.range(10_000).withColumn("k", F.col("id"))
    one = sets.sample(df.repartition(3), 0.2, key="k")
    assert values(one) == values(sets.sample(df.repartition(11), 20, key="k"))
    assert 1800 < one.count() < 2200


def test_format_preserving_encryption(spark, rows, values):
    key = "k" * 16
    texts = ["", "7", "a", "123-45-6789", "Ann O'Neil", "x9\u00e9\U0001f600Z!", "--", "1234567890" * 12, "AB cd 12", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    hidden = masking.encrypt(df, ["v"], key, preserve_format=True)
    shown = {r.i: r.v for r in hidden.collect()}
    for i, text in enumerate(texts):
        kinds = lambda s: s and "".join("0" if c in "0123456789" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in s)
        assert kinds(shown[i]) == kinds(text)
    assert shown[3] != texts[3] and shown[7] != texts[7] and shown[6] == "--"
    assert values(masking.decrypt(hidden, ["v"], key, preserve_format=True), "i", "v") == values(df, "i", "v")
    assert masking.encrypt(df, ["v"], "j" * 16, preserve_format=True).filter("i = 3").first().v != shown[3]
    # All codes of one shape change places: no two share an image.
    codes = spark.range(2600).selectExpr("concat(format_string('%02d', id % 100), '-', char(97 + int(id / 100))) as v")
    images = masking.encrypt(codes, ["v"], key, preserve_format=True)
    assert values(images.distinct()) == values(codes)


def test_format_preserving_encryption_makes_its_key_stream_once_a_round(spark):
    # Texts hidden by earlier versions stay readable, and a round's stream stands outside the loop over characters.
    df = spark.createDataFrame([("Customer#000000001",), ("x" * 40 + "7" * 33,), ("AbC-123/xyz",)], "v string")
    hidden = masking.encrypt(df, ["v"], "0123456789abcdef", preserve_format=True)
    assert [r.v for r in hidden.collect()] == ["Hpycpcwb#874405398", "qwvkljxabyvhfsktcxxejcxypgzvswzmxhdaumvr125793627765308408740529865569691", "JnQ-706/xpe"]
    plan = hidden._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(substring(" in plan and "conv(substring(array_join(" not in plan
