import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidencia.functions import benchmark as B
from evidencia.functions import domains as D
from evidencia.functions import matching as M
from evidencia.functions import text as T
from evidencia.functions.edits import distance


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.sentence_count, "One. Two! Three?\n\nFour e.g.x", 4),
        (T.sentence_count, "", 0),
        (T.sentence_count, None, None),
        (T.search_name, "Zorvan Support Services Pvt. Ltd.", "Zorvan Support Services"),
        (T.search_name, "Limited", "Limited"),
        (T.normalised, "  A.B@x.example,  Foo-Bar! ", "a.b@x.example foo-bar"),
        (T.emails, "A@b.example a@B.example c@d.example", ["a@b.example", "c@d.example"]),
        (T.mobiles, "ring 98765-43210 or +91 98765 43210", ["+91 98765 43210"]),
        (T.mask_emails, "to hr.x@firm.example, hr%40firm.example", "to ***@firm.example, ***%40firm.example"),
        (T.drop_keys, "a" * 64 + " api_key=abc&x", " api_key=&x"),
        (T.redact_long, "x" * 201, "[201 characters]"),
        (T.redact_long, "x" * 200, "x" * 200),
        (T.warns_of_fraud, "a Fraudulent offer", True),
        (T.warns_of_fraud, "defraud", False),
        (D.host_of, "https://www.Careers.Brand.co.in/x?y", "careers.brand.co.in"),
        (D.host_of, "hr@brand.com", "brand.com"),
        (D.host_of, "10.0.0.1", None),
        (D.host_of, "localhost", None),
        (lambda c: D.registrable_domain(D.host_of(c)), "x.careers.brand.co.in", "brand.co.in"),
        (lambda c: D.registrable_domain(D.host_of(c)), "co.in", None),
        (lambda c: D.registrable_domain(D.host_of(c)), "shop.github.io", "shop.github.io"),
        (lambda c: D.official_class(D.host_of(c), F.lit("brand.com")), "hr@mail.brand.com", "subdomain"),
        (lambda c: D.official_class(D.host_of(c), F.lit("brand.com")), "hr@gmail.com", "free_mail"),
        (D.to_ascii, "bücher.example", "xn--bcher-kva.example"),
        (lambda c: M.names_match(c, F.lit("Contoso India Pvt Ltd")), "Contoso", True),
        (lambda c: M.names_match(c, F.lit("Contoso Pizza")), "Contoso", False),
        (lambda c: M.names_match(c, F.lit("Zorvan Support Services")), "Support Services", False),
        (lambda c: M.names_match(c, F.lit("Contoso Kharadi"), F.lit("Kharadi, Pune")), "Contoso", True),
        (lambda c: M.mentions(F.lit("jobs at Contoso Data today"), c), "Contoso Data Ltd", True),
        (lambda c: M.role_matches(F.lit("Customer Support Associate"), c), "Customer Support Executive (WFH)", True),
        (lambda c: M.role_matches(F.lit("Sales Executive"), c), "Data Entry Executive", False),
        (lambda c: M.in_place(c, F.lit("Navi Mumba")), "near Navi Mumba, X", True),
        (lambda c: M.carries_phone(c, F.lit("+91 98765 43210")), "call 98765-43210 now", True),
        (lambda c: M.carries_contact(c, F.lit("hr@x.example")), "write to HR@x.example.", True),
        (lambda c: M.carries_contact(c, F.lit("hr@x.example")), "write to hr@x.example.org", False),
        (T.tokens, "Ａcmé & Cø. 12", ["acme", "and", "c", "12"]),
        (T.normalised, "Straße ÉCOLE", "strasse école"),
        (T.redacted, "mail a.b@c.example", "mail ***@c.example"),
        (lambda c: D.official_class(D.host_of(c), F.lit("zorvan.com")), "hr@zorvam.com", "lookalike"),
        (lambda c: D.official_class(D.host_of(c), F.lit("zorvan.com")), "hr@other.com", "unrelated"),
        (D.is_profile, "https://m.facebook.com/someone", True),
        (D.is_profile, "https://in.linkedin.com/company/x", False),
        (lambda c: M.in_city(c, F.lit("Bengaluru")), "Whitefield, Bangalore", True),
        (lambda c: M.in_city(c, F.lit("bombay")), "Andheri, Mumbai", True),
        (lambda c: M.near(c, F.lit("Pune")), "Chakan, Maharashtra", True),
        (lambda c: M.near(c, F.lit("Pune")), "Nagpur", False),
        (lambda c: M.near(c, F.lit("Pune")), "Anywhere", False),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


def test_official_domain(spark):
    rows = [([("https://zorvan.example/", "Zorvan Support jobs"), ("https://www.zorvan-support.example/x", "Home")],), ([("https://zorvan.example/", "Zorvan Support Ltd jobs"), ("https://other.example", "x")],), ([("https://zorvan.example/", "Zorvan Hospitals")],), ([],), (None,)]
    df = spark.createDataFrame(rows, "r array<struct<link:string,title:string>>")
    assert [r[0] for r in df.select(M.official_domain(F.col("r"), F.lit("Zorvan Support Pvt Ltd"))).collect()] == ["zorvan-support.example", "zorvan.example", None, None, None]


def test_distance():
    assert [distance(*p) for p in [("ca", "abc"), ("", "ab"), ("abcd", "acbd"), ("brand", "brand"), ("kitten", "sitting")]] == [2, 2, 1, 0, 3]


@pytest.mark.parametrize("label, brand, want", [("brаnd", "brand", "letters"), ("brand-careers", "brand", "contains"), ("tcsion", "tcs", None), ("tcs-careers", "tcs", "contains"), ("brnd", "brand", "edits"), ("other", "brand", None)])
def test_lookalike(label, brand, want):
    assert D.lookalike(label, brand) == want


def test_lookalikes_join_finds_what_all_pairs_find(spark):
    labels, brands = ["brandjobs", "brnad", "zorvanta", "zorvnata", "tcs-hr", "plain", None], ["brand", "zorvanta", "tcs", None]
    a = spark.createDataFrame([(x,) for x in labels], "label string")
    b = spark.createDataFrame([(x,) for x in brands], "brand string")
    got = {(r.label, r.brand, r.reason) for r in D.lookalikes(a, b).collect()}
    want = {(x, y, D.lookalike(x, y)) for x in labels if x for y in brands if y and x != y and D.lookalike(x, y)}
    assert got == want


def test_benchmark(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0), ("a", None), ("b", None)], "k string, pay double")
    got = {r.k: r for r in B.benchmark(df, ["k"], "pay").collect()}
    assert got["a"] == Row(k="a", listings=5, found=4, median_pay=3.0)
    assert got["b"].median_pay is None
    at = spark.range(1).select(B.is_outlier(F.lit(6.0), F.lit(3), F.lit(3.0)).alias("x"), B.is_outlier(F.lit(6.03), F.lit(3), F.lit(3.0)).alias("y"), B.is_outlier(F.lit(9.0), F.lit(2), F.lit(3.0)).alias("z")).first()
    assert (at.x, at.y, at.z) == (False, True, False)


def test_well_formed(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(T.well_formed(F.col("x"))).collect()] == [1.5, None, None, None]


def test_functions_in_sql(spark):
    from evidencia.functions.register import register

    assert len(register(spark)) == 6
    got = spark.sql("select ev_edit_distance('ca', 'abc') d, ev_edit_distance(null, 'a') n, ev_mask_phones('call 98765 43210') m, ev_lookalike('tcs-hr', 'tcs') l").first()
    assert tuple(got) == (2, None, "call 9XXXX XXXXX", "contains")


@pytest.mark.parametrize(
    "value, want",
    [
        ({"text": "x"}, None),
        ({}, "arguments lacks text"),
        ({"text": ""}, "text is too short"),
        ({"text": "x", "n": True}, "n must be of type integer"),
        ({"text": "x", "n": 0}, "n is too small"),
        ({"text": "x", "other": 1}, "arguments has no member other"),
        ({"text": "x", "mode": "c"}, "mode must be one of a, b"),
        ("x", "arguments must be of type object"),
    ],
)
def test_refusals(value, want):
    from evidencia.functions.register import refusal

    schema = {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 20}, "n": {"type": "integer", "minimum": 1}, "mode": {"enum": ["a", "b"]}}}
    assert refusal(value, schema) == want


def test_calls_are_checked(spark):
    from evidencia.functions.register import checked

    schemas = {"open": {"required": ["text"], "properties": {"text": {"type": "string"}}}}
    rows = [("open", '{"text": "x"}'), ("open", "{}"), ("open", "["), ("open", "[]"), ("shut", "{}"), (None, None)]
    got = [r.refusal for r in checked(spark.createDataFrame(rows, "tool string, arguments string"), schemas).collect()]
    assert got == [None, "arguments lacks text", "arguments are no JSON", "arguments must be of type object", "there is no tool shut", "there is no tool None"]


def test_settled_log(spark):
    from evidencia.streaming.logs import settled

    calls = spark.createDataFrame([(1, "a"), (2, "b")], "id int, tool string")
    results = spark.createDataFrame([(1, 1, "first"), (1, 2, "last"), (9, 1, "none")], "id int, at int, result string")
    assert sorted((r.id, r.tool, r.result) for r in settled(calls, results, "id", "at", ["result"]).collect()) == [(1, "a", "last"), (2, "b", None)]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from evidencia.runtime import shared_dir

    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("spark://x:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert shared_dir(session("local[4]"))
    for master in ("spark://x:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
