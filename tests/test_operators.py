import json
import random

import pytest
from pyspark.sql import functions as F

from evidencia.operators import claims, lexer, lookups, money, nested, scrub, units
from evidencia.operators.components import components
from evidencia.sources import requests as R
from evidencia.streaming import logs


# ---- nested records

BODIES = [
    (1, json.dumps({"params": {"q": "a"}, "response": {"local_results": [None, {"title": "x"}, {"title": None}], "jobs_results": [{"title": "t", "extensions": ["e0", None, "e2"]}]}})),
    (2, json.dumps({"params": json.dumps({"q": "b"}), "response": json.dumps({"jobs_results": {"extensions": "only"}, "local_results": {"title": "one"}})})),
    (3, '{"params": {"q": "broken"'),
    (4, None),
    (5, ""),
    (6, json.dumps({"params": {"q": None}, "response": {"jobs_results": []}, "node": {"name": "r", "node": {"name": "s"}}})),
    (None, "[1, 2]"),
]


def test_nested_tables(spark):
    df = spark.createDataFrame(BODIES, "rec_id int, body string").withColumn("key", F.lit("clash")).withColumn("tab", F.lit(0))
    rows = nested.shred(df.unionByName(df), "rec_id", "body").cache()  # repeated records count once
    found = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    assert found(nested.flat(rows, "rec_id", nested.ROOT, ["params.q"]).filter("params_q is not null"), "rec_id", "params_q") == [(1, "a"), (2, "b")]
    ext = nested.children(rows, "rec_id", "extensions", "jobs_results", "response.jobs_results").filter("value is not null")
    assert found(ext, "rec_id", "parent_pos", "pos", "value") == [(1, 0, 0, "e0"), (1, 0, 2, "e2"), (2, 0, 0, "only")]
    place = nested.flat(rows, "rec_id", "local_results", ["title"]).filter("title is not null")
    assert found(place, "rec_id", "pos", "title") == [(1, 1, "x"), (2, 0, "one")]
    # a member that contains itself has a table of its own, and each row has its parent
    own = nested.flat(rows, "rec_id", "node", ["name"])
    assert found(own, "name") == [("r",), ("s",)]
    orphans = rows.alias("c").join(rows.alias("p"), (F.col("c.rec_id") == F.col("p.rec_id")) & (F.col("c.parent_row") == F.col("p.row_no")), "left_anti").filter("parent_row is not null")
    assert orphans.count() == 0


def test_nested_empty_table(spark):
    assert nested.shred(spark.createDataFrame([], "rec_id int, body string"), "rec_id", "body").count() == 0


def test_nested_bodies_of_any_depth(spark):
    lists = "[" * 100_000 + "]" * 100_000
    node = '{"node": ' * 10_000 + '{"name": "leaf", "many": ' + "[" * 3000 + "]" * 3000 + "}" + "}" * 10_000
    wrapped = '{"a": 1}'
    for _ in range(6):
        wrapped = json.dumps(wrapped)
    df = spark.createDataFrame([(1, lists), (2, '{"a": 1}'), (3, node), (4, node[:-1]), (5, wrapped)], "k int, body string")
    got = {r.k: r for r in nested.shred(df, "k", "body").groupBy("k").agg(F.count("*").alias("n"), F.max("cols.name").alias("leaf"), F.max("cols.a").alias("a")).collect()}
    assert got[2].n == got[5].n == 1 and got[5].a == "1" and got[3].n == 10_002 and got[3].leaf == "leaf" and 4 not in got and 1 not in got


def test_deep_parser_is_the_usual_one():
    rng = random.Random(4)

    def some(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [None, True, rng.randrange(-9, 10**12), rng.random() * 10**rng.randrange(-20, 20), "a\"\\\n{[é" * rng.randrange(3)][kind]
        return [some(depth - 1) for _ in range(rng.randrange(4))] if kind < 7 else {f"k{n}": some(depth - 1) for n in range(rng.randrange(4))}

    for _ in range(400):
        v = some(4)
        assert nested.deep_loads(json.dumps(v, indent=rng.choice([None, 1]))) == v
    for bad in ("", "{", "[1,]", '{"a" 1}', "[1 2]", "{1: 2}", '{"a": }', "[}", "1 2", "tru", "[1]]", '{"a": 1,}', ":", ",", '"open', "NaN"):
        with pytest.raises(ValueError):
            nested.deep_loads(bad)


def test_nested_tables_are_typed(spark):
    bodies = [(1, json.dumps({"p": {"q": 1, "ok": True}, "xs": [{"r": 1}, {"r": 2.5}], "m": 1})), (2, json.dumps({"p": {"q": 2}, "xs": {"r": 3}, "m": "x"}))]
    df = spark.createDataFrame(bodies, "k int, body string")
    schema = nested.analyse(df, "body")
    made = nested.tables(nested.shred(df, "k", "body", schema), "k", schema)
    assert set(made) == {"", "xs"}
    assert dict(made[""].dtypes) | {"p_q": "bigint", "p_ok": "boolean", "m": "string"} == dict(made[""].dtypes)
    assert sorted((r.k, r.pos, r.r) for r in made["xs"].collect()) == [(1, 0, 1.0), (1, 1, 2.5), (2, 0, 3.0)]


def test_names_that_are_data_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(nested, "EDGES", 5)
    with pytest.raises(ValueError):
        nested.analyse(spark.createDataFrame([(json.dumps({f"id{k}": k for k in range(9)}),)], "body string"), "body")


# ---- pay


@pytest.mark.parametrize(
    "text, want",
    [
        ("₹25,000 - 35,000 per month", (25000, 35000)),
        ("12k-15k pm", (12000, 15000)),
        ("4.5 LPA", (37500, 37500)),
        ("3-5 LPA", (25000, 41667)),
        ("Rs. 700 per day", (21000, 21000)),
        ("INR 6,960 weekly", (30160, 30160)),
        ("upto Rs thirty thousand per mensem", (30000, 30000)),
        ("₹३२,००० प्रति माह", (32000, 32000)),
        ("Rs 6.86L to 8.43L saal ka", (57167, 70250)),
        ("₹0.34 lac – 0.36 lakh per month", (34000, 36000)),
        ("Rs.51 - 57 thousand/mo", (51000, 57000)),
        ("twenty eight thousand rupees/month", (28000, 28000)),
        ("21 days ago", None),
        ("Full-time", None),
        ("", None),
        (None, None),
    ],
)
def test_pay_fields(text, want):
    one = units.whole(text)
    assert (units.solve([one])[:2] if one else None) == want


@pytest.mark.parametrize(
    "salary, extensions, description, want",
    [
        ("4.84 - 6.11", [], "Salary figures are lakhs of rupees per annum.", (40333, 50917)),
        ("50-55.5", None, "Salary shown in thousands (INR), paid every month.", (50000, 55500)),
        ("Rs.31,500", None, "Wages are monthly.", (31500, 31500)),
        (None, ["3 days ago", None, "₹7.88 Lacs - ₹9.65 Lacs annually"], None, (65667, 80417)),
        (None, None, "A joining bonus of ₹23,356 is paid after 11 months.\nThe role offers Rs. 33,000.00 – 39,000.00/mo as fixed pay.", (33000, 39000)),
        (None, None, "Incentive up to Rs 20,320 a month for the top 10.", None),
        (None, None, None, None),
    ],
)
def test_pay_of_listings(salary, extensions, description, want):
    got = units.solve(units.listing(salary, extensions, description))
    assert (got[:2] if got else None) == want


def test_pay_of_messages():
    assert units.solve(units.offer("44.5", "x\nSalary: 44.5 (in thousand rupees, every month)"))[:2] == (44500, 44500)
    assert units.solve(units.offer("₹ 6.16 lac", "Salary: ₹ 6.16 lac, paid as a yearly figure"))[:2] == (51333, 51333)
    assert units.offer(None, "pay ₹500 as fee") == []


def test_units_by_identity():
    stated = [units.Stated(30, 30, None, None), units.Stated(360000, 360000, "", "year")]
    assert units.solve(stated) == (30000, 30000, True)
    low, high, unique = units.solve([units.Stated(100_000, 100_000, "", None)])
    assert not unique and low == high


def test_every_statement_counts_and_so_do_high_ends():
    open_ = units.Stated(30, 30, None, None)
    assert units.solve([open_, units.Stated(30, 30, "k", None), units.Stated(30_000, 30_000, "", None), units.Stated(3.6, 3.6, "l", "year")]) == (30000, 30000, True)
    # low ends agree by the day and by the month alike; the high end tells which
    a, b = units.Stated(1000, 2000, "", None), units.Stated(30_000, 60_000, "", "month")
    assert units.solve([a, b]) == (30000, 60000, True)
    many = [units.Stated(30 + k / 1e4, 30, None, None) for k in range(12)] + [units.Stated(30_000, 30_000, "", "month")]
    assert units.solve(many)[:2] == (30000, 30000)  # grows with the statements, not with the product of their units
    # the level of the other records decides what one statement alone leaves open
    assert units.solve([units.Stated(900, 900, "", None)], level=units.math.log(27_000), spread=0.3) == (27000, 27000, True)
    assert units.solve([units.Stated(900, 900, "", None)], level=units.math.log(900), spread=0.3) == (900, 900, True)



# ---- claims


def test_claims_have_their_spans(spark):
    text = "Dear A, pay Rs. 500 at hr@zorvan.example.\nCall 98765 43210 or see www.zorvan.example/x. Earn 12k-15k!"
    df = spark.createDataFrame([("m", text), ("e", ""), ("n", None)], "offer_id string, source_text string")
    got = claims.extract(df, "offer_id", "source_text").collect()
    assert {r.offer_id for r in got} == {"m"}
    spans = {(r.kind, text[r.begin : r.end]) for r in got if r.kind in ("money", "email", "phone", "link")}
    assert spans == {("money", "Rs. 500"), ("email", "hr@zorvan.example"), ("phone", "98765 43210"), ("link", "www.zorvan.example/x"), ("money", "12k-15k")}
    assert [text[r.begin : r.end] for r in got if r.kind == "sentence"] == ["Dear A, pay Rs. 500 at hr@zorvan.example.", "Call 98765 43210 or see www.zorvan.example/x.", "Earn 12k-15k!"]


def test_clauses():
    text = "share bank details; bring originals, but not now"
    assert [text[a:b].strip() for a, b in claims.clauses(text, 0, len(text))] == ["share bank details", "bring originals", "not now"]


def test_places_in_a_text():
    text = "We hire at Mr. A & Co. now! Really?! Yes, e.g. this one.\n\nPay nothing; but ask, and wait"
    assert [text[a:b] for a, b in lexer.sentences(text)] == ["We hire at Mr. A & Co. now!", "Really?!", "Yes, e.g. this one.", "Pay nothing; but ask, and wait"]
    at = text.index("ask")
    assert text[slice(*lexer.sentence_at(text, at))] == "Pay nothing; but ask, and wait" and text[slice(*lexer.clause_at(text, at))].strip() == "ask"
    assert lexer.line_before(text, at, 8) == "hing; but "[-8:] and lexer.clause_before(text, at + 2, 40).strip() == "as"
    assert lexer.first_sentence(text, lambda s: "?" in s) == (28, 36) and lexer.first_sentence("", bool) is None
    assert lexer.sentences("\n \n") == [] and lexer.sentence_at("", 0) is None


@pytest.mark.parametrize(
    "text, raw, month",
    [
        ("Salary: ₹41,000/month", "₹41,000/month", 41000), ("Stipend Rs. 9000/-", "Rs. 9000/-", 9000), ("CTC: 5.4 LPA", "5.4 LPA", 45000), ("CTC Rs 4,80,000", "Rs 4,80,000", 40000),
        ("Salary 18,000 se 22,000 tak har mahine", "18,000 se 22,000 tak har mahine", 18000), ("Roz ₹1500 tak", "Roz ₹1500", 45000), ("Wages ₹4,000 per week", "₹4,000 per week", 17333),
        ("Monthly salary: ₹21,000", "Monthly salary: ₹21,000", 21000), ("Salary 20-24k per month", "20-24k per month", 20000), ("Pay ₹500 to hold it. Salary ₹16,000 per month.", "₹16,000 per month", 16000),
        ("salary ₹19,000\nDaily 5 hours", "₹19,000", 19000), ("Hiring Night In-charge: ₹23,000 in hand.", "₹23,000", 23000),
        ("Get ₹40 per like", None, None), ("Bonus up to ₹9,000", None, None), ("Pay ₹1,999 to confirm", None, None), ("Call 9876543210 daily", None, None), ("Salary ₹30", None, None), ("", None, None),
    ],
)
def test_pay_a_message_offers(text, raw, month):
    got = money.offered(text)
    assert (got and (text[got[0] : got[1]], got[2])) == (raw and (raw, month))


@pytest.mark.parametrize(
    "text, month",
    [
        ("₹16K–₹20K a month", 18000), ("₹3L–₹4.2L a year", 30000), ("3-6 LPA", 37500), ("20 se 24 hazar mahina", 22000), ("salana 3.6 lakh", 30000), ("₹2,40,000 - ₹3,60,000", 25000),
        ("₹700 a day", None), ("₹90 an hour", None), ("Joining bonus ₹6,000", None), ("Shift 2 PM - 11 PM", None), ("₹20,000 - 4 openings", None), (None, None),
    ],
)
def test_pay_a_listing_states(text, month):
    assert (money.listed(text) or (None, None))[1] == month


def test_sources_of_a_listings_pay():
    assert money.listing_pay("₹20K–₹24K a month", ["₹40K a month"], "Salary ₹9,000 - ₹9,500 per month") == ("salary", "₹20K–₹24K a month", 22000)
    assert money.listing_pay(None, ["2 days ago", "₹40K a month"], None)[::2] == ("extensions", 40000)
    assert money.listing_pay("₹600 a day", None, "Incentives ₹2,000-₹4,000. Salary ₹15K-₹17K a month.") == ("description", "₹15K-₹17K a month", 16000)
    assert money.listing_pay(None, None, "Salary ₹24,000 per month") is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("Pay a refundable registration fee of ₹1,499 today.", ("refundable registration fee of ₹1,499", 1499)), ("Training fee Rs 1200, refundable.", ("Training fee Rs 1200", 1200)),
        ("Pay ₹899 for registration now.", ("₹899 for registration", 899)), ("Registration fee: 1499.", ("Registration fee: 1499", 1499)), ("Kindly pay Rs 700 for the card.", ("pay Rs 700", 700)),
        ("Deposit ₹800 first.", ("Deposit ₹800", 800)), ("A security deposit applies.", ("security deposit", None)), ("Processing charge 3 days later.", ("Processing charge", None)),
        ("Joining fee applies, salary ₹20,000.", ("Joining fee", None)), ("No interview, direct joining registration fee ₹900", ("registration fee ₹900", 900)),
        ("There is no registration fee.", None), ("We never charge a joining fee.", None), ("Registration fee nahi lagegi.", None), ("Do not pay ₹300 to anyone.", None), ("Training is free of charge.", None),
        ("Kit charges of ₹900 will be paid by the company.", None), ("", None),
    ],
)
def test_fees(text, want):
    got = claims.fee(text)
    assert (got and got[:2]) == want and (got is None or text[got[2] : got[3]] == got[0])


@pytest.mark.parametrize("written", ["+91 9XXXX XXXXX", "+919XXXXXXXXX", "(+91) 9XXXX XXXXX", "91 9XXXX XXXXX", "09XXXXXXXXX", "9XXXX-XXXXX", "+91 9**** *****"])
def test_mobiles(written):
    text = f"Call us on {written} now."
    ((kind, value, a, b, masked),) = claims.contacts(text)
    assert (kind, value, text[a:b], masked) == ("phone", "+91 9XXXX XXXXX", written, True)


@pytest.mark.parametrize(
    "text, want",
    [
        ("see https://jobs.firm.example/a/1.", [("link", "https://jobs.firm.example/a/1")]), ("form: firm.example/f!", [("link", "firm.example/f")]), ("mail hr@firm.example.Thanks", [("email", "hr@firm.example")]),
        ("mail a@f.example, A@F.example and b**@f.example", [("email", "a@f.example"), ("email", "b**@f.example")]), ("B.Tech, ASP.NET, Pvt.Ltd, Rs.42,000", []), ("A/c 9XXXXXXXXXXX Ref 5XXXX XXXXX", []),
        ("98765 43210 98765 43211", [("phone", "+91 98765 43210"), ("phone", "+91 98765 43211")]), ("", []),
    ],
)
def test_contacts(text, want):
    assert [c[:2] for c in claims.contacts(text)] == want


@pytest.mark.parametrize(
    "f, text, want",
    [
        (claims.company, "*Company:* Tarvex Retail Services\nPost: X", "Tarvex Retail Services"), (claims.company, "Greetings from Tarvex! You", "Tarvex"), (claims.company, "Tarvex Softlabs has shortlisted you", "Tarvex Softlabs"),
        (claims.company, "shortlisted for an interview at Tarvex, Pune", "Tarvex"), (claims.company, "The desk of Olvan Marketing Pvt Ltd.", "Olvan Marketing Pvt Ltd"), (claims.company, "Regards,\nTarvex HR Team", "Tarvex"),
        (claims.company, "Greetings from HR Team!", None), (claims.company, "Job opening in Pune", None), (claims.company, "", None),
        (claims.role, "Post: Store Assistant\nx", "Store Assistant"), (claims.role, "for the post of Data Clerk (WFH) with", "Data Clerk (WFH)"), (claims.role, "for the Field Trainee role at", "Field Trainee"),
        (claims.role, "Hiring Shift In-charge at our outlet", "Shift In-charge"), (claims.role, "Work as a Media Intern from home", "Media Intern"), (claims.role, "We are hiring freshers!", None), (claims.role, "Internship for 3 months", None),
    ],
)
def test_names_in_claims(f, text, want):
    got = f(text)
    assert (got and text[slice(*got)]) == want


def test_cities():
    assert [(claims.city(t) or (None,))[0] for t in ("Office in bombay", "near NAVI MUMBAI", "our Pune office\nLocation: Vizag", "Pan India", "ſurat", "")] == ["Mumbai", "Navi Mumbai", "Visakhapatnam", None, None, None]
    mail = "Mail hr@pune-jobs.example"
    assert claims.city(mail, [c[2:4] for c in claims.contacts(mail)]) is None


# ---- lookups


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 5, "n")], "k string, t int, v string")
    assert {(r.k, r.v) for r in lookups.latest(df, ["k"], ["t", "v"], ["v"]).collect()} == {("a", "z"), (None, "n")}
    assert {(r.k, r.v) for r in lookups.first_by(df, ["k"], [F.col("t"), F.col("v")], ["v"]).collect()} == {("a", "x"), (None, "n")}


def test_cache_counts_from_the_stored_answer(spark):
    rows = [(1, "k", "2026-01-01 00:00:00"), (2, "k", "2026-01-01 20:00:00"), (3, "k", "2026-01-02 00:00:00"), (4, "k", "2026-01-02 10:00:00"), (5, None, "2026-01-01 00:00:00"), (6, "k", None)]
    df = spark.createDataFrame(rows, "id int, key string, at string").withColumn("at", F.to_timestamp("at"))
    assert {r.id: r.hit for r in lookups.cache_hits(df, "key", "at", "id").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_fingerprint_keeps_the_place_of_a_missing_part(spark):
    df = spark.createDataFrame([(1, "X Pvt Ltd", None, "c", 1), (2, "x", None, "C ", 2), (3, "x", "c", None, 3), (4, None, "a", "b", 4)], "id int, company string, role string, city string, t int")
    df = df.withColumn("p", lookups.fingerprint(F.col("company"), [F.col("role"), F.col("city")]))
    got = {r.id: r for r in lookups.earliest_copy(df, "id", "p", ["t"]).collect()}
    assert got[1].same_as is None and got[2].same_as == 1 and got[3].same_as is None and got[4].p is None
    assert got[1].p == got[2].p != got[3].p


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    root = list(range(200))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert got == {n: top(n) for a, b in links if a is not None and a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# ---- requests and logs


def test_request_keys(spark):
    asked = {
        "k": R.request("google", F.lit(" a  b "), location=F.lit(None).cast("string"), no_cache=F.lit("true")),
        "j": R.job_search(F.lit("Clerk (WFH)"), F.lit("Pune")),
        "own": R.job_search(F.lit("Clerk"), None, F.lit("Zorvan Pvt Ltd")),
        "n": R.notice_lookup(F.lit("zorvan.example"), "broad"),
        "s": R.sender_lookup(F.lit("zorvan.example"), F.lit("hr@mail.brand.co.in"), F.lit("Pune")),
        "c": R.contact_lookup(F.lit("+91 98765 43210")),
        "p": R.place_search(F.lit("Zorvan Ltd"), F.lit(None).cast("string")),
        "r": R.reviews_search(F.lit("p1"), F.lit("fee")),
        "w": R.news_search(F.lit("Zorvan Pvt Ltd")),
    }
    got = {k: json.loads(v) for k, v in spark.range(1).select(*[R.params_key(m).alias(k) for k, m in asked.items()]).first().asDict().items()}
    assert all(x.pop("json_restrictor") == R.RESTRICTORS[x["engine"]] for x in got.values()) and all(x.pop("hl") == "en" for x in got.values())
    assert [k for k, x in got.items() if x.pop("google_domain", None) is None] == ["r", "w"]
    assert got["k"] == {"engine": "google", "gl": "in", "q": "a b"} and got["j"] == {"engine": "google_jobs", "gl": "in", "location": "Pune, India", "q": "Clerk"}
    assert got["own"]["q"] == "Clerk Zorvan" and got["n"]["q"].startswith('site:zorvan.example ("recruitment fraud"') and got["n"]["location"] == "India"
    assert got["s"]["q"] == 'site:zorvan.example "brand.co.in"' and got["c"]["q"] == '"9876543210" (scam OR fraud OR fake)'
    assert got["p"] == {"engine": "google_maps", "gl": "in", "location": "India", "q": "Zorvan", "type": "search", "z": "12"}
    assert got["r"] == {"engine": "google_maps_reviews", "place_id": "p1", "query": "fee"} and got["w"]["q"] == '"Zorvan" job offer (fake OR scam OR fraud)'


def test_replay_takes_the_last_recording_and_never_guesses(spark, tmp_path):
    for n, (at, title) in enumerate([("2026-01-01", "old"), ("2026-01-02", "new")]):
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / f"r{n}.json").write_text(json.dumps({"recordedAt": at, "engine": "google", "params": {"engine": "google", "q": "x"}, "response": {"organic_results": [{"title": title, "extra": 1}]}}))
    (tmp_path / "s" / "bad.json").write_text("{")
    recorded = R.recordings(spark, str(tmp_path / "*" / "*.json"))
    asked = spark.createDataFrame([({"q": " x", "engine": "google"},), ({"q": "y", "engine": "google"},)], "params map<string,string>")
    got = {r.params["q"].strip(): r for r in R.typed(R.replayed(asked, recorded), "google").collect()}
    assert got["x"].response.organic_results[0].title == "new" and got["x"].error is None
    assert got["y"].response is None and got["y"].error == "not_recorded"


def test_error_kinds(spark):
    df = spark.createDataFrame([(None,), (429,), (500,), (200,)], "s int").select(R.error_kind(F.col("s")).alias("k"))
    assert [r.k for r in df.collect()] == ["not_recorded", "rate_limit", "http_error", None]


def test_streamed_windows_and_copies(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").write_bytes(open(f"{small}/events.parquet", "rb").read())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    logs.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    batch = logs.windowed_counts(spark.read.parquet(f"{small}/events.parquet"), "ts", "event_type")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    logs.without_copies(stream, "ts", "event_type", "3650 days").writeStream.format("memory").queryName("d").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    assert spark.table("d").count() == spark.table("d").select("event_type").distinct().count()


# ---- scrubbing


@pytest.mark.parametrize(
    "text, want",
    [
        ("call +91 98765 43210 now", "call +91 9XXXX XXXXX now"),
        ("call 98765-43210", "call 9XXXX-XXXXX"),
        ("91 9876543210", "91 9XXXXXXXXX"),
        ("salary 65000-75000 per month", "salary 65000-75000 per month"),
        ("https://x.example/jobs/12345678901234", "https://x.example/jobs/12345678901234"),
        ("https://wa.me/919876543210", "https://wa.me/919XXXXXXXXX"),
        ("https://x.example/?phone=9876543210&id=77", "https://x.example/?phone=9XXXXXXXXX&id=77"),
        ("", ""),
        (None, None),
    ],
)
def test_phone_masks(text, want):
    assert scrub.mask_phones(text) == want
    assert scrub.mask_phones(want) == want
    assert scrub.count_phones(want) == 0


def test_responses_are_projected_and_masked(spark):
    key = "ab" * 40
    raw = {"organic_results": [{"title": "call 98765 43210", "link": "https://x.example/?api_key=s&a=1", "snippet": f"{key} a.b@c.example \ud800", "extra": 1}, {"title": "t", "link": "https://m.facebook.com/someone"}, 7], "search_metadata": {"id": 1}}
    jobs = {"jobs_results": [{"title": "Clerk", "description": "Nice team. Salary ₹15,000 per month. Ring 98765 43210.", "detected_extensions": {"salary": None}}]}
    rows = [("s", "2026", "google", {"engine": "google", "q": "x"}, json.dumps(raw)), ("s", "2026", "google_jobs", {"engine": "google_jobs"}, json.dumps(jobs)), ("s", "2026", "google", {}, "{"), ("s", "2026", "other", {}, "{}")]
    df = spark.createDataFrame(rows, "sample string, recorded_at string, engine string, params map<string,string>, response string")
    got = [r.response and json.loads(r.response) for r in R.scrubbed(df).collect()]
    assert got[0] == {"organic_results": [{"title": "call 9XXXX XXXXX", "link": "https://x.example/?api_key=&a=1", "snippet": " ***@c.example �"}]}
    assert got[1] == {"jobs_results": [{"title": "Clerk", "description": "Salary ₹15,000 per month.", "detected_extensions": {}}]} and got[2:] == [None, None]


def test_recordings_come_back(spark, tmp_path):
    rows = [("a", "2026-01-01", "google", {"engine": "google", "q": "x"}, '{"organic_results": [{"title": "old"}]}'), ("a", "2026-01-02", "google", {"q": "x", "engine": "google"}, '{"organic_results": [{"title": "new"}]}')]
    df = spark.createDataFrame(rows, "sample string, recorded_at string, engine string, params map<string,string>, response string")
    assert [r.searches_spent for r in R.recorded_and_passed_on(df, str(tmp_path / "out")).collect()] == [1, 1]
    (folder,) = (tmp_path / "out" / "sample=a").glob("name=google-*")
    assert len(folder.name) == len("name=google-") + 12
    (line,) = [x for f in folder.glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(json.loads(line)["response"]) == {"organic_results": [{"title": "new"}]}


def test_sources_and_settings(spark):
    assert R.settings({"A": "env"}, "# c\nexport A='file'\nB = two\n\nbad") == {"A": "env", "B": "two"}
    assert [R.source_of(x) for x in ({"PROVIDER": "fake"}, {"API_KEY": "k"}, {})] == ["fake", "live", "replay"]
    routes = spark.createDataFrame([({"q": "x"}, "{}")], "params map<string,string>, response string")
    asked = spark.createDataFrame([({"q": " x "},), ({"q": "z"},)], "params map<string,string>")
    assert [(r.response, r.error) for r in R.routed(asked, routes).orderBy("key").collect()] == [("{}", None), (None, "no_fixture")]
    got = spark.range(1).select(R.account(F.lit('{"this_month_usage": 3, "secret": 1}')).alias("a"), R.spent(F.lit("hit")).alias("s")).first()
    assert got.a.this_month_usage == 3 and got.s == 0
    with pytest.raises(Exception, match="api_key"):
        spark.range(1).select(R.params_key(F.create_map(F.lit("api_key"), F.lit("s")))).collect()
    df = spark.createDataFrame([(None, "timeout"), (None, "odd"), (401, None), (200, None)], "s int, f string")
    assert [r[0] for r in df.select(R.error_kind(F.col("s"), F.col("f"))).collect()] == ["timeout", "request_failed", "key_rejected", None]


def test_revisions_differences_and_order(spark):
    current = spark.createDataFrame([("a", 1, "x"), ("b", 4, "y")], "k string, revision int, v string")
    updates = spark.createDataFrame([("a", 1, 20, "late"), ("a", 1, 10, "first"), ("b", 3, 5, "stale"), ("c", 1, 1, "none")], "k string, revision int, at int, v string")
    assert sorted(tuple(r) for r in lookups.revised(current, updates, "k", ["v"]).collect()) == [("a", 2, "first", True), ("b", 4, "y", False)]
    one, two = (spark.createDataFrame(x, "line int, t string") for x in ([(1, "a"), (1, "a"), (2, None)], [(1, "a"), (2, None), (3, "c")]))
    assert sorted(tuple(r) for r in lookups.difference(one, two).collect()) == [(1, "a", 2, 1), (3, "c", 0, 1)] and lookups.difference(one, one).count() == 0
    cases = spark.createDataFrame([(2, "open"), (1, "done"), (3, "open")], "at int, status string")
    assert [r.at for r in lookups.in_order(cases, "at", "open").collect()] == [2, 3] and lookups.in_order(cases, "at").count() == 3
    f = spark.createDataFrame([(1, "X", 900, None, True, ["b", "a"]), (2, "x", 900, None, True, ["a", "b"]), (3, "x", 900, 5, True, ["a", "b"]), (4, "x", None, None, None, None)], "id int, c string, m int, fee int, asked boolean, who array<string>")
    got = {r.id: r.p for r in f.select("id", lookups.fingerprint(F.col("c"), lookups.case_parts(F.col("m"), F.col("fee"), F.col("asked"), F.col("who"))).alias("p")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_results_that_are_dropped(spark):
    links = ["https://www.linkedin.com/in/someone", "https://in.linkedin.com/company/x", "https://youtu.be/x", "https://brand.example/", None]
    df = spark.createDataFrame([([(k, x) for k, x in enumerate(links)],), (None,)], "r array<struct<k int, link string>>".replace("k int, link string", "k:int,link:string"))
    got = [r.r for r in df.select(scrub.kept_results(F.col("r")).alias("r")).collect()]
    assert [x.k for x in got[0]] == [1, 3, 4] and got[1] is None


def test_claims_of_a_message():
    text = "Greetings from Zorvan Support Services, you are selected.\nPost: Data Entry Executive\nLocation: Pune\nSalary: Rs. 12,000/- per month\nNo laptop deposit is needed. Pay the registration fee of Rs 999 today."
    assert [(k, v) for k, v, _, _ in claims.claim_spans(text)] == [("company", "Zorvan Support Services"), ("role", "Data Entry Executive"), ("city", "Pune"), ("pay", "12000"), ("fee", "999")]
    assert [c[:2] for c in claims.claim_spans("A registration fee applies.")] == [("fee", "")]
    assert claims.claim_spans("There is no registration fee.") == []


def test_names_match_is_that_of_all_pairs(spark, tmp_path):
    import re

    import __spark_entry__
    from evidencia.functions import matching as M
    from evidencia.functions.text import LEGAL_TAIL

    names = ["Foo Pvt Ltd", "Foo Limited", "FOO", "foo, ltd.", "Foo Bengaluru Office", "Foo Navi Mumbai", "Foo Services", "Foo Pizza", "Bar & Co", "Bar and", "Bar", "Foo Foo", "Pvt Ltd", "India", "India Office", ""]
    spark.createDataFrame([(n,) for n in [*names[:9], None, "FOO"]], "company string").write.parquet(f"{tmp_path}/offers.parquet")
    spark.createDataFrame([(n,) for n in [*names[7:], None]], "company_name string").write.parquet(f"{tmp_path}/job_listings.parquet")

    def own(name):
        t = re.findall("[a-z0-9]+", name.lower().replace("&", " and "))
        while t and t[-1] in LEGAL_TAIL:
            t.pop()
        return t

    extra = {*M.OFFICE, *LEGAL_TAIL, "bengaluru", "navi", "mumbai", "services"}
    want = set()
    for a in names:
        for b in names:
            x, y = own(a), own(b)
            if x and y[: len(x)] == x and set(y[len(x) :]) <= extra and (len(x) < len(y) or a < b):
                want.add((a, b))
    rows = __spark_entry__.queries()["names_match"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.short, r.long) for r in rows} == want
    assert ("Foo Limited", "Foo Pvt Ltd") in want and ("FOO", "Foo Bengaluru Office") in want
