"""Search requests as maps, their canonical keys, and recorded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidencia.functions.domains import host_of, registrable_domain
from evidencia.functions.text import search_name
from evidencia.operators.lookups import latest
from evidencia.operators.scrub import scrub_column

# fixed values: the fields a response keeps, by engine; a parameter that is no part of a query; locale
PLACE = "struct<title:string,place_id:string,type:string,address:string,rating:double,reviews:bigint>"
RESPONSES = {
    "google": "knowledge_graph struct<title:string,website:string>, organic_results array<struct<title:string,link:string,snippet:string>>",
    "google_jobs": "jobs_results array<struct<title:string,company_name:string,location:string,detected_extensions:struct<salary:string>,extensions:array<string>,description:string,apply_options:array<struct<link:string>>>>",
    "google_maps": f"local_results array<{PLACE}>, place_results {PLACE}",
    "google_maps_reviews": "reviews array<struct<snippet:string,rating:double,iso_date:string,link:string>>",
    "google_news": "news_results array<struct<title:string,link:string,source:struct<name:string>,date:string>>",
}
NO_PART = ("no_cache",)
RESTRICTORS = {
    "google": "knowledge_graph.{title,website},organic_results[].{title,link,snippet}",
    "google_jobs": "jobs_results[].{title,company_name,location,detected_extensions.salary,extensions,description,apply_options[].link}",
    "google_maps": "local_results[].{title,place_id,type,address,rating,reviews},place_results.{title,place_id,type,address,rating,reviews}",
    "google_maps_reviews": "reviews[].{snippet,rating,iso_date,link}",
    "google_news": "news_results[].{title,link,source.name,date}",
}
# fixed values: wordings that find notices and reports
NOTICE = {"specific": "(recruitment OR hiring) (fraud OR scam OR fake) never (fee OR money OR payment)", "broad": '("recruitment fraud" OR "fake job offers" OR "recruitment scams" OR "fraudulent")'}
SCAM_NEWS, REPORTED = "job offer (fake OR scam OR fraud)", "(scam OR fraud OR fake)"
LOCALE = {"hl": "en", "gl": "in", "google_domain": "google.co.in"}
ERRORS = {401: "key_rejected", 429: "rate_limit", 400: "bad_query"}
# fixed values: kinds of failure that are no status, counters of an account
FAILURES = "key_missing timeout connection request_failed bad_response no_fixture not_recorded".split()
ACCOUNT = "plan_searches_left bigint, searches_per_month bigint, this_month_usage bigint, this_hour_searches bigint, account_rate_limit_per_hour bigint"


def error_kind(status: Column, failure: Column | None = None) -> Column:
    """The kind of a failed search, as a column: a failure is a value, never an exception in a task.

    ``failure`` names what failed before there was a status, one of FAILURES; anything else there is `request_failed`.
    Without it a null status is a search that was not recorded.
    """
    out = F.when(status.isNull() & F.lit(failure is None), "not_recorded")
    if failure is not None:
        out = F.when(failure.isin(FAILURES), failure).when(failure.isNotNull() | status.isNull(), "request_failed")
    for code, kind in ERRORS.items():
        out = out.when(status == code, kind)
    return out.when(status >= 400, "http_error")


def account(text: Column) -> Column:
    """The five counters of an account's answer; whatever else it says stays behind."""
    return F.from_json(text, ACCOUNT)


def spent(cache: Column) -> Column:
    """What a search costs the case's budget: nothing if the local cache answered, else one, replayed ones included."""
    return F.when(cache == "hit", 0).otherwise(1)


def request(engine: str, q: Column | None, **more: Column) -> Column:
    """A request map; null parameters are left out by the key, the locale is India's.

    ``json_restrictor`` is the projection, pushed to the source: only the members that a reader asks for come back.
    """
    pairs = ({"engine": F.lit(engine)} | ({"q": q} if q is not None else {}) | {k: F.lit(v) for k, v in LOCALE.items()} | more) | {"json_restrictor": F.lit(RESTRICTORS[engine])}
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def _at(city: Column | None) -> Column:
    return F.lit("India") if city is None else F.coalesce(F.concat(city, F.lit(", India")), F.lit("India"))


def site_lookup(company: Column, city: Column | None = None) -> Column:
    """The organisation's own site: its name without legal words, near its city."""
    return request("google", search_name(company), location=_at(city))


def on_site(domain: Column, words: Column, city: Column | None = None) -> Column:
    """Pages of one site only, the predicate pushed to the source."""
    return request("google", F.concat(F.lit("site:"), domain, F.lit(" "), words), location=_at(city))


def notice_lookup(domain: Column, wording: str = "specific", city: Column | None = None) -> Column:
    """The notice about fraud on an employer's site, in one of two wordings."""
    return on_site(domain, F.lit(NOTICE[wording]), city)


def sender_lookup(domain: Column, candidate: Column, city: Column | None = None) -> Column:
    """Pages of an employer's site that name a sender's registrable domain."""
    return on_site(domain, F.concat(F.lit('"'), registrable_domain(host_of(candidate)), F.lit('"')), city)


def contact_lookup(contact: Column, city: Column | None = None) -> Column:
    """Pages with a quoted contact: the last ten digits of a number, a whole address."""
    short = F.when(contact.contains("@"), contact).otherwise(F.right(F.regexp_replace(contact, r"\D", ""), F.lit(10)))
    return request("google", F.concat(F.lit('"'), short, F.lit('" '), F.lit(REPORTED)), location=_at(city))


def job_search(role: Column, city: Column | None = None, company: Column | None = None) -> Column:
    """Listings of a role, brackets aside; with the employer's name only where its own listings are wanted, that is where
    its domain is known.  A null company is left out."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(role, r"\([^)]*\)", " "), r"\s+", " "))
    return request("google_jobs", plain if company is None else F.concat_ws(" ", plain, search_name(company)), location=_at(city))


def place_search(company: Column, city: Column | None = None) -> Column:
    return request("google_maps", search_name(company), type=F.lit("search"), location=_at(city), z=F.lit("12"))


def reviews_search(place_id: Column, term: Column) -> Column:
    """Reviews of one place that have a term."""
    return F.map_filter(request("google_maps_reviews", None, place_id=place_id, query=term), lambda k, v: ~k.isin("gl", "google_domain"))


def news_search(company: Column) -> Column:
    """News that name the company in quotes beside words of warning, wherever they appeared."""
    return F.map_filter(request("google_news", F.concat(F.lit('"'), search_name(company), F.lit('" '), F.lit(SCAM_NEWS))), lambda k, v: k != "google_domain")


def params_key(params: Column) -> Column:
    """One text for all maps that ask the same: names sorted, white space single, nulls and `no_cache` left out.

    A key of the service has no place in what is asked: a map that has one is an error, so that it is never written down.
    """
    refused = F.raise_error(F.lit("a request must not hold api_key")).cast("string")
    return F.when(F.map_contains_key(params, "api_key"), refused).otherwise(_canonical(params))


def _canonical(params: Column) -> Column:
    kept = F.map_filter(params, lambda k, v: v.isNotNull() & ~k.isin(*NO_PART))
    clean = F.transform_values(kept, lambda k, v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(clean))))


def cache_key(params: Column) -> Column:
    return F.sha2(params_key(params), 256)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(sample, file, recorded_at, engine, params, response) of recording files, one JSON object each."""
    raw = spark.read.option("multiLine", True).schema("recordedAt string, engine string, params map<string,string>, response string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    named = raw.withColumn("file", F.input_file_name())
    return named.filter("_bad is null").select(F.element_at(F.split("file", "/"), -2).alias("sample"), "file", F.col("recordedAt").alias("recorded_at"), "engine", "params", "response")


def replayed(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """``requests`` with the response recorded last for the same key; a miss has error `not_recorded`, never a guess."""
    known = latest(recorded.withColumn("key", params_key(F.col("params"))), ["key"], ["recorded_at", "file"], ["response", "recorded_at"])
    met = requests.withColumn("key", params_key(F.col("params"))).join(known, "key", "left")
    return met.withColumn("error", F.when(F.col("response").isNull(), "not_recorded"))


def typed(df: DataFrame, engine: str, response: str = "response") -> DataFrame:
    """The response as its engine's struct: fields that no reader asks for are never parsed into columns."""
    return df.withColumn(response, F.from_json(response, RESPONSES[engine]))


def recording_name(engine: Column, params: Column) -> Column:
    """`engine-` and twelve hexadecimal digits of the request's key."""
    return F.concat(engine, F.lit("-"), F.left(cache_key(params), F.lit(12)))


def scrubbed(df: DataFrame, response: str = "response") -> DataFrame:
    """Recordings with only what readers ask for, masked, by engine; those of other engines and broken ones become null."""
    out = F.lit(None).cast("string")
    for engine, ddl in RESPONSES.items():
        out = F.when(F.col("engine") == engine, scrub_column(StructType.fromDDL(ddl))(response)).otherwise(out)
    return df.withColumn(response, out)


def record(df: DataFrame, path: str) -> None:
    """Writes recordings (sample, recorded_at, engine, params, response) scrubbed, one folder a sample and request.

    A recording under the same name in one run is the later one; the committer makes each file whole or absent.
    """
    named = scrubbed(df).withColumn("name", recording_name(F.col("engine"), F.col("params")))
    once = latest(named, ["sample", "name"], ["recorded_at"], ["recorded_at", "engine", "params", "response"])
    once.withColumnRenamed("recorded_at", "recordedAt").write.mode("append").partitionBy("sample", "name").json(path)


def recorded_and_passed_on(df: DataFrame, path: str) -> DataFrame:
    """Served searches written as recordings and handed on, each at the cost of one search even where a cache answered."""
    record(df, path)
    return df.withColumn("searches_spent", F.lit(1))


def routed(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests answered from a table of routes (params, response): a test's source; without a route the error is `no_fixture`."""
    known = routes.select(params_key(F.col("params")).alias("key"), F.col("response"))
    met = requests.withColumn("key", params_key(F.col("params"))).join(known, "key", "left")
    return met.withColumn("error", F.when(F.col("response").isNull(), "no_fixture"))


def settings(environment: dict[str, str], lines: str = "") -> dict[str, str]:
    """Settings of the `NAME=value` lines of a file, over which the environment goes; comments and quotes aside."""
    pairs = (x.strip().removeprefix("export ").partition("=") for x in lines.splitlines() if "=" in x and not x.strip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs} | environment


def source_of(own: dict[str, str]) -> str:
    """Which source answers: the one that is named, else live if there is a key, else replay."""
    return own.get("PROVIDER") or ("live" if own.get("API_KEY") else "replay")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(name, source_text) of message files, one each."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1).alias("name"), F.col("value").alias("source_text"))
