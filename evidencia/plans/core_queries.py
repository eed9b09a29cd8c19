"""Core queries over whole tables, and the same in SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.functions import benchmark as B
from evidencia.functions import domains as D
from evidencia.functions import matching as M
from evidencia.functions import text as T
from evidencia.operators import claims, lookups, scrub
from evidencia.sources import requests as R
from evidencia.streaming import logs
from evidencia.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_EMAILS = f"SELECT DISTINCT offer_id, lower(unnest(regexp_extract_all(source_text, '{T.EMAIL}'))) AS email FROM offers"
_REGISTRABLE = (
    "CASE WHEN len(l) > (CASE WHEN array_to_string(l[-2:], '.') IN (" + _list(D.SUFFIXES) + ") THEN 2 ELSE 1 END) "
    "THEN array_to_string(l[-((CASE WHEN array_to_string(l[-2:], '.') IN (" + _list(D.SUFFIXES) + ") THEN 2 ELSE 1 END) + 1):], '.') END"
)


def _emails(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "offers", "offer_id", "source_text").select("offer_id", F.explode(T.emails(F.col("source_text"))).alias("email")).distinct()


@query(_EMAILS)
def email_contacts(spark, sf_dir):
    """(offer_id, email): addresses in each message, lower case, once."""
    return _emails(spark, sf_dir)


@query(f"WITH e AS ({_EMAILS}), h AS (SELECT offer_id, split_part(email, '@', 2) AS host, string_split(split_part(email, '@', 2), '.') AS l FROM e) SELECT host, {_REGISTRABLE} AS domain, count(*) AS n, min(offer_id) AS first_offer FROM h GROUP BY host, domain")
def email_domain_rollup(spark, sf_dir):
    """(host, domain, n, first_offer): hosts of addresses with their registrable domains."""
    host = D.host_of(F.col("email"))
    return _emails(spark, sf_dir).select("offer_id", host.alias("host")).withColumn("domain", D.registrable_domain(F.col("host"))).groupBy("host", "domain").agg(F.count("*").alias("n"), F.min("offer_id").alias("first_offer"))


@query(f"SELECT DISTINCT offer_id, x[1:3] || ' ' || x[4:8] || ' ' || x[9:13] AS phone FROM (SELECT offer_id, '+91' || right(regexp_replace(unnest(regexp_extract_all(source_text, '{T.MOBILE}')), '[^0-9]', '', 'g'), 10) AS x FROM offers)")
def phone_contacts(spark, sf_dir):
    """(offer_id, phone): mobile numbers in each message in one form."""
    return table(spark, sf_dir, "offers", "offer_id", "source_text").select("offer_id", F.explode(T.mobiles(F.col("source_text"))).alias("phone")).distinct()


_MASKED = r"regexp_replace({0}, '[A-Za-z0-9_.%+-]+(@|%40)((?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}})', '***\1\2', 'g')"


@query(f"SELECT DISTINCT offer_id, md5({_MASKED.format('source_text')}) AS masked FROM offers")
def mask_emails(spark, sf_dir):
    """(offer_id, masked): digest of the message with local parts masked."""
    return table(spark, sf_dir, "offers", "offer_id", "source_text").select("offer_id", F.md5(T.mask_emails(F.col("source_text"))).alias("masked")).distinct()


@query(f"SELECT count(*) AS n FROM offers WHERE regexp_matches({_MASKED.format('source_text')}, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]')")
def emails_left_after_mask(spark, sf_dir):
    """(n): messages with an address after masking, which must be 0."""
    return table(spark, sf_dir, "offers", "source_text").filter(T.mask_emails(F.col("source_text")).rlike(r"[A-Za-z0-9_.%+-]+@[A-Za-z0-9-]+\.[A-Za-z]")).agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{T.LONG_HEX}', '', 'g'), '(api_key=)[^&\s""''<>]+', '\1', 'g')) AS cleaned FROM documents".replace('""', '"'))
def secret_scrub(spark, sf_dir):
    """(doc_id, cleaned): digest of each text without key-shaped runs."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(T.drop_keys(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN '[' || length(text) || ' characters]' ELSE text END AS shown FROM documents")
def redact_long(spark, sf_dir):
    """(doc_id, shown): long texts as a note of their length."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.redact_long(F.col("text")).alias("shown"))


@query(r"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(list_filter(regexp_split_to_array(text, '[!?]+|\n|\.(?:\s|$)'), lambda s: regexp_matches(s, '\S'))) END AS sentences FROM documents")
def sentence_count(spark, sf_dir):
    """(doc_id, sentences)."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.sentence_count(F.col("text")).cast("bigint").alias("sentences"))


@query(f"SELECT lang, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(text, '{T.FRAUD}')) AS warned FROM documents GROUP BY lang")
def fraud_warnings(spark, sf_dir):
    """(lang, docs, warned): texts with a word that warns of fraud."""
    return table(spark, sf_dir, "documents", "lang", "text").groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(T.warns_of_fraud(F.col("text"))).alias("warned"))


@query(f"SELECT DISTINCT company, regexp_replace(regexp_replace(company, '{T.LEGAL}', ''), '[.,]+$', '') AS search_name, array_to_string(regexp_extract_all(replace(lower(company), 'ß', 'ss'), '{T.WORDS}'), ' ') AS norm FROM offers WHERE company IS NOT NULL")
def company_forms(spark, sf_dir):
    """(company, search_name, norm): each company as it is searched and as it is compared."""
    c = F.col("company")
    return table(spark, sf_dir, "offers", "company").filter("company is not null").distinct().select("company", T.search_name(c).alias("search_name"), T.normalised(c).alias("norm"))


@query(
    "WITH h AS (SELECT DISTINCT link, regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS host FROM organic_results WHERE link IS NOT NULL) "
    f"SELECT host, {_REGISTRABLE} AS domain, count(*) AS links FROM (SELECT host, string_split(host, '.') AS l FROM h) GROUP BY host, domain"
)
def link_domains(spark, sf_dir):
    """(host, domain, links): distinct result links by host."""
    links = table(spark, sf_dir, "organic_results", "link").filter("link is not null").distinct()
    return links.select(D.host_of(F.col("link")).alias("host")).groupBy("host").agg(F.count("*").alias("links")).select("host", D.registrable_domain(F.col("host")).alias("domain"), "links")


_SEEN = f"translate(strip_accents({{0}}), '{''.join(D.CONFUSABLE)}', '{''.join(D.CONFUSABLE.values())}')"
_MAIL_LABELS = f"SELECT DISTINCT label, {_SEEN.format('label')} AS s FROM (SELECT split_part(regexp_replace(split_part(email, '@', 2), '^www\\.', ''), '.', 1) AS label FROM ({_EMAILS}))"
_LINK_LABELS = f"SELECT DISTINCT brand, {_SEEN.format('brand')} AS s FROM (SELECT split_part(regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '.', 1) AS brand FROM organic_results WHERE link IS NOT NULL)"


@query(
    f"WITH a AS ({_MAIL_LABELS}), b AS ({_LINK_LABELS}), p AS (SELECT label, brand, a.s AS x, b.s AS y FROM a, b WHERE label <> brand) SELECT label, brand, reason FROM (SELECT label, brand, "
    "CASE WHEN x = y THEN 'letters' WHEN len(y) > 3 AND contains(x, y) OR len(y) <= 3 AND list_contains(string_split(x, '-'), y) THEN 'contains' WHEN len(y) >= 5 AND damerau_levenshtein(x, y) <= CASE WHEN len(y) >= 9 THEN 2 ELSE 1 END THEN 'edits' END AS reason FROM p) WHERE reason IS NOT NULL"
)
def domain_lookalikes(spark, sf_dir):
    """(label, brand, reason): host labels in messages that imitate a label of result links."""
    label = lambda c: F.substring_index(c, ".", 1)
    own = _emails(spark, sf_dir).select(label(D.host_of(F.col("email"))).alias("label"))
    brands = table(spark, sf_dir, "organic_results", "link").select(label(D.host_of(F.col("link"))).alias("brand"))
    return D.lookalikes(own, brands)


_CLEAN = r"regexp_replace(trim({0}), '\s+', ' ', 'g')"
_KEY = "'{' || array_to_string(list_filter([CASE WHEN engine IS NOT NULL THEN '\"engine\":' || to_json(" + _CLEAN.format("engine") + ") END, CASE WHEN location IS NOT NULL THEN '\"location\":' || to_json(" + _CLEAN.format("location") + ") END, CASE WHEN q IS NOT NULL THEN '\"q\":' || to_json(" + _CLEAN.format("q") + ") END], lambda x: x IS NOT NULL), ',') || '}'"
_KEYED = f"SELECT *, {_KEY} AS key FROM searches"


def _searches(spark, sf_dir, *columns) -> DataFrame:
    return table(spark, sf_dir, "searches", "engine", "q", "location", *columns).withColumn("key", R.params_key(_params())).select("key", *columns)


def _params():
    return F.create_map(F.lit("engine"), F.col("engine"), F.lit("q"), F.col("q"), F.lit("location"), F.col("location"))


@query(f"SELECT search_id, key, sha256(key) AS cache_key FROM ({_KEYED})")
def request_keys(spark, sf_dir):
    """(search_id, key, cache_key): the canonical text of each search and its digest."""
    asked = table(spark, sf_dir, "searches", "search_id", "engine", "q", "location")
    return asked.select("search_id", R.params_key(_params()).alias("key"), R.cache_key(_params()).alias("cache_key"))


@query(f"SELECT key, search_id, provider FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY recorded_at DESC, search_id DESC) AS rn FROM ({_KEYED})) WHERE rn = 1")
def replay_latest(spark, sf_dir):
    """(key, search_id, provider): of equal searches the one recorded last."""
    return lookups.latest(_searches(spark, sf_dir, "search_id", "provider", "recorded_at"), ["key"], ["recorded_at", "search_id"], ["search_id", "provider"])


@query(
    f"WITH RECURSIVE o AS (SELECT search_id, key, recorded_at, row_number() OVER (PARTITION BY key ORDER BY recorded_at, search_id) AS rn FROM ({_KEYED})), "
    "w AS (SELECT search_id, key, rn, recorded_at AS stored, false AS hit FROM o WHERE rn = 1 UNION ALL SELECT o.search_id, o.key, o.rn, CASE WHEN o.recorded_at - w.stored < INTERVAL 24 HOUR THEN w.stored ELSE o.recorded_at END, o.recorded_at - w.stored < INTERVAL 24 HOUR FROM w JOIN o ON o.key = w.key AND o.rn = w.rn + 1) SELECT search_id, key, hit FROM w"
)
def cache_hits(spark, sf_dir):
    """(search_id, key, hit): searches that a cache of 24 hours would have answered."""
    return lookups.cache_hits(_searches(spark, sf_dir, "search_id", "recorded_at"), "key", "recorded_at", "search_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def supersede_latest(spark, sf_dir):
    """(user_id, event_type, event_id, value): the finding that stands."""
    return lookups.latest(table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


_NORM = "array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '" + T.WORDS.replace("{", "{{").replace("}", "}}") + "'), ' ')"
_PHONES = f"list_transform(regexp_extract_all(source_text, '{T.MOBILE}'), lambda m: '+91 ' || right(regexp_replace(m, '[^0-9]', '', 'g'), 10)[1:5] || ' ' || right(regexp_replace(m, '[^0-9]', '', 'g'), 5))"
_WHO = f"array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(source_text, '{T.EMAIL}'), lambda m: lower(m)), {_PHONES}))), ' ')"
_PARTS = " || '|' || ".join(f"coalesce({_NORM.format(c)}, '')" for c in ("role", "city", "pay_raw", "fee_raw", "who"))
_PRINT = f"SELECT DISTINCT offer_id, received_at, CASE WHEN company IS NOT NULL THEN 'sha256:' || left(sha256({_NORM.format(f'''regexp_replace(regexp_replace(company, '{T.LEGAL}', ''), '[.,]+$', '')''')} || '|' || {_PARTS}), 16) END AS print FROM (SELECT *, {_WHO} AS who FROM offers)"


@query(f"WITH p AS ({_PRINT}) SELECT offer_id, print, nullif(CASE WHEN print IS NOT NULL THEN first_value(offer_id) OVER (PARTITION BY print ORDER BY received_at, offer_id) END, offer_id) AS same_as FROM p")
def fingerprint_copies(spark, sf_dir):
    """(offer_id, print, same_as): messages of one organisation, role, city, pay, fee and contacts, and the first of them.

    Pay and fee count as they are written here; ``lookups.case_parts`` takes them as rupees.
    """
    text = F.col("source_text")
    who = F.array_join(F.array_sort(F.array_distinct(F.concat(T.emails(text), T.mobiles(text)))), " ")
    rows = table(spark, sf_dir, "offers", "offer_id", "received_at", "company", "role", "city", "pay_raw", "fee_raw", "source_text")
    own = lookups.fingerprint(F.col("company"), [F.col("role"), F.col("city"), F.col("pay_raw"), F.col("fee_raw"), who])
    rows = rows.select("offer_id", "received_at", own.alias("print")).distinct()
    return lookups.earliest_copy(rows, "offer_id", "print", ["received_at"])


_TOK = r"regexp_extract_all(lower(replace(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'), '&', ' and ')), '[a-z0-9]+')"
_FOLD = "array_to_string(" + _TOK + ", ' ')"
_NAME = "trim(regexp_replace(' ' || {0}, '( (" + "|".join(T.LEGAL_TAIL) + "))+$', ''))"


@query(
    f"WITH j AS (SELECT DISTINCT listing_id, search_id, title FROM job_listings), t AS (SELECT j.listing_id, s.search_id, {_TOK.format('j.title')} AS t, list_filter(list_distinct({_TOK.format(chr(114) + '''egexp_replace(s.q, '[(][^)]*[)]', ' ', 'g')''')}), lambda x: x NOT IN ({_list(M.ROLE_FILLER)})) AS w FROM j JOIN searches s USING (search_id)) "
    "SELECT search_id, count(*) AS listings, count(*) FILTER (WHERE len(w) > 0 AND 2 * len(list_intersect(w, t)) > len(w)) AS matched FROM t GROUP BY search_id"
)
def role_matches(spark, sf_dir):
    """(search_id, listings, matched): listings whose title is the role that was searched."""
    j = table(spark, sf_dir, "job_listings", "listing_id", "search_id", "title").distinct()
    s = table(spark, sf_dir, "searches", "search_id", "q")
    return j.join(s, "search_id").groupBy("search_id").agg(F.count("*").alias("listings"), F.count_if(M.role_matches(F.col("title"), F.col("q"))).alias("matched"))


@query(
    f"WITH r AS (SELECT DISTINCT result_id, search_id, title, snippet FROM organic_results), t AS (SELECT r.result_id, {_FOLD.format('r.title')} AS title, {_FOLD.format('r.snippet')} AS snippet, {_NAME.format(_FOLD.format('s.q'))} AS q FROM r JOIN searches s USING (search_id)) "
    "SELECT result_id, coalesce(q <> '' AND contains(' ' || title || ' ', ' ' || q || ' '), false) AS in_title, coalesce(q <> '' AND contains(' ' || snippet || ' ', ' ' || q || ' '), false) AS in_snippet FROM t"
)
def name_mentions(spark, sf_dir):
    """(result_id, in_title, in_snippet): results that mention the name searched, legal words at its end aside."""
    r = table(spark, sf_dir, "organic_results", "result_id", "search_id", "title", "snippet").distinct()
    s = table(spark, sf_dir, "searches", "search_id", "q")
    has = lambda c: F.coalesce(M.mentions(F.col(c), F.col("q")), F.lit(False))
    return r.join(s, "search_id").select("result_id", has("title").alias("in_title"), has("snippet").alias("in_snippet"))


@query(
    f"WITH n AS (SELECT DISTINCT name, string_split({_NAME.format(_FOLD.format('name'))}, ' ') AS t FROM (SELECT company AS name FROM offers UNION ALL SELECT company_name FROM job_listings) WHERE name IS NOT NULL), own AS (SELECT name, t FROM n WHERE t[1] <> '') "
    f"SELECT a.name AS short, b.name AS long FROM own a JOIN own b ON a.t[1] = b.t[1] AND len(a.t) <= len(b.t) AND b.t[1:len(a.t)] = a.t AND (len(a.t) < len(b.t) OR a.name < b.name) AND len(list_filter(b.t[len(a.t) + 1:], lambda x: x NOT IN ({_list([*M.OFFICE, *T.LEGAL_TAIL, *M.KIND, *M.CITY])}))) = 0"
)
def names_match(spark, sf_dir):
    """(short, long): companies of messages and listings one of which begins the other, met by its prefixes; of equal ones the lesser is short."""
    name = lambda t, c: table(spark, sf_dir, t, c).select(F.col(c).alias("name")).filter("name is not null").distinct()
    own = name("offers", "company").unionByName(name("job_listings", "company_name")).distinct().withColumn("t", M.name_tokens(F.col("name"))).filter(F.size("t") > 0)
    short = own.select(F.col("name").alias("short"), F.array_join("t", " ").alias("key"))
    prefix = F.transform(F.sequence(F.lit(1), F.size("t")), lambda n: F.array_join(F.slice("t", F.lit(1), n), " "))
    long = own.select(F.col("name").alias("long"), F.array_join("t", " ").alias("whole"), F.explode(prefix).alias("key"))
    met = short.join(long, "key").filter((F.col("key") != F.col("whole")) | (F.col("short") < F.col("long")))
    return met.filter(M.names_match(F.col("short"), F.col("long"))).select("short", "long").distinct()


_NEAR = f"contains(' ' || {_FOLD.format('j.location')} || ' ', ' ' || {_FOLD.format('''split_part(s.location, ',', 1)''')} || ' ')"


@query(f"SELECT s.search_id FROM searches s WHERE s.location IS NOT NULL AND NOT EXISTS (SELECT 1 FROM job_listings j WHERE j.search_id = s.search_id AND {_NEAR})")
def searches_without_near(spark, sf_dir):
    """(search_id): searches at a place none of whose listings is there."""
    s = table(spark, sf_dir, "searches", "search_id", "location").filter("location is not null").withColumnRenamed("location", "place")
    j = table(spark, sf_dir, "job_listings", "search_id", "location")
    near = j.join(s, "search_id").filter(M.in_place(F.col("location"), F.substring_index("place", ",", 1))).select("search_id").distinct()
    return s.select("search_id").join(near, "search_id", "left_anti")


@query("WITH j AS (SELECT DISTINCT listing_id, extensions FROM job_listings) SELECT listing_id, unnest(generate_series(0, len(extensions) - 1)) AS pos, unnest(extensions) AS value FROM j WHERE len(extensions) > 0")
def listing_extensions(spark, sf_dir):
    """(listing_id, pos, value): extensions with their places."""
    return table(spark, sf_dir, "job_listings", "listing_id", "extensions").distinct().select("listing_id", F.posexplode("extensions").alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


_PAYLIKE = r"(?i)(?:₹|\brs\b|\binr\b|\blpa\b|\blakh|\blac)"


@query(
    f"WITH j AS (SELECT DISTINCT listing_id, detected_extensions.salary AS s, extensions AS e, description AS d FROM job_listings) SELECT CASE WHEN s IS NOT NULL THEN 'salary' WHEN len(list_filter(e, lambda x: regexp_matches(x, '{_PAYLIKE}'))) > 0 THEN 'extensions' WHEN regexp_matches(d, '{_PAYLIKE}') THEN 'description' ELSE 'none' END AS source, count(*) AS n FROM j GROUP BY source"
)
def source_fallthrough(spark, sf_dir):
    """(source, n): where a listing's pay would be read first."""
    j = table(spark, sf_dir, "job_listings", "listing_id", "detected_extensions", "extensions", "description").distinct()
    source = F.when(F.col("detected_extensions.salary").isNotNull(), "salary").when(F.exists("extensions", lambda x: x.rlike(_PAYLIKE)), "extensions").when(F.col("description").rlike(_PAYLIKE), "description").otherwise("none")
    return j.groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT DISTINCT result_id, search_id, pos, snippet FROM organic_results) SELECT search_id, result_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN regexp_matches(snippet, '(?i)fee|deposit') THEN 0 ELSE 1 END, pos, result_id) AS rn FROM r) WHERE rn = 1")
def first_phrased_else_first(spark, sf_dir):
    """(search_id, result_id, pos): the first result that speaks of a fee, else the first of all."""
    r = table(spark, sf_dir, "organic_results", "result_id", "search_id", "pos", "snippet").distinct()
    phrased = F.coalesce(F.col("snippet").rlike("(?i)fee|deposit"), F.lit(False))
    return lookups.first_by(r, ["search_id"], [(~phrased).cast("int"), F.col("pos"), F.col("result_id")], ["result_id", "pos"])


@query("SELECT c_mktsegment, n_name, count(*) AS listings, count(o_totalprice) AS found, median(o_totalprice) AS median_pay FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name")
def pay_benchmark(spark, sf_dir):
    """(c_mktsegment, n_name, listings, found, median_pay): exact medians by group."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return B.benchmark(o.join(c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")), ["c_mktsegment", "n_name"], "o_totalprice")


@query("WITH b AS (SELECT o_orderpriority, count(o_totalprice) AS found, median(o_totalprice) AS m FROM orders GROUP BY o_orderpriority) SELECT o_orderkey FROM orders JOIN b USING (o_orderpriority) WHERE found >= 3 AND o_totalprice > 2.0 * m")
def pay_outliers(spark, sf_dir):
    """(o_orderkey): amounts above twice the median of their group of three or more."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    b = B.benchmark(o, ["o_orderpriority"], "o_totalprice")
    return o.join(b, "o_orderpriority").filter(B.is_outlier(F.col("o_totalprice"), F.col("found"), F.col("median_pay"))).select("o_orderkey")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    """(window_start, event_type, n): the log's tumbling windows."""
    return logs.windowed_counts(table(spark, sf_dir, "events", "ts", "event_type"), "ts", "event_type")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY user_id")
def props_projection(spark, sf_dir):
    """(user_id, n, kinds, k): a projection of nested members by schema."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "props").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.sum("p.k").alias("k"))


@query()
def offer_spans(spark, sf_dir):
    """(offer_id, kind, value, begin, end, synthetic): sentences, contacts and amounts with their spans."""
    return claims.extract(table(spark, sf_dir, "offers", "offer_id", "source_text"), "offer_id", "source_text").distinct()


def _claimed(spark, sf_dir, kind: str) -> DataFrame:
    return offer_spans(spark, sf_dir).filter(F.col("kind") == kind)


@query(_EMAILS)
def claimed_emails(spark, sf_dir):
    """(offer_id, email): addresses as the claim reader finds them."""
    return _claimed(spark, sf_dir, "email").select("offer_id", F.col("value").alias("email"))


@query()
def masked_listings(spark, sf_dir):
    """(listing_id, masked, left): descriptions with phone numbers masked, and numbers still found, which must be 0."""
    masked = scrub.mask_phones_column("description")
    return table(spark, sf_dir, "job_listings", "listing_id", "description").distinct().select("listing_id", masked.alias("masked")).withColumn("left", scrub.count_phones_column("masked"))


@query()
def listing_pay_sentences(spark, sf_dir):
    """(listing_id, pay_text): what a description says about pay."""
    return table(spark, sf_dir, "job_listings", "listing_id", "description").filter("description is not null").distinct().select("listing_id", scrub.pay_sentences_column("description").alias("pay_text"))


_PLACE = _FOLD.format("split_part(s.location, ',', 1)")
_ON = "contains(' ' || loc || ' ', ' ' || {0} || ' ')"
_NAMES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in M.NAMES.items()) + ") AS c(name, today)"


@query(
    f"WITH j AS (SELECT DISTINCT listing_id, search_id, location FROM job_listings), p AS (SELECT j.listing_id, j.search_id, {_FOLD.format('j.location')} AS loc, {_PLACE} AS own, j.location AS raw FROM j JOIN searches s USING (search_id) WHERE s.location IS NOT NULL AND j.location IS NOT NULL), "
    f"m AS (SELECT p.*, EXISTS (SELECT 1 FROM {_NAMES} WHERE {_ON.format('c.name')}) AS named, own <> '' AND ({_ON.format('own')} OR EXISTS (SELECT 1 FROM {_NAMES} WHERE c.today = coalesce((SELECT d.today FROM {_NAMES.replace('c(name', 'd(name')} WHERE d.name = own), own) AND {_ON.format('c.name')})) AS within FROM p) "
    f"SELECT search_id, count(*) AS listings, count(*) FILTER (WHERE within) AS in_city, count(*) FILTER (WHERE within OR (NOT regexp_matches(raw, '{M.REMOTE}') AND NOT named)) AS near FROM m GROUP BY search_id"
)
def listings_near(spark, sf_dir):
    """(search_id, listings, in_city, near): listings in the city searched, and those at no other city and not remote."""
    j = table(spark, sf_dir, "job_listings", "listing_id", "search_id", "location").filter("location is not null").distinct()
    s = table(spark, sf_dir, "searches", "search_id", "location").filter("location is not null").select("search_id", F.substring_index("location", ",", 1).alias("place"))
    at, place = F.col("location"), F.col("place")
    return j.join(s, "search_id").groupBy("search_id").agg(F.count("*").alias("listings"), F.count_if(M.in_city(at, place)).alias("in_city"), F.count_if(M.near(at, place)).alias("near"))


@query(
    f"WITH r AS (SELECT DISTINCT result_id, search_id, pos, title, link FROM organic_results WHERE link IS NOT NULL), h AS (SELECT r.*, {_NAME.format(_FOLD.format('s.q'))} AS q, {_FOLD.format('r.title')} AS folded, string_split(regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '.') AS l FROM r JOIN searches s USING (search_id)), "
    f"d AS (SELECT *, {_REGISTRABLE} AS domain FROM h), k AS (SELECT *, replace(split_part(domain, '.', 1), '-', '') AS label, replace(q, ' ', '') AS whole, string_split(q, ' ') AS t FROM d WHERE q <> ''), "
    "f AS (SELECT *, CASE WHEN label = whole THEN 0 WHEN len(t) > 1 AND len(label) >= 4 AND list_contains(list_transform(generate_series(1, greatest(len(t) - 1, 1)), lambda n: array_to_string(t[1:n], '')), label) AND contains(' ' || folded || ' ', ' ' || q || ' ') THEN 1 END AS rank FROM k) "
    "SELECT search_id, domain FROM (SELECT search_id, domain, row_number() OVER (PARTITION BY search_id ORDER BY rank, pos, result_id) AS rn FROM f WHERE rank IS NOT NULL) WHERE rn = 1"
)
def official_domains(spark, sf_dir):
    """(search_id, domain): the domain that a search's results show as the organisation's own."""
    r = table(spark, sf_dir, "organic_results", "result_id", "search_id", "pos", "title", "link").filter("link is not null").distinct()
    s = table(spark, sf_dir, "searches", "search_id", "q").filter("q is not null")
    # a search has as many results as fit a page
    pages = r.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("pos", "result_id", "link", "title"))).alias("results"))
    return pages.join(s, "search_id").select("search_id", M.official_domain(F.col("results"), F.col("q")).alias("domain")).filter("domain is not null")


@query(
    "WITH r AS (SELECT DISTINCT result_id, search_id, link, string_split(regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '.') AS l FROM organic_results), "
    rf"d AS (SELECT *, {_REGISTRABLE} AS domain FROM r) SELECT search_id, count(*) AS results, count(*) FILTER (WHERE NOT coalesce(domain IN ({_list([*D.PEOPLE, *D.VIDEO])}) OR regexp_matches(link, '(?i)^https?://(?:[a-z0-9-]+\.)*linkedin\.com/(?:in|pub)/'), false)) AS kept FROM d GROUP BY search_id"
)
def results_kept(spark, sf_dir):
    """(search_id, results, kept): results that are no page about a person and no video."""
    r = table(spark, sf_dir, "organic_results", "result_id", "search_id", "link").distinct()
    own = F.size(scrub.kept_results(F.array(F.struct("link")))) == 1
    return r.groupBy("search_id").agg(F.count("*").alias("results"), F.count_if(own).alias("kept"))


@query(
    rf"SELECT doc_id, CASE WHEN length(text) > 200 THEN '[' || length(text) || ' characters]' ELSE regexp_replace(regexp_replace({_MASKED.format('text')}, '{T.LONG_HEX}', '', 'g'), '(api_key=)[^&\s""''<>]+', '', 'g') END AS shown FROM documents".replace('""', '"')
)
def redacted_log(spark, sf_dir):
    """(doc_id, shown): texts as a log may hold them."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.redacted(F.col("text")).alias("shown"))


@query("SELECT provider, cache, count(*) AS searches, CAST(sum(CASE WHEN cache = 'hit' THEN 0 ELSE 1 END) AS BIGINT) AS spent FROM searches GROUP BY provider, cache")
def search_costs(spark, sf_dir):
    """(provider, cache, searches, spent): what searches cost by who answered."""
    s = table(spark, sf_dir, "searches", "provider", "cache")
    return s.groupBy("provider", "cache").agg(F.count("*").alias("searches"), F.sum(R.spent(F.col("cache"))).alias("spent"))


@query("SELECT engine, q, count(*) FILTER (WHERE cache = 'hit') AS in_one, count(*) FILTER (WHERE coalesce(cache, '') <> 'hit') AS in_two FROM searches GROUP BY engine, q HAVING in_one <> in_two")
def trace_difference(spark, sf_dir):
    """(engine, q, in_one, in_two): searches that the cache answered against those it did not, where the traces differ."""
    s = table(spark, sf_dir, "searches", "engine", "q", "cache")
    hit = F.coalesce(F.col("cache") == "hit", F.lit(False))
    return lookups.difference(s.filter(hit).select("engine", "q"), s.filter(~hit).select("engine", "q"))


@query(f"SELECT DISTINCT role, array_to_string({_TOK.format('role')}, ' ') AS folded FROM offers WHERE role IS NOT NULL")
def role_tokens(spark, sf_dir):
    """(role, folded): roles as they are compared."""
    return table(spark, sf_dir, "offers", "role").filter("role is not null").distinct().select("role", T.folded(F.col("role")).alias("folded"))


@query()
def listing_pays(spark, sf_dir):
    """(listing_id, source, phrase, monthly): the first source of a listing's pay and its middle in rupees per month."""
    import pandas as pd

    from evidencia.operators.money import listing_pay
    from evidencia.runtime import spread

    def run(frames):
        for f in frames:
            rows = [(k, listing_pay(d and d["salary"], e, t)) for k, d, e, t in zip(f["listing_id"], f["detected_extensions"], f["extensions"], f["description"])]
            yield pd.DataFrame([(k, *x) for k, x in rows if x], columns=["listing_id", "source", "phrase", "monthly"])

    j = table(spark, sf_dir, "job_listings", "listing_id", "detected_extensions", "extensions", "description")
    return spread(j).mapInPandas(run, "listing_id bigint, source string, phrase string, monthly bigint").distinct()
