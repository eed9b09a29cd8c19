"""The pN_ queries of the core: nested recordings (7) and pay in different units (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.operators import nested, units
from evidencia.runtime import spread, stored, table


def _recordings(spark, sf_dir: str) -> DataFrame:
    return nested.shred(table(spark, sf_dir, "recordings", "rec_id", "body"), "rec_id", "body")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """(rec_id, child, parent_pos, pos, value): searches' q, places' titles and listings' extensions, from the flat tables."""
    rows = stored(_recordings(spark, sf_dir))
    none = F.lit(-1).cast("bigint")
    q = nested.flat(rows, "rec_id", nested.ROOT, ["params.q"]).select("rec_id", F.lit("q").alias("child"), none.alias("parent_pos"), F.lit(0).cast("bigint").alias("pos"), F.col("params_q").alias("value"))
    place = nested.flat(rows, "rec_id", "local_results", ["title"]).filter("via = 'response.local_results'").select("rec_id", F.lit("place").alias("child"), none.alias("parent_pos"), "pos", F.col("title").alias("value"))
    extension = nested.children(rows, "rec_id", "extensions", "jobs_results", "response.jobs_results").select("rec_id", F.lit("extension").alias("child"), "parent_pos", "pos", "value")
    return q.unionByName(place).unionByName(extension).filter(F.col("value").isNotNull()).distinct()


def _flat(name: str, columns: list[str]):
    def query(spark, sf_dir: str) -> DataFrame:
        return nested.flat(_recordings(spark, sf_dir), "rec_id", name, columns)

    query.__doc__ = f"The flat table {name or 'of searches'} of all recordings."
    return query


p7_searches = _flat(nested.ROOT, ["engine", "recordedAt", "params.q", "params.location", "params.place_id"])
p7_listings = _flat("jobs_results", ["title", "company_name", "location", "detected_extensions.salary", "description"])
p7_extensions = _flat("extensions", [])
p7_places = _flat("local_results", ["title", "place_id", "type", "address", "rating double", "reviews bigint"])


def _stated(frames):
    import pandas as pd

    for f in frames:
        out = []
        for src, key, pay, text, more in zip(f["src"], f["rec_id"], f["pay"], f["text"], f["more"]):
            got = units.offer(pay, text) if src == "offer" else units.listing(pay, more, text)
            if got:
                out.append((src, key, *([getattr(s, c) for s in got] for c in ("low", "high", "scale", "period")), units.log_amount(got)))
        yield pd.DataFrame(out, columns=["src", "rec_id", "low", "high", "scale", "period", "amount"])


def _pays(spark, sf_dir: str) -> DataFrame:
    """Pay of every message and listing that states one; a record delivered twice counts once.

    What the records say is read and stored first; the usual level is the mean of what leaves nothing open.
    """
    offers = table(spark, sf_dir, "offers", "offer_id", "pay_raw", "source_text").select(F.lit("offer").alias("src"), F.col("offer_id").alias("rec_id"), F.col("pay_raw").alias("pay"), F.col("source_text").alias("text"), F.lit(None).cast("array<string>").alias("more"))
    listings = table(spark, sf_dir, "job_listings", "listing_id", "detected_extensions", "extensions", "description").select(F.lit("listing").alias("src"), F.col("listing_id").alias("rec_id"), F.col("detected_extensions.salary").alias("pay"), F.col("description").alias("text"), F.col("extensions").alias("more"))
    schema = "src string, rec_id bigint, low array<double>, high array<double>, scale array<string>, period array<string>, amount double"
    said = stored(spread(offers).unionByName(spread(listings)).mapInPandas(_stated, schema))
    level, deviation, n = said.agg(F.avg("amount"), F.stddev_pop("amount"), F.count("amount")).first()
    usual = (level, max(deviation, 0.1)) if n > 1 else (units.LEVEL, units.SPREAD)

    def solve(frames):
        import pandas as pd

        for f in frames:
            out = [(src, key, *units.solve([units.Stated(*s) for s in zip(*columns)], *usual)) for src, key, *columns in zip(f["src"], f["rec_id"], f["low"], f["high"], f["scale"], f["period"])]
            yield pd.DataFrame(out, columns=["src", "rec_id", "low_inr", "high_inr", "is_unique"])

    return said.drop("amount").mapInPandas(solve, "src string, rec_id bigint, low_inr bigint, high_inr bigint, is_unique boolean").distinct()


def p2_found(spark, sf_dir: str) -> DataFrame:
    """(src, rec_id, low_inr, high_inr): pay in whole rupees per month."""
    return _pays(spark, sf_dir).select("src", "rec_id", "low_inr", "high_inr")


def p2_not_unique(spark, sf_dir: str) -> DataFrame:
    """(src, rec_id, low_inr, high_inr) of the records whose units have more than one solution."""
    return _pays(spark, sf_dir).filter(~F.col("is_unique")).select("src", "rec_id", "low_inr", "high_inr")


def _open(x: str) -> str:
    """A member, or what it holds if it is a string with an object or a list in it."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') AND json_type(CAST({x} ->> '$' AS JSON)) IN ('OBJECT', 'ARRAY') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"


def _entries(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) ELSE [{x}] END"


def _value(x: str) -> str:
    return f"CASE WHEN json_type({x}) <> 'NULL' THEN {x} ->> '$' END"


_RECORDS = (
    f"WITH b AS (SELECT DISTINCT rec_id, {_open('CAST(body AS JSON)')} AS b FROM recordings WHERE json_valid(body)), "
    f"r AS (SELECT rec_id, b, {_open('(b -> $$params$$)')} AS p, {_open('(b -> $$response$$)')} AS r FROM b WHERE json_type(b) = 'OBJECT'), "
    f"j AS (SELECT rec_id, {_open('(r -> $$jobs_results$$)')} AS j, {_open('(r -> $$local_results$$)')} AS l FROM r), "
    f"jr AS (SELECT rec_id, unnest({_entries('j')}) AS e, unnest(generate_series(0, len({_entries('j')}) - 1)) AS pos FROM j), "
    f"lr AS (SELECT rec_id, unnest({_entries('l')}) AS e, unnest(generate_series(0, len({_entries('l')}) - 1)) AS pos FROM j), "
    f"jo AS (SELECT rec_id, pos, {_open('e')} AS e FROM jr), lo AS (SELECT rec_id, pos, {_open('e')} AS e FROM lr), "
    f"x AS (SELECT rec_id, pos AS parent_pos, {_open('(e -> $$extensions$$)')} AS x FROM jo), "
    f"xr AS (SELECT rec_id, parent_pos, unnest({_entries('x')}) AS e, unnest(generate_series(0, len({_entries('x')}) - 1)) AS pos FROM x)"
)
SQL = {
    "p7_found": _RECORDS + f" SELECT rec_id, 'q' AS child, -1 AS parent_pos, 0 AS pos, {_value('(p -> $$q$$)')} AS value FROM r WHERE {_value('(p -> $$q$$)')} IS NOT NULL "
    f"UNION ALL SELECT rec_id, 'place', -1, pos, {_value('(e -> $$title$$)')} FROM lo WHERE {_value('(e -> $$title$$)')} IS NOT NULL "
    f"UNION ALL SELECT rec_id, 'extension', parent_pos, pos, {_value('e')} FROM xr WHERE {_value('e')} IS NOT NULL",
}


def p2_benchmark(spark, sf_dir: str) -> DataFrame:
    """(title, listings, found, median_pay): exact median of the middle of each listing's pay, by title."""
    from evidencia.functions.benchmark import benchmark

    pays = _pays(spark, sf_dir).filter("src = 'listing'").select(F.col("rec_id").alias("listing_id"), ((F.col("low_inr") + F.col("high_inr")) / 2).alias("pay"))
    titles = table(spark, sf_dir, "job_listings", "listing_id", "title").distinct()
    return benchmark(titles.join(pays, "listing_id", "left"), ["title"], "pay")
