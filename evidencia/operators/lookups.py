"""Latest per key, earliest copy, time-to-live cache: lookups over histories without collecting a key's rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencia.functions.text import normalised, search_name


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key the row that is last by ``order``: an aggregate with partial results, so a hot key is no problem."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in columns])


def first_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """For each key the row that is first by ``order``, e.g. (does not meet the preference, position)."""
    best = F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in columns])


def fingerprint(company: Column, parts: list[Column]) -> Column:
    """16 hexadecimal digits over the normalised parts; a missing part is an empty one, and null company gives null.

    ``array_join`` over coalesced parts keeps an absent part's place, which ``concat_ws`` would drop.
    """
    own = [normalised(search_name(company)), *[F.coalesce(normalised(p), F.lit("")) for p in parts]]
    return F.when(company.isNotNull(), F.concat(F.lit("sha256:"), F.substring(F.sha2(F.array_join(F.array(*own), "|"), 256), 1, 16)))


def earliest_copy(df: DataFrame, key: str, print_: str, order: list[str]) -> DataFrame:
    """(key, print, same_as): the first row with the same fingerprint, null for that row itself and for null prints.

    Rows without a value to order by come last.
    """
    ranks = [x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    first = df.filter(F.col(print_).isNotNull()).groupBy(print_).agg(F.min_by(key, F.struct(*ranks, key)).alias("_first"))
    return df.join(first, print_, "left").select(key, print_, F.when(F.col("_first") != F.col(key), F.col("_first")).alias("same_as"))


def cache_hits(df: DataFrame, key: str, at: str, ident: str, ttl_s: int = 86_400) -> DataFrame:
    """(ident, key, hit): whether a request finds an answer stored less than ``ttl_s`` ago.

    The age counts from when the answer was stored, and a hit does not extend it, so the fold is sequential per key.
    Rows stream through it in order, and one stored time per task is all the state: no key's rows are collected.
    Rows with a null time or key are misses and store nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, stored = None, None
        for f in frames:
            out = []
            for k, t in zip(f[key], f["_t"]):
                if k is None or pd.isna(t):
                    out.append(False)
                    continue
                hit = k == last and stored is not None and t - stored < ttl_s * 1_000_000
                if not hit:
                    last, stored = k, t
                out.append(hit)
            yield pd.DataFrame({ident: f[ident], key: f[key], "hit": out})

    rows = df.select(ident, key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).repartition(F.col(key)).sortWithinPartitions(key, "_t", ident)
    return rows.mapInPandas(run, f"{ident} {kinds[ident]}, {key} {kinds[key]}, hit boolean")


def case_parts(monthly: Column, fee: Column, fee_asked: Column, contacts: Column) -> list[Column]:
    """Further parts of a fingerprint: pay a month, the fee (`asked` without an amount), contacts in order.

    An offer at another pay or fee, or with other contacts, is another message.
    """
    return [monthly.cast("string"), F.coalesce(fee.cast("string"), F.when(fee_asked, F.lit("asked"))), F.array_join(F.array_sort(F.array_distinct(contacts)), " ")]


def revised(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` after updates that each name the revision they saw: (key, revision, columns, accepted).

    An update holds only if the revision it saw is still the current one; of several, the first by ``at`` does, since the
    others saw a revision that is no more.  ``accepted`` tells whether the key changed.
    """
    seen = updates.select(key, F.col("revision").alias("_seen"), "at", *[F.col(c).alias(f"_{c}") for c in columns])
    met = seen.join(current.select(key, F.col("revision").alias("_seen")), [key, "_seen"])
    best = met.groupBy(key).agg(F.min_by(F.struct(*[f"_{c}" for c in columns]), F.struct("at", *[f"_{c}" for c in columns])).alias("_new"))
    joined = current.join(best, key, "left")
    taken = F.col("_new").isNotNull()
    return joined.select(key, (F.col("revision") + taken.cast("int")).alias("revision"), *[F.when(taken, F.col("_new")[f"_{c}"]).otherwise(F.col(c)).alias(c) for c in columns], taken.alias("accepted"))


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of two traces that differ, with how often each stands in the first and the second: nothing if they agree."""
    columns = one.columns
    both = one.withColumn("_side", F.lit(0)).unionByName(two.select(*columns).withColumn("_side", F.lit(1)))
    counted = both.groupBy(*columns).agg(F.count_if(F.col("_side") == 0).alias("in_one"), F.count_if(F.col("_side") == 1).alias("in_two"))
    return counted.filter("in_one <> in_two")


def in_order(cases: DataFrame, opened: str, status: str | None = None) -> DataFrame:
    """Cases as they were opened, all or those of one status; a snapshot, since it reads one version of its table."""
    own = cases if status is None else cases.filter(F.col("status") == status)
    return own.orderBy(opened)
