"""Freely typed places brought to a reference list (problem 1).

Every run of words in a value is looked up in a BK-tree over the list's names under a true edit metric; the longest
name met with the fewest errors is meant, the state beside it decides between entries of one name.  A list of more
than one tree is cut into shards: each gives every name within the distance, and what the shards found is decided on
together, so that the size of a shard changes nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.llm.bktree import Tree
from evidencia.runtime import dealt, table

#: Entries in one tree, and distinct values in a block; a longer list is never held in one place.
SHARD, BLOCK = 20_000, 200_000
# fixed values: words that stand beside a place and are no part of its name
BESIDE = frozenset("near sector road railway station branch city office hq wfo on site india state district town area the in at opp opposite behind street lane nagar plot flat".split())


def letters(text: str) -> list[str]:
    """The words of a value: letters only, case and accents folded."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not (unicodedata.combining(c) and ord(c) < 0x370))
    return re.findall(r"[^\W\d_]+", text)


def allowed(length: int) -> int:
    """Typing errors that are believed in a name of this length."""
    return 0 if length < 4 else 1 if length < 6 else 2


class Gazetteer:
    """entries: (id, name, state, former name).  Ids are positive; of equal entries the least is meant."""

    def __init__(self, entries: list[tuple]):
        names: dict[str, set[tuple[int, str]]] = {}
        states: dict[str, str] = {}
        for key, city, state, former in entries:
            own = "".join(letters(state or ""))
            if own:
                states[own] = own
            for name in (city, former):
                joined = "".join(letters(name or ""))
                if joined:
                    names.setdefault(joined, set()).add((key, own))
        self.names, self.states = names, states
        self.short = {}
        initials = {"".join(w[0] for w in letters(s)): "".join(letters(s)) for _, _, s, _ in entries if len(letters(s or "")) > 1}
        for own in states:  # two letters: initials, or the first letter and a later one
            for c in own[1:]:
                self.short.setdefault(own[0] + c, set()).add(own)
        for k, own in initials.items():
            self.short.setdefault(k, set()).add(own)
        words = list(dict.fromkeys([*names, *states]))
        self.tree = Tree(words)
        self.known: dict[str, list[tuple[int, str]]] = {w: [(0, w)] for w in words}
        self.least = min((len(w) for w in words), default=0)
        self.most = max((len(w) for w in words), default=0)

    def runs(self, value: str) -> list[tuple[int, int, str]]:
        """(from, to, joined letters) of the runs of words that may be a name."""
        words = letters(value)
        out = []
        for a in range(len(words)):
            joined = ""
            for b in range(a, len(words)):  # a name has any number of words, but no more letters than the longest
                joined += words[b]
                if len(joined) > self.most + 2:
                    break
                if len(joined) >= max(4, self.least - 2) and not (b == a and joined in BESIDE):
                    out.append((a, b + 1, joined))
        return out

    def learn(self, values: list[str]) -> None:
        """Looks up all runs of some values that are not known yet, in one walk of the tree."""
        new = list(dict.fromkeys(j for v in values for _, _, j in self.runs(v) if j not in self.known))
        hits = self.tree.find(new, np.array([allowed(len(w)) for w in new], np.int64))
        if len(self.known) + len(new) > 500_000:
            self.known = {w: [(0, w)] for w in self.tree.words}
        for w, found in zip(new, hits):
            self.known[w] = sorted((d, self.tree.words[k]) for d, k in found)

    def hits(self, value: str) -> list[tuple]:
        """All that the entries say about a value: (kind, name or word's place, score, -errors, id, state).

        Kind 's' is a state met, 'w' a state that a word of two letters may stand for, 'c' an entry.  ``learn`` has
        seen the value.
        """
        out: list[tuple] = []
        for _, _, joined in self.runs(value):
            for d, name in self.known.get(joined, ()):
                if name in self.states and d <= 1 + (len(name) > 9):
                    out.append(("s", name, len(name) - 3 * d, -d, 0, name))
                out += [("c", name, len(name) - 3 * d, -d, key, own) for key, own in self.names.get(name, ())]
        for place, w in enumerate(letters(value)):
            if len(w) == 2:
                out += [("w", str(place), 0, 0, 0, own) for own in self.short.get(w, ())]
        return list(dict.fromkeys(out))


def meant(hits: list[tuple]) -> int:
    """The id of the entry that all hits of a value mean, or 0; their order does not matter."""
    states, words, cities = {}, {}, {}
    for kind, name, score, near, key, own in hits:
        if kind == "s":
            states[name] = max(score, states.get(name, score))
        elif kind == "w":
            words.setdefault(int(name), set()).add(own)
        else:
            cities.setdefault((score, near, name), set()).add((key, own))
    within = {max(states, key=lambda s: (states[s], s))} if states else set()
    if not within:
        within = next((own for _, own in sorted(words.items(), reverse=True) if len(own) == 1), set())
    best: tuple | None = None
    for (score, near, _), own in cities.items():
        fits = {k for k, s in own if s in within} if within else {k for k, _ in own}
        if not fits or len({s for k, s in own if k in fits}) > 1:
            continue
        rank = (score, near, -min(fits))
        if best is None or rank > best:
            best = rank
    return -best[2] if best else 0


HITS = ["kind", "name", "score", "near", "id", "state"]


def _hits(places: Gazetteer, given: list[str]) -> list[tuple]:
    places.learn(given)
    return [(v, *h) for v in given for h in places.hits(v) or [(None,) * len(HITS)]]


def to_list(values: DataFrame, value: str, entries: DataFrame, columns: tuple[str, str, str, str] = ("city_id", "city", "state", "former_name"), shard: int = SHARD) -> DataFrame:
    """(value, city_id) for every distinct non-null value; city_id is 0 where no entry is meant.

    Values are met once however many rows have them.  A list of up to ``shard`` entries is one tree in each worker; of
    a longer one, each shard meets each block of values in a group of its own, and the hits of all shards are decided
    on together, so the driver never holds the list and results are those of one tree.  A value naming a state never
    goes to an entry of another one; a name that stands in several states, typed without any, decides nothing and
    gives 0, as does a value without letters.  Null ids and names in the list are passed over.
    """
    key, *names = columns
    listed = entries.filter(F.col(key).isNotNull() & F.col(names[0]).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(columns, ("id", "city", "state", "former"))])
    shards = -(-listed.count() // shard) or 1
    distinct = values.select(F.col(value).alias("value")).filter("value is not null").distinct()
    if shards == 1:
        own = [tuple(r) for r in listed.collect()]  # at most ``shard`` entries

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            places = Gazetteer(own)
            for f in frames:
                given = f["value"].tolist()
                places.learn(given)
                yield pd.DataFrame([(v, meant(places.hits(v))) for v in given], columns=["value", "city_id"])

        return dealt(distinct).mapInPandas(look, "value string, city_id bigint").select(F.col("value").alias(value), "city_id")

    blocks = -(-distinct.count() // BLOCK) or 1
    sequence = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = listed.withColumn("shard", F.pmod(F.xxhash64("city"), F.lit(shards)).cast("int")).withColumn("block", sequence(blocks))
    right = distinct.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")).withColumn("shard", sequence(shards))

    def meet(some: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        places = Gazetteer(list(some[["id", "city", "state", "former"]].itertuples(index=False, name=None)))
        return pd.DataFrame(_hits(places, given["value"].tolist()), columns=["value", *HITS]).astype({c: "Int64" for c in ("score", "near", "id")})

    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, "value string, kind string, name string, score bigint, near bigint, id bigint, state string")
    # a value has as many hits as there are names near its own runs of words
    every = met.groupBy("value").agg(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(*HITS))).alias("hits"))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"value": f["value"], "city_id": [meant([tuple(h[c] for c in HITS) for h in hits]) for hits in f["hits"]]})

    return every.mapInPandas(decide, "value string, city_id bigint").select(F.col("value").alias(value), "city_id")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """(src, rec_id, city_id): the entry of every place that is not typed as it stands in the list, 0 if none is meant."""
    offers = table(spark, sf_dir, "offers", "offer_id", "city").select(F.lit("offer").alias("src"), F.col("offer_id").alias("rec_id"), F.col("city").alias("value"))
    listings = table(spark, sf_dir, "job_listings", "listing_id", "location").select(F.lit("listing").alias("src"), F.col("listing_id").alias("rec_id"), F.col("location").alias("value"))
    cities = table(spark, sf_dir, "city_list", "city_id", "city", "state", "former_name")
    once = cities.groupBy("city").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("city").alias("value"))
    clean = once.unionByName(cities.select(F.concat_ws(", ", "city", "state").alias("value"))).distinct()
    rows = offers.unionByName(listings).filter(F.col("value").rlike(r"\p{L}")).join(clean, "value", "left_anti")
    found = to_list(rows, "value", cities)
    return rows.join(found, "value").select("src", "rec_id", "city_id").distinct()
