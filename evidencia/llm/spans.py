"""Long exact spans shared between records, by content-defined chunking with a gear hash (problem 10).

Chunk starts are the places whose gear hash is the least among its neighbours, so any ``stride`` places in a row hold
one, and a stretch that stands in two texts has the same starts in both, however far it was shifted.  From each start
a digest covers ``least - stride + 1`` characters: a common stretch of ``least`` characters holds at least one such
piece whole.  A first scan sends the digests; those met in two texts set a bit in a filter of fixed size, and a second
scan sends only the places that the filter knows.  Pieces of few texts are decided on by the texts themselves; for
those of many, each window of ``least`` characters is named by 128 bits, and a pair of texts is given at the first
window of what they have in common and nowhere else, so a long passage in many texts costs no more than its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.llm.bits import knows, words_of
from evidencia.llm.gear import GEAR
from evidencia.runtime import spread, stored, table

LEAST = 300
STRIDE = 101
#: Characters a gear hash depends on.
REACH = 8
#: Up to so many texts, those with a common piece are compared pair by pair; beyond, by the digests of their windows.
FEW = 12
#: Multipliers of two digests, each with its inverse modulo 2**64, and what spreads a character.
BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (6364136223846793005, 3202034522624059733))
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(points: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Places whose gear hash is the least of the ``stride`` around some window of that length, rightmost on ties."""
    n = len(points)
    if n < stride:
        return np.zeros(0, np.int64)
    h = GEAR[(points ^ (points >> np.uint32(8))) & np.uint32(255)]
    step = 1
    while step < REACH:  # the hash looks ahead: place i depends on REACH characters from i on
        ahead = np.zeros_like(h)
        ahead[:-step] = h[step:] << np.uint32(step)
        h = h + ahead
        step *= 2
    h = (h * np.uint32(2654435761)) ^ (h >> np.uint32(15))
    # low half: the place, counted down, so that the rightmost of equal hashes is least
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    low, span = key, 1
    while span * 2 <= stride:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = stride - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return np.unique((np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64))


class Prefix:
    """Digests of any stretch of one text from prefix sums modulo 2**64."""

    def __init__(self, points: np.ndarray, kind: int = 0):
        n, (base, inverse) = len(points), BASES[kind]
        x = (points.astype(np.uint64) + np.uint64(1 + kind)) * _UNIT
        x ^= x >> np.uint64(29)
        down = np.cumprod(np.full(n + 1, np.uint64(inverse)))
        self.up = np.cumprod(np.full(n + 1, np.uint64(base)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * down[:n])))

    def digests(self, at: np.ndarray, length: int) -> np.ndarray:
        return ((self.sums[at + length] - self.sums[at]) * self.up[at]).view(np.int64)


def pieces(text: str, least: int = LEAST, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places and digests of all pieces of a text, by place."""
    none = np.zeros(0, np.int64)
    if text is None or len(text) < least:
        return none, none
    points = code_points(text)
    length = least - stride + 1
    at = starts(points, stride)
    at = at[at + length <= len(points)]
    return at, Prefix(points).digests(at, length)


def again(digests: np.ndarray) -> np.ndarray:
    """Which digests stand earlier in the array too."""
    out = np.ones(len(digests), bool)
    out[np.unique(digests, return_index=True)[1]] = False
    return out


def windows(points: np.ndarray, near: np.ndarray, least: int = LEAST, stride: int = STRIDE) -> np.ndarray:
    """Places of all stretches of ``least`` characters that hold a piece starting at one of ``near``."""
    count = len(points) - least + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    mark = np.zeros(count + 1, np.int64)
    np.add.at(mark, np.clip(near - stride + 1, 0, count), 1)
    np.add.at(mark, np.clip(near + 1, 0, count), -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def stand_in(a: np.ndarray, b: np.ndarray, in_a: tuple[np.ndarray, np.ndarray], in_b: tuple[np.ndarray, np.ndarray], least: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ``a`` whose windows all stand in ``b``; the texts decide, not the digests."""
    (at, digest), (other, theirs) = in_a, in_b
    known, first = np.unique(theirs, return_index=True)
    if not len(known):
        return []
    k = np.minimum(np.searchsorted(known, digest), len(known) - 1)
    hit = known[k] == digest
    p, q = at[hit], other[first[k[hit]]]
    out: list[tuple[int, int]] = []
    # windows one after the other in both texts are compared as one stretch
    for x, y in zip(*(np.split(v, np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1) for v in (p, q))):
        if not len(x):
            continue
        if np.array_equal(a[x[0] : x[-1] + least], b[y[0] : y[-1] + least]):
            stretches = [(int(x[0]), int(x[-1]) + least)]
        else:
            stretches = [(int(i), int(i) + least) for i, j in zip(x, y) if np.array_equal(a[i : i + least], b[j : j + least])]
        for begin, end in stretches:
            if out and begin <= out[-1][1]:
                begin, end = out.pop()[0], end
            out.append((begin, end))
    return out


def compare(text_a: str, text_b: str, near_a: np.ndarray, near_b: np.ndarray, least: int = LEAST, stride: int = STRIDE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches of each text that stand in the other, among the windows around the places; linear in the texts."""
    a, b = code_points(text_a), code_points(text_b)
    in_a, in_b = ((at, Prefix(p).digests(at, least)) for p, at in ((a, windows(a, near_a, least, stride)), (b, windows(b, near_b, least, stride))))
    return stand_in(a, b, in_a, in_b, least), stand_in(b, a, in_b, in_a, least)


def _emit(least: int, stride: int, kind: str, known):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, at, digests, more = [], [], [], []
            for key, text in zip(f["key"], f["text"]):
                p, d = pieces(text, least, stride)
                if known is not None:
                    met = knows(known.value, d)
                    p, d = p[met], d[met]
                keys.append(np.full(len(p), key))
                at.append(p)
                digests.append(d)
                more.append(again(d))
            if keys:
                yield pd.DataFrame({"digest": np.concatenate(digests), "key": np.concatenate(keys), "at": np.concatenate(at), "again": np.concatenate(more)})

    return run, f"digest bigint, key {kind}, at int, again boolean"


def candidates(df: DataFrame, least: int, stride: int) -> DataFrame:
    """(digest, key, at, again, docs) for all places of the pieces that stand in two or more texts, ``docs`` of them."""
    kind, rows = df.schema["key"].dataType.simpleString(), spread(df)
    met = rows.mapInPandas(*_emit(least, stride, kind, None)).groupBy("digest").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi")
    known = df.sparkSession.sparkContext.broadcast(words_of(met, "digest"))
    every = stored(rows.mapInPandas(*_emit(least, stride, kind, known)))
    shared = every.groupBy("digest").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count_if(~F.col("again")).alias("docs")).filter("lo < hi").select("digest", "docs")
    return every.join(shared, "digest")


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """The texts of ``df`` that share a stretch of ``least`` characters or more.

    Returns (pairs, cover): pairs(a, b) with a < b, each once; cover(key, begin, end) with the stretches of each text
    that stand in another text, overlapping ones not yet merged.  ``key`` should be unique; rows with a null key or
    text take no part, of rows that share a key all texts count as one record's.  The texts of pieces
    in up to FEW of them are compared pair by pair, around all places of such pieces.  Of a piece in more texts every
    window around it is named by 128 bits, so that the texts of a hot passage meet only where they agree on all
    ``least`` characters.  Texts that have a window behind the same other window met there already; those behind
    different ones are paired, class against class, so no pair is made twice for one passage.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & (F.length("text") >= least))
    met = stored(candidates(docs, least, stride), ["digest", "key", "at", "again", "docs"])

    few = met.filter(F.col("docs") <= FEW)
    one = few.filter(~F.col("again"))
    pairs = one.select("digest", F.col("key").alias("a")).join(one.select("digest", F.col("key").alias("b")), "digest").filter("a < b").select("a", "b").distinct()
    near = few.groupBy("key").agg(F.collect_list("at").alias("near")).join(docs, "key")
    side = lambda n: near.select(F.col("key").alias(n), F.col("near").alias(f"near_{n}"), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b, text_a, text_b, near_a, near_b in zip(f["a"], f["b"], f["text_a"], f["text_b"], f["near_a"], f["near_b"]):
                for key, found in zip((a, b), compare(text_a, text_b, np.asarray(near_a), np.asarray(near_b), least, stride)):
                    out += [(a, b, key, x, y) for x, y in found]
            yield pd.DataFrame(out, columns=["a", "b", "key", "begin", "end"])

    proved = both.mapInPandas(verify, f"a {kind}, b {kind}, key {kind}, begin int, end int")

    many = met.filter(F.col("docs") > FEW).groupBy("key").agg(F.collect_list("at").alias("near")).join(docs, "key")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = []
            for key, text, near in zip(f["key"], f["text"], f["near"]):
                points = code_points(text)
                at = windows(points, np.asarray(near), least, stride)
                one, two = Prefix(points).digests(at, least), Prefix(points, 1).digests(at, least)
                # the window before, if it is one of these; else a number of the text's own
                own = xxhash.xxh3_64_intdigest(repr(key).encode(), 5) - (1 << 63)
                behind = np.diff(at, prepend=-2) == 1
                parts.append(pd.DataFrame({"key": key, "at": at, "one": one, "two": two, "before": np.where(behind, np.concatenate((one[:1], one[:-1])), own), "again": again(one)}))
            if parts:
                yield pd.concat(parts)

    wide = stored(many.mapInPandas(whole, f"key {kind}, at int, one bigint, two bigint, before bigint, again boolean"))
    hot = wide.groupBy("one", "two").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("before").alias("least"), F.max("before").alias("most")).filter("lo < hi")
    agreed = wide.join(hot.select("one", "two"), ["one", "two"])
    first = wide.filter(~F.col("again")).join(hot.filter("least < most").select("one", "two"), ["one", "two"]).select("one", "two", "before", "key")
    behind = first.select("one", "two", "before").distinct()
    met_at = behind.withColumnRenamed("before", "x").join(behind.withColumnRenamed("before", "y"), ["one", "two"]).filter("x < y")
    of = lambda n, c: first.select("one", "two", F.col("before").alias(c), F.col("key").alias(n))
    hot_pairs = met_at.join(of("a", "x"), ["one", "two", "x"]).join(of("b", "y"), ["one", "two", "y"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cover = proved.select("key", "begin", "end").unionByName(agreed.select("key", F.col("at").alias("begin"), (F.col("at") + least).alias("end")))
    return proved.select("a", "b").unionByName(hot_pairs).distinct(), cover


def p10_found(spark, sf_dir: str) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: both texts hold one same stretch of at least 300 characters."""
    pairs, _ = shared_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p10_shared(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_shared, share): characters of each text that stand in another one in stretches of 300 or more.

    A null text has null in both, an empty one 0 and null.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    _, cover = shared_spans(docs)
    # sorted intervals are merged in one fold: (end so far, characters so far)
    ordered = cover.distinct().groupBy(F.col("key").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("s"))
    fold = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["to"], x["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["begin"]))).alias("n")),
    )
    n = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))
    sized = docs.select("doc_id", F.length("text").alias("n_chars"))
    return sized.join(ordered.select("doc_id", fold["n"].alias("n")), "doc_id", "left").select("doc_id", n.alias("n_shared"), F.when(F.col("n_chars") > 0, n / F.col("n_chars")).alias("share"))


# every window of 300 characters of every text, met by its hash
_WINDOWS = (
    "WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300), "
    "w AS (SELECT doc_id, pos, hash(substring(text, pos, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS pos FROM d)), "
    "m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), s AS (SELECT doc_id, pos, h FROM w JOIN m USING (h))"
)
SQL = {
    "p10_found": _WINDOWS + " SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_shared": _WINDOWS
    + ", c AS (SELECT doc_id, sum(least(300, pos - coalesce(before, pos - 300))) AS n FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT DISTINCT doc_id, pos FROM s)) GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(coalesce(n, 0) AS BIGINT) END AS n_shared, CASE WHEN length(text) > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / length(text) END AS share FROM documents LEFT JOIN c USING (doc_id)",
}
