"""Near-duplicate records by Bayesian candidate pruning over MinHash values (problem 6).

Rows whose shingle sets are equal become one class first.  Bands of MinHash values propose pairs of classes; further
MinHash values of a pair are compared block by block, and the pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below a tolerance.  What is left is verified on the shingle sets.

Signatures are stored, shingle sets are not: they are made again from the texts of those classes only that a
candidate pair or a crowd names.  Buckets of one class, nearly all, are recognised by a filter of fixed size before
their rows are moved.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.llm.bits import knows, words_of
from evidencia.operators.components import components
from evidencia.runtime import spread, stored, table

#: MinHash values in a band, and the chance that all bands miss a pair just at the threshold.
ROWS, MISS = 8, 1.2e-3
#: MinHash values, of 8 bits each, that the pruning compares, and how many at a time.
CHECKS, BLOCK = 128, 16
TOLERANCE = 1e-4
#: A bucket of more classes is compared block by block instead of by pairs of rows.
FEW = 24
#: Classes of a block, bytes of their shingles and band values, and shingles that one matrix product takes.
MOST, BYTES, SLICE = 1024, 4 << 20, 2048
#: Signatures that a Python worker remembers, so that copies are signed once.
REMEMBER = 5_000


def bands_for(threshold: float) -> int:
    """As many bands as MISS allows."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(threshold, 0.999999) ** ROWS)))


@functools.lru_cache(maxsize=200_000)
def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit digests of the distinct runs of ``width`` words, lower case; none if there are fewer words."""
    words = (text or "").lower().split()
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h = np.array([_word(w) for w in words], np.uint64)
    mixed = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@functools.lru_cache(maxsize=4)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def minhash(sh: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values of 32 bits; long sets are taken in blocks that a core's cache holds."""
    mul, add = _functions(count)
    short = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    low = np.full(count, np.uint32(2**32 - 1))
    for k in range(0, len(short), 128):
        low = np.minimum(low, (short[k : k + 128, None] * mul + add).min(axis=0))
    return low


def buckets(values: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit number for each band's values, the band's place mixed in."""
    rows = values.reshape(bands, -1).astype(np.uint64)
    h = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of values compared, the fewest matches with which a pair stays.

    The prior of the similarity s is uniform; a value of 8 bits matches with probability s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(BLOCK, CHECKS + 1, BLOCK):
        m = 0
        while m <= n:
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p * (1 - 1e-12)) - n * math.log(0.5))
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of signature rows stay after all blocks; each block looks at the pairs left only."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        cols = slice(k * BLOCK, (k + 1) * BLOCK)
        matches[left] += (a[left, cols] == b[left, cols]).sum(axis=1)
        left = left[matches[left] >= least]
    return left


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null"))


def _signed(width: int, bands: int, kind: str):
    """(key, same, bands, sig) of texts: the digest of the shingle set, the bands' buckets, the values for pruning."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple] = {}
        for f in frames:
            out = []
            for key, text in zip(f["key"], f["text"]):
                sh = shingles(text, width)
                if not len(sh):
                    continue
                same = xxhash.xxh3_128_digest(sh.tobytes())
                got = known.get(same)
                if got is None:
                    m = minhash(sh, bands * ROWS + CHECKS)
                    got = buckets(m[: bands * ROWS], bands), (m[bands * ROWS :] & np.uint32(255)).astype(np.uint8).tobytes()
                    known = {} if len(known) >= REMEMBER else known
                    known[same] = got
                out.append((key, same, *got))
            yield pd.DataFrame(out, columns=["key", "same", "bands", "sig"])

    return run, f"key {kind}, same binary, bands array<bigint>, sig binary"


def _sets(width: int, kind: str, whole: bool):
    """(key, same, sh) of texts without signing them; the set itself only if ``whole``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(k, shingles(t, width).tobytes()) for k, t in zip(f["key"], f["text"])]
            yield pd.DataFrame([(k, xxhash.xxh3_128_digest(d), d if whole else None) for k, d in made if d], columns=["key", "same", "sh"])

    return run, f"key {kind}, same binary, sh binary"


def _met(signed: DataFrame, kind: str) -> DataFrame:
    """(bucket, id, n) of the buckets that n > 1 classes share."""
    shared = signed.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    known = signed.sparkSession.sparkContext.broadcast(words_of(shared, "bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            each = np.diff(lists.offsets.to_numpy())
            bucket = lists.flatten().to_numpy()
            at = pa.array(np.flatnonzero(knows(known.value, bucket)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket).take(at), batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), each))).take(at)], ["bucket", "id"])

    rows = stored(signed.select("id", "bands").mapInArrow(run, f"bucket bigint, id {kind}"))
    return rows.join(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket")


def pruned(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of class ids that the posterior leaves."""
    side = lambda n: signed.select(F.col("id").alias(n), F.col("sig").alias(f"sig_{n}"))
    kind = signed.schema["id"].dataType.simpleString()

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), CHECKS) for c in ("sig_a", "sig_b"))
                f = f.iloc[survivors(a, b, threshold)]
            yield f[["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(prune, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of class ids whose similarity is ``threshold`` or more, by their shingle sets."""
    side = lambda n: held.select(F.col("id").alias(n), F.col("sh").alias(f"sh_{n}"))
    kind = held.schema["id"].dataType.simpleString()

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y in zip(f["sh_a"], f["sh_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(exact, f"a {kind}, b {kind}")


def alike(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of shingle sets whose similarity is ``threshold`` or more, by incidence matrices."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate((n, m)))
    _, col, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    met = count[col] > 1  # a shingle of one set only is common to no pair
    row, col = row[met], (np.cumsum(count > 1) - 1)[col[met]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, SLICE):
        part = slice(*np.searchsorted(col, (k, k + SLICE)))
        has = np.zeros((len(left) + len(right), SLICE), np.float32)
        has[row[part], col[part] - k] = 1
        both += has[: len(left)] @ has[len(left) :].T
    both = both.astype(np.int64)
    return np.nonzero(both >= threshold * (n[:, None] + m - both))


def crowded(crowd: DataFrame, signed: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), a < b, of the rows (bucket, id) that share a bucket and are alike, each once.

    The classes of a bucket are dealt into blocks, and each two blocks meet in one group, so that no group holds more
    than two blocks.  A pair is given by the first of the buckets it shares.
    """
    kind = signed.schema["id"].dataType.simpleString()
    sized = crowd.join(held.select("id", (F.octet_length("sh") + 8 * bands_for(threshold)).alias("size")), "id")
    parts = sized.groupBy("bucket").agg(F.greatest(F.ceil(F.sum("size") / BYTES), F.ceil(F.count("*") / MOST)).alias("parts"))
    rows = crowd.join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = rows.select("bucket", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        bucket, lo, hi = f["bucket"].iloc[0], f["lo"].iloc[0], f["hi"].iloc[0]
        one, two = f[f["own"] == lo], f[f["own"] == hi]
        x, y = ([np.frombuffer(d, np.uint64) for d in side["sh"]] for side in (one, two))
        i, j = alike(x, y, threshold) if x and y else (np.zeros(0, np.int64),) * 2
        if lo == hi:
            i, j = i[i < j], j[i < j]
        out = []
        if len(i):
            u, v = np.stack(one["bands"].to_list()), np.stack(two["bands"].to_list())
            for k in range(0, len(i), 1 << 15):
                p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                first = (u[p] == v[q]).argmax(axis=1)
                mine = u[p, first] == bucket
                a, b = one["id"].to_numpy()[p[mine]], two["id"].to_numpy()[q[mine]]
                out.append(pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a)}))
        return pd.concat(out) if out else pd.DataFrame({"a": f["id"].iloc[:0], "b": f["id"].iloc[:0]})

    found = rows.join(signed.select("id", "bands"), "id").join(held, "id").groupBy("bucket", "lo", "hi").applyInPandas(run, f"a {kind}, b {kind}")
    return found.filter("a <> b")


def links(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Returns (members, links): members(key, id) with the class of each row, links(a, b) of classes, a < b.

    A class is the rows of equal shingle sets, named by the least key; a key with several texts is linked by any of
    them.  Rows with a null key, and texts of fewer than ``width`` words (null and empty ones too), take no part.  All pairs of classes that share a bucket are compared:
    buckets of up to FEW classes give their pairs, those of larger ones are compared exactly, block by block.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _rows(df, key, text)
    classes = rows.mapInPandas(*_signed(width, bands_for(threshold), kind)).groupBy("same").agg(F.min("key").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    signed = stored(classes)
    members = rows.mapInPandas(*_sets(width, kind, False)).join(signed.select("same", "id"), "same").select("key", "id").distinct()

    met = stored(_met(signed, kind))
    few, crowd = met.filter(F.col("n") <= FEW), stored(met.filter(F.col("n") > FEW).select("bucket", "id"))
    other = few.select("bucket", F.col("id").alias("b"))
    pairs = few.select("bucket", F.col("id").alias("a")).join(other, "bucket").filter("a < b").select("a", "b").distinct()
    left = stored(pruned(pairs, signed, threshold).distinct())
    ids = left.select(F.explode(F.array("a", "b")).alias("key")).unionByName(crowd.select(F.col("id").alias("key"))).distinct()
    wanted = ids.join(signed.select(F.col("id").alias("key"), "same"), "key")
    held = rows.join(ids, "key").mapInPandas(*_sets(width, kind, True)).join(wanted, ["key", "same"]).dropDuplicates(["key", "same"])
    held = stored(held.select(F.col("key").alias("id"), "sh"))
    found = verified(left, held, threshold).unionByName(crowded(crowd, signed, held, threshold))
    return members, found.distinct()


def groups(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, group, links): of every row that takes part, its group's least key and the links of its class."""
    members, found = links(df, key, text, width, threshold)
    members, found = stored(members), stored(found)
    comp = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    out = members.join(comp.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    return out.select(F.col("key").alias(key), F.coalesce("comp", "id").alias("group"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """(offer_a, offer_b), offer_a < offer_b: all pairs of each group of forwarded messages."""
    g = stored(groups(table(spark, sf_dir, "offers", "offer_id", "source_text"), "offer_id", "source_text", width=2, threshold=0.75))
    a, b = g.select("group", F.col("offer_id").alias("offer_a")), g.select("group", F.col("offer_id").alias("offer_b"))
    return a.join(b, "group").filter("offer_a < offer_b").select("offer_a", "offer_b")


def p6_groups(spark, sf_dir: str) -> DataFrame:
    """(offer_id, group, links): one row for each message."""
    return groups(table(spark, sf_dir, "offers", "offer_id", "source_text"), "offer_id", "source_text", width=2, threshold=0.75)


def p6_documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id, group, links): documents alike in five-word runs to 0.8 or more."""
    return groups(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _sql(name: str, key: str, text: str, width: int, threshold: float) -> str:
    """The same without MinHash: all pairs of classes that share a run of words, their components, by a recursive query."""
    run = " || ' ' || ".join(f"t[i + {k}]" for k in range(width))
    blank = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return (
        f"WITH RECURSIVE t AS (SELECT DISTINCT {key} AS id, string_split(trim(regexp_replace(lower({text}), '{blank}', ' ', 'g')), ' ') AS t FROM {name} WHERE {text} IS NOT NULL), "
        f"g AS (SELECT DISTINCT id, hash({run}) AS g FROM (SELECT id, t, unnest(generate_series(1, len(t) - {width - 1})) AS i FROM t WHERE len(t) >= {width})), "
        "n AS (SELECT id, count(*) AS n, sum(g) AS s1, bit_xor(g) AS s2 FROM g GROUP BY id), k AS (SELECT id, n, min(id) OVER (PARTITION BY n, s1, s2) AS cls FROM n), "
        "c AS (SELECT id, n FROM k WHERE id = cls), e AS (SELECT g.id, g.g FROM g JOIN c USING (id)), p AS (SELECT a.id AS a, b.id AS b, count(*) AS x FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id), "
        f"l AS (SELECT a, b FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE x >= {threshold} * (ca.n + cb.n - x)), "
        "y AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT id AS u, id AS top FROM c UNION SELECT y.v, r.top FROM r JOIN y ON y.u = r.u WHERE r.top < y.v), "
        "f AS (SELECT u, min(top) AS top FROM r GROUP BY u)"
    )


_MEMBERS = ' SELECT k.id AS {0}, f.top AS "group", CAST((SELECT count(*) FROM y WHERE y.u = k.cls) AS BIGINT) AS links FROM k JOIN f ON f.u = k.cls'
SQL = {
    "p6_found": _sql("offers", "offer_id", "source_text", 2, 0.75) + ", q AS (SELECT k.id, f.top FROM k JOIN f ON f.u = k.cls) SELECT a.id AS offer_a, b.id AS offer_b FROM q a JOIN q b ON a.top = b.top AND a.id < b.id",
    "p6_groups": _sql("offers", "offer_id", "source_text", 2, 0.75) + _MEMBERS.format("offer_id"),
    "p6_documents": _sql("documents", "doc_id", "text", 5, 0.8) + _MEMBERS.format("doc_id"),
}
