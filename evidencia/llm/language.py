"""Language of messages and of their stretches by Kneser-Ney character models (problem 5).

One interpolated Kneser-Ney model of characters per language is fitted on a bounded sample of labelled messages.
Since labels may be wrong, the sample's lines are first handed to the language in whose sample their n-grams have the
largest share: pairs of characters first, which all lines of a language have in common, so that a wording which stands
under wrong labels by chance moves nothing; longer ones after that, when the strange lines have left.  All models
share one sorted array of n-gram hashes per order with a column for each language, so one search gives the
probabilities under all of them.  The lowest cross-entropy per character wins.  Rejection and confidence are
calibrated on lines that the models have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencia.runtime import spread, table

ORDER = 5
#: Labelled messages of each language that a model is fitted on at most, those with the least hashes.
SAMPLE = 300
#: A label that fewer than one in so many labelled messages have is no language.
LEAST_SHARE = 1000
#: Lengths of the n-grams by whose shares the sample's lines are handed to languages, one round each.
MENDING = (2, 3, 4, 5)
#: Of the lines of a language, so many are rejected; the tail of the held-out cross-entropies gives the bound.
REJECTED = 1e-5
#: Held-out lines whose cross-entropies the tail is fitted on, the share of all.
TAIL = 0.1
#: So many times the sample's messages are expected below the hash up to which messages are ranked.
OVER = 8
#: Fewer words with letters than this are no sentence.
WORDS = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LABEL = re.compile(r"^\s*[^\W\d][^:]{0,59}:(?:\s|$)")
_LETTERS = re.compile(r"[^\W\d_]+[^\W\d_̀-ͯऀ-ॿ஀-௿]*")


def sentence(line: str) -> str | None:
    """A line as the models read it: lower case, digits alike, blanks single; None for `Label: value` and no sentence."""
    if _LABEL.match(line) or len(_LETTERS.findall(line)) < WORDS:
        return None
    return re.sub(r"\d", "0", re.sub(r"\s+", " ", line.strip().lower()))


def codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines, each behind ORDER - 1 marks and before one, and where each line's characters begin."""
    text = "".join("\x02" * (ORDER - 1) + x + "\x03" for x in lines)
    lengths = np.array([len(x) + ORDER for x in lines], np.int64)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.concatenate(([0], np.cumsum(lengths)))


def hashes(points: np.ndarray) -> list[np.ndarray]:
    """[n] holds the hash of the n characters from each place on, places near the end left out."""
    out = [np.zeros(len(points) + 1, np.uint64)]
    for n in range(1, ORDER + 1):
        m = len(points) - n + 1
        h = out[-1][:m] * _BASE + points[n - 1 : n - 1 + m] + np.uint64(1)
        out.append(h ^ (h >> np.uint64(31)))
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


class Models:
    """Interpolated Kneser-Ney models of several languages over shared sorted hash arrays."""

    def __init__(self, lines: list[list[str]]):
        """lines[k]: the sample of language k."""
        langs = len(lines)
        data = [hashes(codes(x)[0]) for x in lines]
        vocabulary = len(np.unique(np.concatenate([d[1] for d in data]))) + 1
        self.keys: list = [None] * (ORDER + 1)
        self.logp: list = [None] * (ORDER + 1)
        self.contexts: list = [None] * (ORDER + 1)
        self.backoff: list = [None] * (ORDER + 1)
        lower, lower_keys = np.full((1, langs), 1 / vocabulary), np.zeros(1, np.uint64)
        grams = []  # per order and language: distinct n-grams, their contexts, their suffixes, counts
        for n in range(1, ORDER + 1):
            per = []
            for d in data:
                if n == ORDER:
                    u, at, c = np.unique(d[n], return_index=True, return_counts=True)
                else:  # a lower order counts what stands before an n-gram, not how often it does
                    wide, at_wide = np.unique(d[n + 1], return_index=True)
                    u, first, c = np.unique(d[n][at_wide + 1], return_index=True, return_counts=True)
                    at = at_wide[first] + 1
                per.append((u, d[n - 1][at], d[n - 1][at + 1] if n > 1 else np.zeros(len(u), np.uint64), c))
            grams.append(per)
        for n, per in enumerate(grams, 1):
            keys, rep = np.unique(np.concatenate([p[0] for p in per]), return_index=True)
            context = np.concatenate([p[1] for p in per])[rep]
            suffix = np.concatenate([p[2] for p in per])[rep]
            ctx, which = np.unique(context, return_inverse=True)
            below, there = _find(lower_keys, suffix)
            p_low = np.where(there[:, None], lower[below], 1 / vocabulary)
            prob, gamma = np.empty((len(keys), langs)), np.ones((len(ctx), langs))
            for k, (u, _, _, c) in enumerate(per):
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, u)] = c
                ones, twos = int((c == 1).sum()), int((c == 2).sum())
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(which, count, len(ctx))
                kinds = np.bincount(which, count > 0, len(ctx))
                seen = total > 0
                gamma[seen, k] = d * kinds[seen] / total[seen]
                prob[:, k] = np.where(seen[which], np.maximum(count - d, 0) / np.maximum(total[which], 1), 0) + gamma[which, k] * p_low[:, k]
            self.keys[n], self.logp[n] = keys, np.log2(prob).astype(np.float32)
            self.contexts[n], self.backoff[n] = ctx, np.log2(np.maximum(gamma, 1e-12)).astype(np.float32)
            lower, lower_keys = prob, keys
        self.floor = np.float32(np.log2(1 / vocabulary))

    def entropy(self, lines: list[str]) -> np.ndarray:
        """Bits per character of each line under each language."""
        langs = self.logp[1].shape[1]
        if not lines:
            return np.zeros((0, langs), np.float32)
        points, begin = codes(lines)
        h = hashes(points)
        place = np.concatenate([np.arange(a, b - ORDER + 1) for a, b in zip(begin, begin[1:])])  # of ORDER-grams
        owner = np.repeat(np.arange(len(lines)), np.diff(begin) - ORDER + 1)
        score = np.zeros((len(place), langs), np.float32)
        left = np.arange(len(place))
        for n in range(ORDER, 0, -1):
            start = place[left] + ORDER - n
            at, there = _find(self.keys[n], h[n][start])
            score[left[there]] += self.logp[n][at[there]]
            left, start = left[~there], start[~there]
            if not len(left):
                break
            at, there = _find(self.contexts[n], h[n - 1][start])
            score[left[there]] += self.backoff[n][at[there]]
        if len(left):
            score[left] += self.floor
        sums = np.stack([np.bincount(owner, score[:, k], len(lines)) for k in range(langs)], axis=1)
        return -sums / (np.diff(begin) - ORDER + 1)[:, None]


def shares(samples: list[list[str]], lines: list[str], n: int) -> np.ndarray:
    """Mean log share of each line's n-grams in each sample."""
    points, begin = codes(lines)
    grams = hashes(points)[n]
    place = np.concatenate([np.arange(a + ORDER - 1, b - n + 1) for a, b in zip(begin, begin[1:])])
    owner = np.repeat(np.arange(len(lines)), np.diff(begin) - ORDER - n + 2)
    out = np.empty((len(lines), len(samples)))
    for k, sample in enumerate(samples):
        own, edge = codes(sample)
        inner = np.concatenate([np.arange(a + ORDER - 1, b - n + 1) for a, b in zip(edge, edge[1:])])
        keys, counts = np.unique(hashes(own)[n][inner], return_counts=True)
        at, there = _find(keys, grams[place])
        share = np.log((np.where(there, counts[at] if len(counts) else 0, 0) + 0.1) / (counts.sum() + 1))
        out[:, k] = np.bincount(owner, share, len(lines)) / np.maximum(np.bincount(owner, minlength=len(lines)), 1)
    return out


def mended(sample: list[list[str]]) -> list[list[str]]:
    """The lines of some messages, those of sample[k] labelled k, by the language they are in.

    Each round hands all lines to the language in whose lines of the round before their n-grams have the largest share.
    A language of which less than half the lines under each label is wrong keeps its own: an n-gram's share falls under
    a strange label as the share of strange lines does.
    """
    own = [[s for text in texts for s in map(sentence, text.split("\n")) if s] for texts in sample]
    lines = list(dict.fromkeys(x for part in own for x in part))
    for n in MENDING:
        if not lines:
            break
        best = shares([x or ["\x04" * ORDER] for x in own], lines, n).argmax(axis=1)
        own = [[x for x, b in zip(lines, best) if b == k] for k in range(len(own))]
    return own


def tail_bound(values: np.ndarray, beyond: float = REJECTED) -> float:
    """What a share ``beyond`` of such values exceeds, by an exponential tail fitted to the largest TAIL of them."""
    if len(values) < 2:
        return float("inf")
    ordered = np.sort(values)
    k = max(1, int(len(ordered) * TAIL))
    edge = ordered[-k - 1] if k < len(ordered) else ordered[0]
    return float(edge + max((ordered[-k:] - edge).mean(), 1e-3) * max(0.0, np.log(k / len(ordered) / beyond)))


class Languages:
    """The fitted models with each language's usual cross-entropy."""

    def __init__(self, names: list[str], sample: list[list[str]]):
        """sample[k]: messages labelled names[k]; some labels may be wrong."""
        self.names = names
        if not names:
            return
        own = mended(sample)
        # what a line costs under a model that has not seen it: the halves judge each other
        halves = [[x[i::2] for x in own] for i in (0, 1)]
        fitted = [Models([x or ["\x04"] for x in half]) for half in halves]
        held = [[fitted[1 - i].entropy(halves[i][k]) for i in (0, 1)] for k in range(len(names))]
        size = [np.array([len(x) for i in (0, 1) for x in halves[i][k]], float) for k in range(len(names))]
        held = [np.concatenate(h) if len(h[0]) + len(h[1]) else np.zeros((0, len(names))) for h in held]
        # short lines scatter more: a deviation is counted in units that fall with the root of the length
        self.mean = np.array([h[:, k].mean() if len(h) else 0.0 for k, h in enumerate(held)])
        self.bound = np.array([tail_bound((h[:, k] - self.mean[k]) * np.sqrt(s)) for k, (h, s) in enumerate(zip(held, size))])
        self.slope = self._slope(held, size)
        self.models = Models([x or ["\x04"] for x in own])

    @staticmethod
    def _slope(held: list[np.ndarray], size: list[np.ndarray]) -> float:
        """How much of a lead in bits is believed: the factor under which the held-out lines are likeliest."""
        best, least = 1.0, np.inf
        for slope in 2.0 ** -np.arange(10):
            loss = 0.0
            for k, (h, s) in enumerate(zip(held, size)):
                lead = (h - h[:, k : k + 1]) * s[:, None] * slope
                loss += np.log2(np.exp2(-np.clip(lead, -500, 500)).sum(axis=1)).sum()
            if loss < least - 1e-9:
                best, least = float(slope), loss
        return best

    def of(self, lines: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of lines as `sentence` gives them; (None, 0) where rejected."""
        e = self.models.entropy(lines)
        out = []
        for row, x in zip(e, lines):
            k = int(row.argmin())
            if (row[k] - self.mean[k]) * np.sqrt(len(x)) > self.bound[k]:
                out.append((None, 0.0))
                continue
            odds = np.exp2(-np.clip((row - row[k]) * len(x) * self.slope, 0, 500))
            out.append((self.names[k], float(1 / odds.sum())))
        return out


def fit(df: DataFrame, text: str, lang: str, sample: int = SAMPLE) -> Languages:
    """Models of all labels of ``df`` from at most ``sample`` messages each, those whose texts have the least hashes.

    A label that less than one in LEAST_SHARE labelled messages has is no language, so there are at most so many.  Only
    texts whose hash is small for their label's number leave the scan, each once however often it was sent.
    """
    known = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    counts = [(r.lang, r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(LEAST_SHARE).collect()]
    total = known.count()
    names = sorted(n for n, c in counts if c * LEAST_SHARE >= total)
    if not names:
        return Languages([], [])
    limit = F.create_map(*[F.lit(x) for n, c in counts if n in names for x in (n, min(1.0, OVER * sample / c))])
    hashed = known.withColumn("h", F.xxhash64("text")).filter(F.pmod("h", F.lit(1 << 20)) < limit[F.col("lang")] * (1 << 20)).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    taken: dict[str, list[str]] = {n: [] for n in names}
    for r in hashed.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "text").collect():
        taken[r.lang].append(r.text)
    return Languages(names, [sorted(taken[n]) for n in names])


SEGMENTS = "first_line bigint, last_line bigint, lang string, confidence double"


def segments(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, label, first_line, last_line, lang, confidence): the longest runs of lines in one language.

    Lines are counted from 1.  `Label: value` lines, lines without a sentence and rejected lines belong to no language
    and break no run.  A text without any line of a language, an empty or null one, gives no row; without any labelled
    text in ``df`` there is nothing to fit on and no row at all.
    """
    languages = fit(df, text, lang)
    if not languages.names:
        return df.select(F.col(key), F.col(lang).alias("label")).limit(0).selectExpr("*", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in SEGMENTS.split(", ")])
    shared = df.sparkSession.sparkContext.broadcast(languages)  # a few MB, bounded by SAMPLE
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for f in frames:
            for at in range(0, len(f), 500):
                part = f.iloc[at : at + 500]
                read = [[sentence(x) for x in t.split("\n")] if t else [] for t in part["text"]]
                new = list(dict.fromkeys(s for lines in read for s in lines if s))
                known = dict(zip(new, own.of(new)))
                out = []
                for k, label, lines in zip(part["key"], part["label"], read):
                    runs: list = []
                    for n, s in enumerate(lines, 1):
                        name, sure = known[s] if s else (None, 0.0)
                        if name is None:
                            continue
                        if runs and runs[-1][2] == name:
                            runs[-1][1] = n
                            runs[-1][3].append(sure)
                        else:
                            runs.append([n, n, name, [sure]])
                    out += [(k, label, a, b, name, float(np.mean(sure))) for a, b, name, sure in runs]
                yield pd.DataFrame(out, columns=["key", "label", "first_line", "last_line", "lang", "confidence"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(lang).alias("label"), F.col(text).alias("text")))
    return rows.mapInPandas(run, f"key {kind}, label string, {SEGMENTS}").withColumnRenamed("key", key)


def p5_segments(spark, sf_dir: str) -> DataFrame:
    """(offer_id, label, first_line, last_line, lang, confidence) of every message."""
    return segments(table(spark, sf_dir, "offers", "offer_id", "source_text", "lang"), "offer_id", "source_text", "lang").distinct()


def p5_found(spark, sf_dir: str) -> DataFrame:
    """(offer_id, first_line, lang): messages whose label is missing or wrong, and the runs of those in several languages."""
    rows = segments(table(spark, sf_dir, "offers", "offer_id", "source_text", "lang"), "offer_id", "source_text", "lang")
    found = rows.groupBy("offer_id").agg(F.collect_set(F.struct("first_line", "lang")).alias("runs"), F.first("label").alias("label"))
    one = F.size("runs") == 1
    same = F.coalesce(F.col("label") == F.col("runs")[0]["lang"], F.lit(False))
    return found.filter(~(one & same)).select("offer_id", one.alias("one"), F.explode("runs").alias("r")).select("offer_id", F.when(F.col("one"), F.lit(1)).otherwise(F.col("r.first_line")).cast("bigint").alias("first_line"), F.col("r.lang").alias("lang"))
