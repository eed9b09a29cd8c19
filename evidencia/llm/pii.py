"""Personal details in free text by a character BiLSTM with CRF transitions, in numpy (problem 4).

A text is cut where a sentence surely ends, long stretches into overlapping windows.  A bidirectional LSTM reads the
characters of each window; in the overlap the scores of both windows are blended by their distance from the window's
edge, and one Viterbi pass under the CRF's transitions decodes the whole stretch.  Weights are fitted by
``pii_train``; they come with the package.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.llm.pii_labels import KINDS
from evidencia.runtime import spread, table

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
WINDOW, OVERLAP = 256, 64
#: Windows decoded at a time.
BATCH = 256
#: Stretches whose spans are remembered in a Python worker.
REMEMBER = 200_000

# a sentence surely ends at a line feed, at the signs between snippets, and at a full stop after a whole word
END = re.compile(r"\n|\s\.\.\.(?=\s|$)|\s·\s|(?<=[a-z0-9)]{3}\.)\s+(?=\S)")
_CODE = re.compile(r"(?<![A-Za-z0-9])([A-Z]{1,5})(?=[-/]?\d)")
_TAIL = re.compile(r"(?<=\d)[A-Z](?![A-Za-z0-9])")


def folded(text: str) -> str:
    """A stretch as the model reads it, as long as it was: digits alike, letters of reference codes alike, letters of
    scripts other than the Latin alike.  Stretches that fold to the same string have the same spans."""
    text = _CODE.sub(lambda m: "A" * len(m[1]), text)
    text = _TAIL.sub("A", text)
    return text.translate(_FOLD)


class _Fold(dict):
    """Each character's representative."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if c.isascii():
            r = "0" if c.isdigit() else c if c.isprintable() else " "
        elif c.isdigit():
            r = "०"
        elif 0x0900 <= point < 0x0980:
            r = "अ"
        elif 0x0B80 <= point < 0x0C00:
            r = "அ"
        elif c in "₹–—•·’":
            r = c
        else:
            r = "é" if c.isalpha() else " " if c.isspace() else "¤"
        self[point] = r
        return r


_FOLD = _Fold()
ALPHABET = "\0" + "".join(chr(k) for k in range(32, 127)) + "०अஅ₹–—•·’é¤"
CODE = np.zeros(1 << 16, np.uint8)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def encode(text: str) -> np.ndarray:
    """Numbers of the characters of a folded stretch."""
    return CODE[np.frombuffer(text.encode("utf-16-le"), np.uint16)]


class Tagger:
    """weights: for each direction a table (character x 4H) and a matrix (H x 4H); an output matrix (2H x labels) with
    offsets; transitions (labels x labels).  The gates are input, forget, output, and candidate, the first three halved
    beforehand, since sigmoid(x) = (1 + tanh(x / 2)) / 2 makes one tanh serve all four.  Hidden states are kept twice as
    large, which the weights behind them make up for."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, np.float32) for k, v in weights.items()}
        self.size = self.w["wf"].shape[0]
        half = np.ones(4 * self.size, np.float32)
        half[: 3 * self.size] = 0.5
        self.fast = {k: self.w[k] * half for k in ("ef", "eb")}
        self.rec = np.stack([self.w["wf"] * half, self.w["wb"] * half]) * np.float32(0.5)
        self.out = self.w["out"] * np.float32(0.5)

    def _both(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """x: (2, T, B) numbers, forwards and backwards.  Returns hidden states (2, T, B, H); rows are sorted by falling length."""
        _, steps, rows = x.shape
        n = self.size
        ahead, back, rec = self.fast["ef"], self.fast["eb"], self.rec
        out = np.zeros((2, steps, rows, n), np.float32)
        h, c = np.zeros((2, rows, n), np.float32), np.zeros((2, rows, n), np.float32)
        alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
        gates = np.empty((2, rows, 4 * n), np.float32)
        for t in range(steps):
            k = alive[t]
            g = gates[:, :k]
            np.matmul(h[:, :k], rec, out=g)
            g[0] += ahead[x[0, t, :k]]
            g[1] += back[x[1, t, :k]]
            np.tanh(g, out=g)
            s = g[:, :, : 3 * n]
            s += 1  # twice the sigmoid; what follows is halved, hidden states in the weights behind them
            now = c[:, :k]
            now *= g[:, :, n : 2 * n]
            now += g[:, :, :n] * g[:, :, 3 * n :]
            now *= 0.5
            h = out[:, t]
            np.tanh(now, out=h[:, :k])
            h[:, :k] *= g[:, :, 2 * n : 3 * n]
        return out

    def scores(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """Label scores (length x labels) of each window."""
        out: list = [None] * len(windows)
        order = sorted(range(len(windows)), key=lambda k: -len(windows[k]))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            lengths = np.array([len(windows[k]) for k in part])
            x = np.zeros((2, int(lengths[0]), len(part)), np.uint8)
            for m, k in enumerate(part):
                x[0, : lengths[m], m] = windows[k]
                x[1, : lengths[m], m] = windows[k][::-1]
            f, b = self._both(x, lengths)
            n = self.size
            f, b = f @ self.out[:n] + self.w["bias"], b @ self.out[n:]
            for m, k in enumerate(part):
                out[k] = f[: lengths[m], m] + b[: lengths[m], m][::-1]
        return out

    def _worth(self, scores: list[np.ndarray]) -> list[int]:
        """The stretches that may have a span.

        A span adds at most what its characters do to the path without one, each with the best change of label into its
        own, and what beginning and ending it adds (ending costs nothing at the stretch's end): where no run of
        characters reaches 0, there is nothing to decode.
        """
        trans, start = self.w["trans"], self.w["start"]
        inner = trans[1:].max(axis=0)[1:] - trans[0, 0]
        begin = float(np.maximum(trans[0, 1:] - trans[0, 0] - inner, start[1:] - start[0] - inner).max())
        end = float(trans[1:, 0].max() - trans[0, 0])
        own, out = [k for k, s in enumerate(scores) if len(s)], []
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            every = np.concatenate([scores[k] for k in part])
            sizes = np.array([len(scores[k]) for k in part])
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(every)) + np.repeat(np.arange(1, len(part) + 1), sizes)
            steps = np.full(len(every) + len(part), -1e5)  # no run goes from one stretch to the next
            steps[place] = (every[:, 1:] + inner).max(axis=1) - every[:, 0]
            sums = np.cumsum(steps)
            run = sums[place] - np.minimum.accumulate(sums)[place - 1]
            best = np.maximum(run[first + sizes - 1], np.maximum.reduceat(run, first) + end)
            out += [part[k] for k in np.flatnonzero(best + begin >= 0)]
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each stretch under the transitions."""
        out: list = [np.zeros(len(s), np.uint8) for s in scores]
        trans = self.w["trans"]
        order = self._worth(scores)
        order.sort(key=lambda k: -len(scores[k]))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            lengths = np.array([len(scores[k]) for k in part])
            steps = int(lengths[0])
            s = np.zeros((steps, len(part), LABELS), np.float32)
            for m, k in enumerate(part):
                s[: lengths[m], m] = scores[k]
            alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
            best, back = s[0] + self.w["start"], np.zeros((steps, len(part), LABELS), np.uint8)
            for t in range(1, steps):
                k = alive[t]
                top, origin = best[:k, :1] + trans[0], back[t, :k]
                for label in range(1, LABELS):
                    reach = best[:k, label : label + 1] + trans[label]
                    origin[reach > top] = label
                    np.maximum(top, reach, out=top)
                best[:k] = top + s[t, :k]
            last = best.argmax(axis=1)
            path = np.zeros((steps, len(part)), np.uint8)
            rows = np.arange(len(part))
            current = last.copy()
            for t in range(steps - 1, -1, -1):
                fresh = lengths - 1 == t
                current[fresh] = last[fresh]
                path[t] = current
                current = np.where(lengths > t, back[t, rows, current], current)
            for m, k in enumerate(part):
                out[k] = path[: lengths[m], m]
        return out

    def labels(self, stretches: list[str]) -> list[np.ndarray]:
        """Labels of folded stretches, each decoded as a whole over its windows."""
        pieces, of = [], []
        step = WINDOW - OVERLAP
        for k, text in enumerate(stretches):
            x = encode(text)
            for a in range(0, max(1, len(x) - OVERLAP), step):
                pieces.append(x[a : a + WINDOW])
                of.append((k, a))
        whole: list = [None] * len(stretches)
        weight: list = [None] * len(stretches)
        for (k, a), s in zip(of, self.scores(pieces)):
            n = len(stretches[k])
            if len(s) == n:
                whole[k] = s
                continue
            if whole[k] is None:
                whole[k], weight[k] = np.zeros((n, LABELS), np.float32), np.zeros((n, 1), np.float32)
            # a character counts for more the further it is from the window's edges that are no ends of the stretch
            left = np.arange(1, len(s) + 1) if a else np.full(len(s), OVERLAP)
            right = np.arange(len(s), 0, -1) if a + len(s) < n else np.full(len(s), OVERLAP)
            w = np.minimum(np.minimum(left, right), OVERLAP).astype(np.float32)[:, None]
            whole[k][a : a + len(s)] += s * w
            weight[k][a : a + len(s)] += w
        return self.decode([s if w is None else s / w for s, w in zip(whole, weight)])

    def spans(self, stretches: list[str]) -> list[list[tuple[int, int, int]]]:
        """(begin, end, number of kind) in each folded stretch."""
        out = []
        for path in self.labels(stretches):
            found, t, n = [], 0, len(path)
            p = path.tolist()
            for t in np.flatnonzero(path & 1).tolist():  # begins are odd
                e = t + 1
                while e < n and p[e] == p[t] + 1:
                    e += 1
                found.append((t, e, p[t] // 2))
            out.append(found)
        return out


@functools.lru_cache(maxsize=1)
def tagger(path: str = str(WEIGHTS)) -> Tagger:
    with np.load(path) as f:
        return Tagger(dict(f))


def stretches(text: str) -> list[tuple[int, str]]:
    """(begin, stretch) of a text: all of it, without the blanks and signs between sentences."""
    out, at = [], 0
    for m in END.finditer(text):
        if m.start() > at:
            out.append((at, text[at : m.start()]))
        at = m.end()
    if at < len(text):
        out.append((at, text[at:]))
    return out


def plausible(kind: int, found: str) -> bool:
    """The exact check behind the tagger: what a span of its kind must have by its definition."""
    digits = "".join(c for c in found if c.isdigit())
    if kind == 0:
        return "." in found or "dot" in found.lower()
    if kind == 1:  # a number of its own, not two figures with a dash between; mobile, with a prefix, or of an area
        own = digits.translate(_ASCII)
        return "," not in found and 10 <= len(own) <= 13 and (len(own) > 10 or own[0] in "6789")
    if kind == 2:
        return bool(_IDENTITY.fullmatch(found))
    if kind == 3:
        return bool(digits) and "," in found
    return not digits and " " in found


_ASCII = {base + k: str(k) for base in (0x0966, 0x0BE6) for k in range(10)}
_IDENTITY = re.compile(r"[A-Z]{5}\d{4}[A-Z]|[A-Z]{3}\d{7}|\d{4}(?P<s>[ -]?)\d{4}(?P=s)\d{4}")


class Reader:
    """Finds the spans of many texts, reading each folded stretch once."""

    def __init__(self, model: Tagger):
        self.model, self.known = model, {}

    def read(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        cut = [stretches(t) if t else [] for t in texts]
        folds = [[folded(s) for _, s in c] for c in cut]
        new = list(dict.fromkeys(s for f in folds for s in f if s not in self.known))
        if len(self.known) > REMEMBER:
            self.known = {}
            new = list(dict.fromkeys(s for f in folds for s in f))
        self.known.update(zip(new, self.model.spans(new)))
        out = []
        for t, c, f in zip(texts, cut, folds):
            spans = [(a + x, a + y, k) for (a, _), s in zip(c, f) for x, y, k in self.known[s]]
            out.append([s for s in spans if plausible(s[2], t[s[0] : s[1]])])
        return out


@functools.lru_cache(maxsize=1)
def reader() -> Reader:
    """One for a Python worker: what it has read serves all tasks that the worker runs."""
    return Reader(tagger())


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, begin, end, kind, found) of every personal detail; null and empty texts have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader()
        for f in frames:
            for at in range(0, len(f), 2000):
                part = f.iloc[at : at + 2000]
                out = [(k, a, b, KINDS[n], t[a:b]) for k, t, spans in zip(part["key"], part["text"], own.read(part["text"].tolist())) for a, b, n in spans]
                yield pd.DataFrame(out, columns=["key", "begin", "end", "kind", "found"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0))
    return rows.mapInPandas(run, f"key {kind}, begin int, end int, kind string, found string").withColumnRenamed("key", key)


def replaced(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with a placeholder of its type for each span."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
    return "".join(out) + text[at:]


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted) for every row: each detail replaced by a placeholder like [PHONE]; a null text stays null."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader()
        for f in frames:
            texts = [t if isinstance(t, str) else None for t in f["text"]]
            yield pd.DataFrame({"key": f["key"], "redacted": [replaced(t, s) for t, s in zip(texts, own.read([t or "" for t in texts]))]})

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInPandas(run, f"key {kind}, redacted string").withColumnRenamed("key", key)


SOURCES = (("offer", "offers", "offer_id", "source_text"), ("listing", "job_listings", "listing_id", "description"), ("organic", "organic_results", "result_id", "snippet"))


def _all(spark, sf_dir: str) -> DataFrame:
    parts = [spread(table(spark, sf_dir, name, key, text)).select(F.struct(F.lit(src).alias("src"), F.col(key).alias("rec_id")).alias("key"), F.col(text).alias("text")) for src, name, key, text in SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(F.concat_ws(":", "key.src", "key.rec_id").alias("key"), "text")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """(src, rec_id, kind, found): every personal detail of messages, listings and snippets."""
    found = find(_all(spark, sf_dir), "key", "text")
    at = F.split("key", ":")
    return found.select(at[0].alias("src"), at[1].cast("bigint").alias("rec_id"), "kind", "found").distinct()


def p4_redacted(spark, sf_dir: str) -> DataFrame:
    """(src, rec_id, redacted): the texts with placeholders."""
    at = F.split("key", ":")
    return redact(_all(spark, sf_dir), "key", "text").select(at[0].alias("src"), at[1].cast("bigint").alias("rec_id"), "redacted").distinct()
