"""Fits the privacy tagger: ``python -m evidencia.llm.pii_train SF_DIR [SECONDS]`` writes ``pii_weights.npz``.

The sample is bounded: at most SENTENCES labelled sentences and as many without a span, in an order by their hash.
One in SMALL of both is shown in small letters, too, as people type.  A tenth of the sentences is held out and scored.
"""

from __future__ import annotations

import multiprocessing
import os
import re
import sys
import time

import numpy as np
import xxhash

from evidencia.llm import pii
from evidencia.llm.pii_labels import Labeller

HIDDEN = 24
SENTENCES = 30_000
SMALL = 16
#: Of the letters behind a capital, and of other small letters, so many are others at each step, so that the words of the
#: sample are not learnt by heart.
NOISE, LITTLE = 0.2, 0.02
ROWS = 256


def sample(texts: list[str], most: int = SENTENCES) -> list[tuple[str, np.ndarray]]:
    """(folded stretch, labels) of distinct stretches, with spans and without."""
    cut = dict.fromkeys(s for t in texts for _, s in pii.stretches(t))
    ordered = sorted(cut, key=lambda s: xxhash.xxh64_intdigest(s))
    labeller = Labeller(ordered)
    have, lack, seen = [], [], set()
    for s in ordered:
        f = pii.folded(s)[: pii.WINDOW]
        if f in seen:
            continue
        seen.add(f)
        y = np.zeros(len(f), np.uint8)
        spans = labeller.spans(s)
        for a, b, k in spans:
            y[a:b] = 2 * k + 2
            if a < len(y):
                y[a] = 2 * k + 1
        (have if spans else lack).append((f, y))
    chosen = have[:most] + lack[: min(len(lack), len(have), most)]
    return chosen + [(f.lower(), y) for f, y in chosen[::SMALL]]


def initial(hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    v, n, m = len(pii.ALPHABET), hidden, pii.LABELS
    w = {}
    for d in "fb":
        w["e" + d] = rng.normal(0, 0.25, (v, 4 * n))
        w["e" + d][:, n : 2 * n] += 1.0
        q, _ = np.linalg.qr(rng.normal(size=(4 * n, n)))
        w["w" + d] = q.T * 0.8
    w["out"] = rng.normal(0, 0.1, (2 * n, m))
    w["bias"], w["trans"], w["start"] = np.zeros(m), np.zeros((m, m)), np.zeros(m)
    return {k: x.astype(np.float32) for k, x in w.items()}


def lstm(x: np.ndarray, emb: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, tuple]:
    steps, rows, n = *x.shape, rec.shape[0]
    h, c = np.zeros((steps + 1, rows, n), np.float32), np.zeros((steps + 1, rows, n), np.float32)
    gates = np.empty((steps, rows, 4 * n), np.float32)
    for t in range(steps):
        g = emb[x[t]] + h[t] @ rec
        g[:, : 3 * n] *= 0.5
        np.tanh(g, out=g)
        g[:, : 3 * n] = 0.5 * g[:, : 3 * n] + 0.5
        gates[t] = g
        c[t + 1] = g[:, n : 2 * n] * c[t] + g[:, :n] * g[:, 3 * n :]
        h[t + 1] = g[:, 2 * n : 3 * n] * np.tanh(c[t + 1])
    return h[1:], (x, h, c, gates)


def lstm_back(up: np.ndarray, kept: tuple, emb: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, h, c, gates = kept
    steps, rows, n = up.shape
    dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    d = np.empty((steps, rows, 4 * n), np.float32)
    for t in range(steps - 1, -1, -1):
        g = gates[t]
        i, f, o, z = g[:, :n], g[:, n : 2 * n], g[:, 2 * n : 3 * n], g[:, 3 * n :]
        dh += up[t]
        tc = np.tanh(c[t + 1])
        dc += dh * o * (1 - tc * tc)
        d[t, :, :n] = dc * z * i * (1 - i)
        d[t, :, n : 2 * n] = dc * c[t] * f * (1 - f)
        d[t, :, 2 * n : 3 * n] = dh * tc * o * (1 - o)
        d[t, :, 3 * n :] = dc * i * (1 - z * z)
        dc = dc * f
        dh = d[t] @ rec.T
    flat = d.reshape(-1, 4 * n)
    hot = np.zeros((emb.shape[0], flat.shape[0]), np.float32)
    hot[x.reshape(-1), np.arange(flat.shape[0])] = 1
    return hot @ flat, h[:-1].reshape(-1, n).T @ flat


def crf(s: np.ndarray, y: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss summed over rows, and its gradients by scores, transitions, and start."""
    steps, rows, m = s.shape
    alive = lengths[None, :] > np.arange(steps)[:, None]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)

    alpha = np.empty_like(s)
    alpha[0] = s[0] + start
    for t in range(1, steps):
        alpha[t] = np.where(alive[t][:, None], lse(alpha[t - 1][:, :, None] + trans, 1) + s[t], alpha[t - 1])
    beta = np.zeros_like(s)
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(alive[t + 1][:, None], lse(trans + (s[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
    total = lse(alpha[-1], 1)
    ds = np.exp(alpha + beta - total[None, :, None]) * alive[:, :, None]
    inner = alive[1:]
    pair = alpha[:-1, :, :, None] + trans + (s[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
    dtrans = (np.exp(np.minimum(pair, 0)) * inner[:, :, None, None]).sum(axis=(0, 1))
    dstart = ds[0].sum(axis=0)
    r = np.arange(rows)
    gold = np.take_along_axis(s, y[:, :, None].astype(np.int64), 2)[:, :, 0]
    score = (gold * alive).sum() + start[y[0]].sum() + (trans[y[:-1], y[1:]] * inner).sum()
    tt, bb = np.nonzero(alive)
    ds[tt, bb, y[tt, bb]] -= 1
    np.subtract.at(dtrans, (y[:-1][inner], y[1:][inner]), 1)
    np.subtract.at(dstart, y[0, r], 1)
    return float(total.sum() - score), ds, dtrans, dstart


def step(w: dict, batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, dict]:
    lengths = np.array([len(x) for x, _ in batch])
    steps, n = int(lengths.max()), w["wf"].shape[0]
    x, y, back = (np.zeros((steps, len(batch)), np.int64) for _ in range(3))
    for k, (a, b) in enumerate(batch):
        x[: len(a), k], y[: len(a), k], back[: len(a), k] = a, b, a[::-1]
    hf, kf = lstm(x, w["ef"], w["wf"])
    hb, kb = lstm(back, w["eb"], w["wb"])
    turn = np.where(np.arange(steps)[:, None] < lengths, lengths - 1 - np.arange(steps)[:, None], 0)
    rows = np.arange(len(batch))
    alive = (np.arange(steps)[:, None] < lengths)[:, :, None]
    both = np.concatenate((hf, hb[turn, rows]), axis=2) * alive
    s = both @ w["out"] + w["bias"]
    loss, ds, dtrans, dstart = crf(s, y, lengths, w["trans"], w["start"])
    count = lengths.sum()
    ds = (ds / count).astype(np.float32)
    grad = {"out": both.reshape(-1, 2 * n).T @ ds.reshape(-1, ds.shape[2]), "bias": ds.sum(axis=(0, 1)), "trans": dtrans / count, "start": dstart / count}
    up = (ds @ w["out"].T) * alive
    ub = np.zeros_like(up[:, :, n:])
    tt, bb = np.nonzero(alive[:, :, 0])
    ub[turn[tt, bb], bb] = up[tt, bb, n:]
    grad["ef"], grad["wf"] = lstm_back(up[:, :, :n], kf, w["ef"], w["wf"])
    grad["eb"], grad["wb"] = lstm_back(ub, kb, w["eb"], w["wb"])
    return loss / count, grad


_DATA: list = []


def _part(job: tuple) -> tuple[float, int, dict]:
    w, rows, seed = job
    rng, batch = np.random.default_rng(seed), []
    for x, y, c, small in (_DATA[k] for k in rows):
        other = rng.random(len(x)) < c
        x = x.copy()
        x[other] = rng.choice(small, int(other.sum()))
        batch.append((x, y))
    loss, grad = step(w, batch)
    return loss, sum(len(x) for x, _ in batch), grad


def _together(parts: list[tuple[float, int, dict]]) -> tuple[float, dict]:
    total = sum(n for _, n, _ in parts)
    return sum(loss * n for loss, n, _ in parts) / total, {k: sum(g[k] * (n / total) for _, n, g in parts) for k in parts[0][2]}


def noise(text: str) -> np.ndarray:
    """How likely each character of a folded stretch is replaced in training: letters of capitalised words most."""
    out = np.zeros(len(text), np.float32)
    for m in re.finditer("[A-Za-z]+", text):
        own = NOISE if m[0][0].isupper() and len(m[0]) > 3 else LITTLE
        out[m.start() : m.end()] = [own if c.islower() else 0.0 for c in m[0]]
    return out


def train(data: list[tuple[str, np.ndarray]], seconds: float, hidden: int = HIDDEN, seed: int = 7, say=print, workers: int = 1) -> dict[str, np.ndarray]:
    """Adam over batches of like length until the time is over; the rate falls to a fiftieth."""
    w, rng = initial(hidden, seed), np.random.default_rng(seed)
    chance = [noise(f) for f, _ in data]
    data = [(pii.encode(f), y) for f, y in data]
    small = pii.encode("abcdefghijklmnopqrstuvwxyz")
    _DATA[:] = [(x, y, c, small) for (x, y), c in zip(data, chance)]
    pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    began, n, losses = time.time(), 0, []
    while time.time() - began < seconds:
        order = sorted(range(len(data)), key=lambda k: len(data[k][0]) + rng.uniform(0, 25))
        parts = [order[k : k + ROWS] for k in range(0, len(order), ROWS)]
        for p in rng.permutation(len(parts)):
            spent = (time.time() - began) / seconds
            if spent >= 1:
                break
            shares = [(w, parts[p][k::workers], (seed, n, k)) for k in range(workers) if parts[p][k::workers]]
            loss, grad = _together(pool.map(_part, shares) if pool else list(map(_part, shares)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            n += 1
            rate = 6e-3 * min(1, n / 50) * max(0.02, 1 - spent)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
            losses.append(loss)
            if n % 200 == 0:
                say(f"{n} steps, {time.time() - began:.0f} s, loss {np.mean(losses[-200:]):.5f}")
    if pool:
        pool.terminate()
    return w


def score(w: dict[str, np.ndarray], data: list[tuple[str, np.ndarray]]) -> dict[int, tuple[int, int, int]]:
    """Per kind: spans found that are right, found, and labelled."""
    out = {k: [0, 0, 0] for k in range(len(pii.KINDS))}
    for got, (_, y) in zip(pii.Tagger(w).spans([f for f, _ in data]), data):
        want = set()
        for a in np.flatnonzero(y & 1).tolist():
            e = a + 1
            while e < len(y) and y[e] == y[a] + 1:
                e += 1
            want.add((a, e, int(y[a]) // 2))
        for k in out:
            g, t = {x for x in got if x[2] == k}, {x for x in want if x[2] == k}
            out[k][0] += len(g & t)
            out[k][1] += len(g)
            out[k][2] += len(t)
    return {k: tuple(x) for k, x in out.items()}


def main(folder: str, seconds: float) -> None:
    import pandas as pd

    texts: list[str] = []
    for _, name, key, text in pii.SOURCES:
        texts += pd.read_parquet(f"{folder}/{name}.parquet", columns=[key, text]).drop_duplicates(key)[text].dropna().tolist()
    data = sample(texts)
    held, fit = data[::10], [d for k, d in enumerate(data) if k % 10]
    print(len(fit), "sentences, held out", len(held), flush=True)
    w = train(fit, seconds, say=lambda s: print(s, flush=True), workers=os.cpu_count() or 1)
    for k, (right, found, there) in score(w, held).items():
        print(pii.KINDS[k], "right", right, "found", found, "labelled", there)
    np.savez_compressed(pii.WEIGHTS, **{k: x.astype(np.float16) for k, x in w.items()})


if __name__ == "__main__":
    main(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 300)
