"""A BK-tree under the unrestricted Damerau-Levenshtein distance, searched for many words at once."""

from __future__ import annotations

import numpy as np


def distances(word: str, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Distance of ``word`` to each row of ``points`` (code points, padded with 0, of the given lengths).

    Put in, left out, changed, and two letters swapped, also with letters between them, so that the triangle
    inequality holds (it does not where a swapped pair may not be edited again).
    """
    q, m = points.shape
    n = len(word)
    letters = {c: k + 1 for k, c in enumerate(dict.fromkeys(word))}
    # letters that the word lacks never swap; they share number 0
    code = np.zeros_like(points, dtype=np.int64)
    for c, k in letters.items():
        code[points == ord(c)] = k
    far = n + m
    h = np.zeros((n + 2, m + 2, q), np.int16)
    h[0] = far
    h[:, 0] = far
    h[1, 1:] = np.arange(m + 1)[:, None]
    h[1:, 1] = np.arange(n + 1)[:, None]
    seen_row = np.zeros(len(letters) + 1, np.int64)
    each = np.arange(q)
    for i in range(1, n + 1):
        own = letters[word[i - 1]]
        seen_col = np.zeros(q, np.int64)
        for j in range(1, m + 1):
            c = code[:, j - 1]
            same = c == own
            r = seen_row[c]
            swap = h[r, seen_col, each] + (i - r - 1) + 1 + (j - seen_col - 1)
            step = np.minimum(h[i, j] + (~same), np.minimum(h[i + 1, j], h[i, j + 1]) + 1)
            h[i + 1, j + 1] = np.minimum(step, swap)
            seen_col[same] = j
        seen_row[own] = i
    return h[n + 1, lengths + 1, each].astype(np.int64)


def matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some words as rows, padded with 0, and the words' lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.zeros((len(words), int(lengths.max(initial=0))), np.int64)
    for k, w in enumerate(words):
        points[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, lengths


class Tree:
    """words: distinct.  ``find`` gives every word within a distance, pruned by the triangle inequality."""

    def __init__(self, words: list[str]):
        self.words = words
        self.children: list[dict[int, int]] = [{} for _ in words]
        groups = [(0, list(range(1, len(words))))] if words else []
        while groups:  # children of a node by distance; the first of each group becomes the node of its rest
            node, rest = groups.pop()
            if rest:
                d = distances(words[node], *matrix([words[k] for k in rest]))
                for x in np.unique(d).tolist():
                    own = [rest[k] for k in np.flatnonzero(d == x)]
                    self.children[node][x] = own[0]
                    groups.append((own[0], own[1:]))

    def find(self, queries: list[str], within: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query all (distance, number of word) at most ``within`` of that query away."""
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not self.words or not queries:
            return found
        points, lengths = matrix(queries)
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, active = todo.pop()
            widest = int(lengths[active].max())
            d = distances(self.words[node], points[active, :widest], lengths[active])
            for k in np.flatnonzero(d <= within[active]).tolist():
                found[active[k]].append((int(d[k]), node))
            for x, child in self.children[node].items():
                near = np.abs(d - x) <= within[active]
                if near.any():
                    todo.append((child, active[near]))
        return found
