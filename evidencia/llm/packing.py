"""Filling fixed-capacity containers with texts by bin completion (problem 9).

Only sizes matter, and there are at most ``capacity`` different ones, so branch and bound runs on the histogram of
sizes: a table of bounded size whatever the corpus.  Best fit decreasing is the incumbent; a plan that beats it may
waste so much in all and no more.  The search takes the largest size left, enumerates the undominated fillings of the
room beside it whose waste the plan can still bear, least waste first, repeats one as often as the counts allow, and
goes back to the container before where none is left.  The plan it makes says which ranks of a size go to which
container; ranks are given to the texts in parallel.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencia.llm.tokens import count_ids
from evidencia.runtime import slots, stored, table

CAPACITY = 2048
#: Nodes that one container's search may visit, fillings it hands on, and containers tried before the incumbent stands.
NODES, WIDTH, TRIES = 1000, 4, 8_000


def sums(sizes: list[int], room: int) -> dict[int, int]:
    """For each size, as bits, the sums up to ``room`` that it and the smaller ones can make, taken any number of times."""
    out, reach, full = {}, 1, (1 << room + 1) - 1
    for s in sorted(sizes):
        step = s
        while step <= room:
            reach |= reach << step & full
            step *= 2
        out[s] = reach
    return out


def dominated(filling: list[int], rest: int, left: set[int]) -> bool:
    """Another filling is never worse: one more item fits, or one at hand fits in the place of a smaller one or of two."""
    if any(s in left for s in range(1, rest + 1)):
        return True
    one = ((x + 1, x + rest) for x in set(filling))
    two = ((x + y, x + y + rest) for x, y in set(itertools.combinations(filling, 2)))
    return any(s in left for low, high in itertools.chain(one, two) for s in range(low, high + 1))


def fillings(counts: np.ndarray, room: int, most: int, reach: dict[int, int] | None = None) -> list[list[int]]:
    """Up to WIDTH undominated fillings of ``room`` that waste at most ``most``, least waste first.

    counts[s]: items of size s at hand; reach: ``sums`` of these sizes or more.  Sizes are tried in falling order, so that
    each multiset is met once; a branch is left where even the best sum that its sizes can make wastes too much.  The
    waste allowed widens until there are fillings, so that tight ones are not looked for among loose ones.
    """
    have = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1] if s]
    if not have:
        return [[]] if room <= most else []
    reach = reach if reach is not None else sums(have, room)
    number = {s: int(counts[s]) for s in have}
    chosen: list[int] = []
    found: list[tuple[int, list[int]]] = []
    seen = 0

    def branch(rest: int, start: int, worst: int) -> None:
        nonlocal seen
        if rest <= worst and not dominated(chosen, rest, {s for s in have if number[s]}):
            found.append((rest, chosen.copy()))
        for at in range(start, len(have)):
            s = have[at]
            if s > rest or not number[s]:
                continue
            best = (reach[s] & (1 << rest + 1) - 1).bit_length() - 1
            if rest - best > worst or seen >= NODES or len(found) >= WIDTH:
                return  # the smaller sizes alone make fewer sums still
            seen += 1
            number[s] -= 1
            chosen.append(s)
            branch(rest - s, at, worst)
            chosen.pop()
            number[s] += 1

    worst = 0
    while True:
        seen = 0
        branch(room, 0, worst)
        if found or worst >= most:
            return [f for _, f in sorted(found, key=lambda x: x[0])]
        worst = min(most, 4 * worst + 1)


def _slots(fillings: list[tuple[list[int], int]], most: int) -> pd.DataFrame:
    """Slots for (sizes, times) in the order of their containers."""
    taken = np.zeros(most + 1, np.int64)
    rows, container = [], 0
    for filling, times in fillings:
        sizes, each = np.unique(filling, return_counts=True)
        at = 0
        for s, n in zip(sizes[::-1].tolist(), each[::-1].tolist()):
            rows.append((s, int(taken[s]), times, n, container, at))
            at += s * n
        taken[sizes] += each * times
        container += times
    return pd.DataFrame(rows, columns=["size", "start", "times", "each", "container", "at"]).sort_values(["size", "start"], ignore_index=True)


def complete(counts: np.ndarray, capacity: int, waste: int, tries: int = TRIES) -> list[tuple[list[int], int]] | None:
    """Fillings around the largest size left that waste at most ``waste`` in all, or None if ``tries`` containers find none."""
    counts = counts.copy()
    path: list[tuple[list[int], int, int, list]] = []  # filling, times, its waste in all, fillings not tried yet
    todo: list | None = None
    reach = sums([int(s) for s in np.flatnonzero(counts) if s], capacity)  # of all sizes: a bound for those left, too
    for _ in range(tries):
        if todo is None:
            if not counts.any():
                return [(f, n) for f, n, _, _ in path]
            top = int(np.flatnonzero(counts)[-1])
            counts[top] -= 1
            todo = [[top, *f] for f in fillings(counts, capacity - top, waste, reach)]
            counts[top] += 1
        if not todo:
            if not path:
                return None
            filling, times, lost, todo = path.pop()
            sizes, each = np.unique(filling, return_counts=True)
            counts[sizes] += each * times
            waste += lost
            continue
        filling, todo = todo[0], todo[1:]
        sizes, each = np.unique(filling, return_counts=True)
        times = int((counts[sizes] // each).min())
        rest = capacity - sum(filling)
        if rest:
            times = min(times, waste // rest)
        if not times:
            continue
        counts[sizes] -= each * times
        waste -= rest * times
        path.append((filling, times, rest * times, todo))
        todo = None
    return None


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing over the histogram: containers filled alike are one row with their number."""
    open_: list[tuple[int, list[int], int]] = []  # room, sizes, times
    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            fits = [k for k, (room, _, _) in enumerate(open_) if room >= s]
            if fits:
                room, sizes, times = open_.pop(min(fits, key=lambda k: open_[k][0]))
                n = min(left // (room // s), times)  # containers that take as many as fit
                if n:
                    open_.append((room - room // s * s, sizes + [s] * (room // s), n))
                    left -= n * (room // s)
                elif left:
                    open_.append((room - left * s, sizes + [s] * left, 1))
                    n, left = 1, 0
                if times > n:
                    open_.append((room, sizes, times - n))
            else:
                n, each = left // (capacity // s), capacity // s
                if n:
                    open_.append((capacity - each * s, [s] * each, n))
                if left % each:
                    open_.append((capacity - left % each * s, [s] * (left % each), 1))
                left = 0
    return [(sizes, times) for _, sizes, times in open_]


def containers(made: pd.DataFrame) -> int:
    return int((made["container"] + made["times"]).max()) if len(made) else 0


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Slots (size, start, times, each, container, at): ranks of a size from ``start`` on, ``each`` a container.

    counts[s]: items of size s, 0 < s <= capacity.  Containers are numbered from 0 without gaps.  Where best fit decreasing
    takes no more containers than the sum of sizes needs, nothing can beat it and it is the plan; otherwise the search
    is asked for as many as the sum needs, and then, halving, for more; each time it may try half of what is left of
    TRIES containers.
    """
    total = int((counts * np.arange(len(counts))).sum())
    best, low = _slots(best_fit(counts, capacity), len(counts)), -(-total // capacity)
    asked, tries = low, TRIES
    while containers(best) > low:
        tries //= 2
        found = complete(counts, capacity, asked * capacity - total, tries)
        if found is None:
            low = asked + 1
        else:
            best = _slots(found, len(counts))
        asked = (low + containers(best)) // 2
    return best


def place(slots_of: pd.DataFrame, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Container of the item of that size and rank, and where in it the item begins; empty items stand in container 0."""
    container, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    real = size > 0
    if real.any():
        key = slots_of["size"].to_numpy(np.int64) * (1 << 40) + slots_of["start"].to_numpy(np.int64)
        row = np.searchsorted(key, size[real] * (1 << 40) + rank[real], "right") - 1
        took = slots_of.iloc[row]
        each, local = took["each"].to_numpy(np.int64), rank[real] - took["start"].to_numpy(np.int64)
        container[real] = took["container"].to_numpy(np.int64) + local // each
        at[real] = took["at"].to_numpy(np.int64) + local % each * size[real]
    return container, at


def pack(sizes: DataFrame, key: str, size: str, row: str = "row", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, n, container, at) for items of ``sizes``; ``row`` is unique for each of its rows.

    An item larger than ``capacity`` is cut into full pieces and a rest, all others stay whole.  Items of size 0 or
    null take no room and stand in container 0.  Ranks within a size come from counts by (bucket, size), summed over
    buckets, so that a size which a third of all items have is ranked in as many tasks as there are buckets.
    """
    buckets = 4 * slots(sizes.sparkSession)
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.lit(0), F.ceil(n / capacity) - 1)
    pieces = sizes.select(F.col(row).alias("row"), F.col(key).alias("key"), n.alias("all"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    pieces = pieces.withColumn("n", F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("piece") * capacity)).withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    pieces = stored(pieces, ["row", "key", "piece", "n", "bucket"])

    by = pieces.groupBy("bucket", "n").agg(F.count("*").alias("c"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in by.groupBy("n").agg(F.sum("c").alias("c")).filter("n > 0").collect():  # at most `capacity` rows
        hist[r.n] = r.c
    made = plan(hist, capacity)

    before = by.select("bucket", "n", (F.sum("c").over(Window.partitionBy("n").orderBy("bucket")) - F.col("c")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "n").orderBy("row", "piece")) - 1).join(before, ["bucket", "n"])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            container, at = place(made, f["n"].to_numpy(np.int64), f["rank"].to_numpy(np.int64))
            yield pd.DataFrame({key: f["key"], "piece": f["piece"], "n": f["n"], "container": container, "at": at})

    kind = sizes.schema[key].dataType.simpleString()
    return ranked.select("key", "piece", "n", (F.col("rank") + F.col("before")).alias("rank")).mapInPandas(assign, f"{key} {kind}, piece bigint, n bigint, container bigint, at bigint")


def p9_packing(spark, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n, container, at): every text of documents in containers of 2,048 ids."""
    return pack(count_ids(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "n_ids")
