"""Edit distances of single pairs."""

from __future__ import annotations


def distance(a: str, b: str) -> int:
    """Letters put in, left out, changed or swapped with the next, where a swapped pair may be edited again.

    Kept as rows of a table; for each letter the last row with it, and in a row the last column that matched, say from
    where a swap may have come.
    """
    rows: list[list[int]] = [list(range(len(b) + 1))]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, matched = [i], 0
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j], row[j - 1]) + 1
            best = min(best, rows[i - 1][j - 1] + (x != y))
            p, q = seen.get(y, 0), matched
            if p and q:
                best = min(best, rows[p - 1][q - 1] + i - p + j - q - 1)
            if x == y:
                matched = j
            row.append(best)
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]
