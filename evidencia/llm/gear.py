"""Gear rolling hash over bytes, vectorised over a whole Arrow batch."""

from __future__ import annotations

import numpy as np

#: Bytes that a hash depends on.
WINDOW = 16


def _table() -> np.ndarray:
    """256 odd-looking 32-bit words from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(31)).astype(np.uint32)


GEAR = _table()


def rolling(raw: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes that end at each place: sum of GEAR[byte] << age, by doubling."""
    h = GEAR[raw]
    step = 1
    while step < WINDOW:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + older
        step *= 2
    return h


def cut_mask(raw: np.ndarray, bits: int) -> np.ndarray:
    """True where a chunk ends right after the byte; about one in 2**bits."""
    return (rolling(raw) >> np.uint32(32 - WINDOW)) & np.uint32((1 << bits) - 1) == 0


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without copying; a null has no bytes."""
    import pyarrow as pa

    if column.null_count or column.offset:
        column = pa.concat_arrays([column.fill_null("")])
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets
