"""Anchors of byte strings: where the least hash of each window of WIDTH bytes stands."""

from __future__ import annotations

import numpy as np

from .common import mix, powers

#: Repeats of this many bytes are looked for.
WIDTH = 50
#: An anchor is a GRAM-byte string; a window holds WIDTH - GRAM + 1 of them.
GRAM = 22
SPREAD = WIDTH - GRAM + 1

_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(raw: np.ndarray, n: int = GRAM) -> np.ndarray:
    """64-bit hashes of the ``n``-byte strings of ``raw``, by doubling."""
    total, have, parts = None, 0, _TABLE[raw]
    size = 1
    for step in range(n.bit_length()):
        if n >> step & 1:
            if total is None:
                total, have = parts, size
            else:
                m = len(parts) - have
                total, have = total[:m] * np.uint64(_MULT[step % 5] | 1) + parts[have:], have + size
        if n >> (step + 1):
            parts = parts[: len(parts) - size] * np.uint64(_MULT[(step + 2) % 5]) + parts[size:]
            size *= 2
    return mix(total[: len(raw) - n + 1])


def window_minima(values: np.ndarray, n: int) -> np.ndarray:
    """Least value of each run of ``n`` values."""
    low, size = values, 1
    while size * 2 <= n:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = n - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their least anchor hash, inside documents.

    ``offsets`` bounds the documents in ``raw``.  Returns for each run the anchor's hash, the
    first window, the number of windows, and the document.  Every window of WIDTH bytes
    inside a document is in exactly one run of at most SPREAD windows; equal windows have
    equal hashes, so they meet.
    """
    if len(raw) < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = window_minima(gram_hashes(raw), SPREAD)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[: len(low)] == doc[WIDTH - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    # A string of short period keeps its least hash for long: cut such runs.
    at = np.arange(len(low))
    begin = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - begin) % SPREAD == 0
    start = np.flatnonzero(new & inside)
    # A run ends before the next start or where windows leave the document.
    limit = offsets[doc[start] + 1] - WIDTH + 1
    end = np.minimum(np.append(start[1:], len(low)), limit)
    return low[start], start, end - start, doc[start]


def span_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings at ``start`` of ``size`` bytes."""
    up, down = powers(len(raw) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[raw] * up[: len(raw)], dtype=np.uint64)))
    return mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))
