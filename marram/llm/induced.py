"""External induced sorting of suffixes with their common-prefix values.

A shard's suffixes are sorted as in induced sorting with recursion on a reduced string: the
leftmost S-type suffixes are ranked first, then all L-type suffixes are induced from them in
one ascending sweep, and all S-type suffixes from those in one descending sweep.  What a
sweep finds waits in priority queues whose key is the first character; inside a key, the
order of arrival is the sorted order, so a queue is a list of blocks.  Queues hold tuples of
a position and the length of the prefix shared with the tuple before it (capped at ``width``,
for deeper orders do not matter here), and move to a temporary file when they outgrow
``memory``; the sweeps read them back a block at a time.

The file lives only as long as the sort and only its own task reads it, so a lost executor
costs a retry of the task and nothing else.  What is external is the queues: types, marks,
names and the text itself stay in memory, about 34 bytes a byte of the shard.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queue blocks held in memory before they move to disk.
MEMORY = 64 << 20
#: Reduced strings of up to this many names are ranked in memory; longer ones by recursion.
BASE_NAMES = 4_000_000
_FAR = 255


class Queues:
    """One queue of (position, shared prefix) blocks for each first character."""

    def __init__(self, count: int, memory: int):
        self.blocks: list[list] = [[] for _ in range(count)]
        self.memory, self.held, self.spool = memory, 0, None

    def push(self, c: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.blocks[c].append((at, shared))
        self.held += at.nbytes + shared.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.spool is None:
            self.spool = tempfile.TemporaryFile(prefix="suffix-queues-")
        self.spool.seek(0, 2)
        for blocks in self.blocks:
            for k, b in enumerate(blocks):
                if isinstance(b[0], np.ndarray):
                    blocks[k] = (self.spool.tell(), len(b[0]))
                    self.spool.write(b[0].tobytes())
                    self.spool.write(b[1].tobytes())
        self.held = 0

    def read(self, c: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.blocks[c][k]
        if isinstance(b[0], np.ndarray):
            return b
        self.spool.seek(b[0])
        return np.frombuffer(self.spool.read(8 * b[1]), np.int64), np.frombuffer(self.spool.read(b[1]), np.uint8)

    def merge(self, c: int, k: int) -> None:
        """Make one block of the blocks from ``k`` on, as far as ``memory`` allows."""
        blocks = self.blocks[c]
        end, size = k, 0
        while end < len(blocks) and (end == k or size < self.memory):
            size += 9 * (len(blocks[end][0]) if isinstance(blocks[end][0], np.ndarray) else blocks[end][1])
            end += 1
        if end - k > 1:
            parts = [self.read(c, i) for i in range(k, end)]
            self.held += size
            blocks[k:end] = [(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]

    def close(self) -> None:
        if self.spool is not None:
            self.spool.close()


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``values[lo..hi]``, ends included."""
    out = np.empty(len(lo), values.dtype)
    span = hi - lo + 1
    level = np.frexp(span)[1] - 1
    low, size = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(low[lo[own]], low[hi[own] - size + 1])
        low, size = np.minimum(low[: len(low) - size], low[size:]) if len(low) > size else low[:0], size * 2
    return out


class _Sweep:
    """Pushes the predecessors of scanned suffixes; ``wanted`` marks the positions to push."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, width: int):
        self.text, self.wanted, self.queues, self.width = text, wanted, queues, width
        count = len(queues.blocks)
        self.least, self.seen = np.full(count, _FAR, np.uint8), np.zeros(count, bool)

    def scan(self, at: np.ndarray, shared: np.ndarray) -> None:
        before = at - 1
        source = np.flatnonzero((at > 0) & self.wanted[before])
        if len(source):
            c = self.text[before[source]]
            order = np.argsort(c, kind="stable")
            c, source = c[order], source[order]
            new = np.concatenate(([True], c[1:] != c[:-1]))
            lo = np.concatenate(([0], source[:-1] + 1))
            lo[new] = 0
            least = range_minima(shared, lo, source)
            heads = np.flatnonzero(new)
            own = c[heads]
            least[heads] = np.minimum(least[heads], self.least[own])
            common = np.minimum(least.astype(np.int64) + 1, self.width).astype(np.uint8)
            common[heads[~self.seen[own]]] = 0
            self.least = np.minimum(self.least, shared.min())
            last = source[np.append(heads[1:], len(source)) - 1]
            rest = np.full(len(own), _FAR, np.uint8)
            inside = np.flatnonzero(last < len(at) - 1)
            rest[inside] = range_minima(shared, last[inside] + 1, np.full(len(inside), len(at) - 1))
            self.least[own], self.seen[own] = rest, True
            at = before[source]
            for k, a, b in zip(own.tolist(), heads.tolist(), [*heads[1:].tolist(), len(source)], strict=True):
                self.queues.push(k, at[a:b], common[a:b])
        elif len(at):
            self.least = np.minimum(self.least, shared.min())


def types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is each suffix S-type, and how often its first character repeats (capped)."""
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    until = change[np.searchsorted(change, np.arange(n))]
    rising = np.append(text[:-1] < text[1:], True)
    return rising[until], np.minimum(until - np.arange(n) + 1, _FAR - 1).astype(np.uint8)


def induce(text: np.ndarray, small: np.ndarray, run: np.ndarray, seeds: list, width: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order, from the leftmost S-type ones: blocks of (positions, shared).

    ``seeds`` has (positions, shared) or None for each first character.
    """
    count = len(seeds)
    large_queue, small_queue = Queues(count, memory), Queues(count, memory)
    try:
        sweep = _Sweep(text, ~small, large_queue, width)
        for c in range(count):
            k = 0
            while k < len(large_queue.blocks[c]):
                large_queue.merge(c, k)
                sweep.scan(*large_queue.read(c, k))
                k += 1
            if seeds[c] is not None:
                at, shared = seeds[c]
                shared = shared.copy()
                shared[0] = min(run[large_queue.read(c, k - 1)[0][-1]], run[at[0]], width) if k else 0
                sweep.scan(at, shared)
        sweep = _Sweep(text, small, small_queue, width)
        for c in range(count - 1, -1, -1):
            k = 0
            while k < len(small_queue.blocks[c]):
                small_queue.merge(c, k)
                sweep.scan(*small_queue.read(c, k))
                k += 1
            least_small = small_queue.read(c, k - 1)[0][-1] if k else -1
            carry = None
            for j in range(len(large_queue.blocks[c]) - 1, -1, -1):
                at, shared = large_queue.read(c, j)
                if carry is None:
                    carry = min(run[at[-1]], run[least_small], width) if k else 0
                sweep.scan(at[::-1], np.concatenate((np.array([carry], np.uint8), shared[:0:-1])))
                carry = shared[0]
        for c in range(count):
            last = -1
            for k in range(len(large_queue.blocks[c])):
                at, shared = large_queue.read(c, k)
                last = at[-1]
                yield at, shared
            blocks = len(small_queue.blocks[c])
            after = None
            for k in range(blocks - 1, -1, -1):
                at, shared = small_queue.read(c, k)
                if after is None:
                    after = min(run[last], run[at[-1]], width) if last >= 0 else 0
                yield at[::-1], np.concatenate((np.array([after], np.uint8), shared[:0:-1]))
                after = shared[0]
            if c == 0 and not blocks and seeds[0] is not None:
                yield seeds[0][0], np.zeros(len(seeds[0][0]), np.uint8)
    finally:
        large_queue.close()
        small_queue.close()


def _by_first(text: np.ndarray, at: np.ndarray, shared: np.ndarray, count: int) -> list:
    """Seeds by first character, each in the order given."""
    c = text[at]
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(count + 1))
    return [(at[order[a:b]], shared[order[a:b]]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, up to ``width``."""
    out, alive = np.zeros(len(a), np.uint8), np.arange(len(a))
    top = len(text) - 1
    for k in range(width):
        alive = alive[text[np.minimum(a[alive] + k, top)] == text[np.minimum(b[alive] + k, top)]]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` to a depth of ``depth`` names, by doubling."""
    rank, step = names.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: len(rank) - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        step *= 2
        if step >= depth or step >= len(rank) or rank.max() == len(rank) - 1:
            return order


def suffixes(text: np.ndarray, count: int, width: int, memory: int = MEMORY, base: int = BASE_NAMES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` ordered by their first ``width`` characters, with shared prefixes.

    ``text`` holds numbers under ``count`` and ends with the only 0.  Yields blocks of
    (positions, shared): ``shared`` is the length of the prefix in common with the suffix
    before, ``width`` at most (under 255).  Suffixes that agree so far may come in any order.
    """
    small, run = types(text)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(first):
        first = np.array([len(text) - 1])
    # Leftmost S-type substrings: induced from unsorted seeds, then named in their order.
    marked = np.zeros(len(text), bool)
    marked[first] = True
    order = np.concatenate([at[marked[at]] for at, _ in induce(text, small, run, _by_first(text, first, np.zeros(len(first), np.uint8), count), 1, memory)])
    number = np.zeros(len(text), np.int64)
    number[first] = np.arange(len(first))
    size = np.append(np.diff(first) + 1, 1)[number[order]]
    same = size[1:] == size[:-1]
    alive, k = np.flatnonzero(same), 0
    while len(alive):
        alive = alive[k < size[alive]]
        differ = alive[text[order[alive] + k] != text[order[alive + 1] + k]]
        same[differ] = False
        alive = alive[same[alive]]
        k += 1
    names = np.empty(len(first), np.int64)
    names[number[order]] = np.cumsum(np.concatenate(([0], ~same)))
    if names.max() == len(names) - 1:
        ranked = order
    elif len(names) <= base:
        ranked = first[_ranked(names, width // 2 + 1)]
    else:
        # The sentinel's name is the only 0, so the reduced string is a text of this form.
        ranked = first[np.concatenate([at for at, _ in suffixes(names, int(names.max()) + 1, min(width, _FAR - 1), memory, base)])]
    shared = np.concatenate((np.zeros(1, np.uint8), _shared(text, ranked[:-1], ranked[1:], width)))
    yield from induce(text, small, run, _by_first(text, ranked, shared, count), width, memory)


def joined(parts: list[bytes]) -> np.ndarray:
    """Byte strings as one text for :func:`suffixes`: bytes from 2 on, 1 after each, 0 at the end."""
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum([len(p) for p in parts])
    return np.append(np.insert(raw, ends, 1), np.uint16(0))


#: Size of the alphabet of :func:`joined`.
ALPHABET = 258
