"""Alignment of track lists: costs and assignments of many pairs of lists at a time.

A batch of pairs is cut into problems (one a pair, or one a disc), problems of one size are
stacked, and their costs and assignments are array operations over the stack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from marram.functions.text import match_key

from .names import Texts, codes_of, distances

#: Weights of the signals of two tracks, and costs.
TRACK_WEIGHTS = {"title": 3.0, "artist": 2.0, "length": 2.0, "index": 1.0, "track_id": 5.0, "isrc": 4.0}
MISSING_COST, ORDER_WEIGHT, LENGTH_SCALE = 0.85, 0.15, 10_000.0
#: Cells of the cost matrices that are stacked at once.
STACK = 2_000_000
#: Pairs of texts of a batch whose distances are kept in a table; where there are more, those of a stack are sorted.
TABLE = 1 << 16
ALIGNMENT = ArrayType(StructType([StructField("local", IntegerType()), StructField("candidate", IntegerType()), StructField("cost", DoubleType())]))


def assign_all(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost, for each matrix of a stack (k, n, m) of n <= m rows."""
    out = cost.argmin(2)
    order = np.sort(out, 1)
    hard = np.flatnonzero((order[:, 1:] == order[:, :-1]).any(1))
    if len(hard):
        out[hard] = _augment(cost[hard])
    return out


def assign(cost) -> np.ndarray:
    """:func:`assign_all` of one matrix."""
    return assign_all(np.asarray(cost, float)[None])[0]


def _augment(cost: np.ndarray) -> np.ndarray:
    """Shortest augmenting paths, a row at a time in all matrices; column 0 stands for the row that is placed."""
    k, n, m = cost.shape
    row_price, col_price = np.zeros((k, n + 1)), np.zeros((k, m + 1))
    owner, before = np.zeros((k, m + 1), int), np.zeros((k, m + 1), int)
    for row in range(1, n + 1):
        owner[:, 0] = row
        at, reach, done = np.zeros(k, int), np.full((k, m + 1), np.inf), np.zeros((k, m + 1), bool)
        open_ = np.arange(k)
        while len(open_):
            here = at[open_]
            done[open_, here] = True
            own = owner[open_, here]
            through = cost[open_, own - 1] - row_price[open_, own][:, None] - col_price[open_, 1:]
            free = ~done[open_, 1:]
            now, via = reach[open_, 1:], before[open_, 1:]
            better = free & (through < now)
            now = np.where(better, through, now)
            before[open_, 1:] = np.where(better, here[:, None], via)
            next_ = np.where(free, now, np.inf).argmin(1)
            step = now[np.arange(len(open_)), next_]
            paid = np.where(done[open_], step[:, None], 0.0)
            # Columns that are done have rows of their own; the others pay nothing.
            turn, col = np.nonzero(done[open_])
            row_price[open_[turn], owner[open_[turn], col]] += paid[turn, col]
            col_price[open_] -= paid
            reach[open_, 1:] = np.where(free, now - step[:, None], now)
            at[open_] = next_ + 1
            open_ = open_[owner[open_, next_ + 1] != 0]
        moving = np.arange(k)
        while len(moving):
            here = at[moving]
            last = before[moving, here]
            owner[moving, here] = owner[moving, last]
            at[moving] = last
            moving = moving[last != 0]
    out = np.zeros((k, n), int)
    matrix, column = np.nonzero(owner[:, 1:])
    out[matrix, owner[matrix, column + 1] - 1] = column
    return out


class Tracks:
    """Tracks of both sides of a batch, flat: codes of texts, lengths, discs."""

    def __init__(self, local: pa.Array, candidate: pa.Array):
        sides = [a.flatten() for a in (local, candidate)]
        self.sizes = [pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (local, candidate)]
        self.starts = [np.concatenate(([0], np.cumsum(s)))[:-1] for s in self.sizes]
        self.texts, self.codes, self.keys = {}, {}, {}
        cells = lambda name: [self._field(s, name) for s in sides]
        for name in ("title", "artist", "isrc", "track_id"):
            both = pa.concat_arrays([x.cast(pa.string()) for x in cells(name)])
            both = pc.if_else(pc.equal(both, ""), pa.scalar(None, pa.string()), both).dictionary_encode()
            self.texts[name] = both.dictionary.to_pylist()
            codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            self.codes[name] = (codes[: len(sides[0])], codes[len(sides[0]) :])
        self.length = [pc.cast(x, pa.float64()).to_numpy(zero_copy_only=False) for x in cells("duration_ms")]
        self.disc = pc.cast(self._field(sides[0], "disc"), pa.float64()).to_numpy(zero_copy_only=False)

    @staticmethod
    def _field(side: pa.StructArray, name: str) -> pa.Array:
        if side.type.get_field_index(name) < 0:
            return pa.nulls(len(side), pa.string() if name != "disc" else pa.int64())
        # The flattened field is null where its struct is.
        return side.flatten()[side.type.get_field_index(name)]

    def problems(self, by_disc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, start, size) of every problem and the local tracks in their order: a pair's discs in order of their first track, if every track has one."""
        many = len(self.sizes[0])
        pairs, order = np.arange(many), np.arange(len(self.disc))
        if by_disc and len(self.disc):
            of = np.repeat(pairs, self.sizes[0])
            other = np.isnan(self.disc) | (self.disc != self.disc[self.starts[0][of]])
            split = np.bincount(of, other, many) > 0
            split &= np.bincount(of, np.isnan(self.disc), many) == 0
            if split.any():
                disc = np.where(split[of], self.disc, 0.0)
                order = np.lexsort((disc, of))
                new = np.flatnonzero(np.concatenate(([True], (np.diff(of[order]) != 0) | (np.diff(disc[order]) != 0))))
                size = np.diff(np.append(new, len(order)))
                empty = np.flatnonzero(self.sizes[0] == 0)
                pair, first = np.concatenate((of[order[new]], empty)), np.concatenate((order[new], np.zeros_like(empty)))
                start, size = np.concatenate((new, np.zeros_like(empty))), np.concatenate((size, np.zeros_like(empty)))
                by_first = np.lexsort((first, pair))
                return pair[by_first], start[by_first], size[by_first], order
        return pairs, self.starts[0], self.sizes[0], order

    def costs(self, local: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Distances (k, n, m) of tracks (k, n) and (k, m) over what both know; the position always counts as right."""
        shape = (len(local), local.shape[1], candidate.shape[1])
        total, weight = np.zeros(shape), np.full(shape, TRACK_WEIGHTS["index"])
        for name in ("title", "artist"):
            a, b = self.codes[name][0][local][:, :, None], self.codes[name][1][candidate][:, None, :]
            both = (a >= 0) & (b >= 0)
            total += TRACK_WEIGHTS[name] * self._names(name, a, b, both)
            weight += TRACK_WEIGHTS[name] * both
        gap = np.abs(self.length[0][local][:, :, None] - self.length[1][candidate][:, None, :])
        total += TRACK_WEIGHTS["length"] * np.where(np.isnan(gap), 0.0, np.minimum(gap / LENGTH_SCALE, 1.0))
        weight += TRACK_WEIGHTS["length"] * ~np.isnan(gap)
        for name in ("track_id", "isrc"):
            a, b = self.codes[name][0][local][:, :, None], self.codes[name][1][candidate][:, None, :]
            both = (a >= 0) & (b >= 0)
            total += TRACK_WEIGHTS[name] * (both & (a != b))
            weight += TRACK_WEIGHTS[name] * both
        return total / weight

    def _names(self, name: str, a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Distances of names, each distinct pair measured once."""
        n = len(self.texts[name])
        out = np.zeros(both.shape)
        cells = (a * n + b)[both]
        if not len(cells):
            return out
        own, at, table = self._measured(name)
        if table is None:
            pairs, where = np.unique(cells, return_inverse=True)
            out[both] = distances(own, own, at[pairs // n], at[pairs % n])[where]
            return out
        wanted = np.zeros(n * n, bool)
        wanted[cells] = True
        pairs = np.flatnonzero(wanted & np.isnan(table))
        if len(pairs):
            table[pairs] = distances(own, own, at[pairs // n], at[pairs % n])
        out[both] = table[cells]
        return out

    def _measured(self, name: str) -> tuple[Texts, np.ndarray, np.ndarray | None]:
        """Distinct match keys of a field's texts, the place of each text's key, and a table of distances if it is small; made once a batch."""
        if name not in self.keys:
            known: dict[str, int] = {}
            at = np.array([known.setdefault(match_key(t), len(known)) for t in self.texts[name]], np.int64)
            self.keys[name] = Texts(list(known), codes_of(known)), at, np.full(len(at) ** 2, np.nan) if len(at) ** 2 <= TABLE else None
        return self.keys[name]


def align_batch(local: pa.Array, candidate: pa.Array, by_disc: bool = True) -> pa.Array:
    """The alignments (local, candidate, cost) of the pairs of two arrays of track lists; null stands for no partner."""
    tracks = Tracks(local, candidate)
    pair, start, n_local, order = tracks.problems(by_disc)
    n_other = tracks.sizes[1][pair]
    width = np.maximum(n_local, n_other)
    ends = np.cumsum(width)
    flat = [np.full(int(width.sum()), -1), np.full(int(width.sum()), -1), np.zeros(int(width.sum()))]
    shape = n_local * (int(n_other.max(initial=0)) + 1) + n_other
    by_shape = np.argsort(shape, kind="stable")
    for every in np.split(by_shape, np.flatnonzero(np.diff(shape[by_shape])) + 1) if len(pair) else ():
        n, m = int(n_local[every[0]]), int(n_other[every[0]])
        size = max(n, m)
        step = max(1, STACK // max(size * size, 1))
        for lo in range(0, len(every) if size else 0, step):
            part = every[lo : lo + step]
            own = order[start[part][:, None] + np.arange(n)]
            other = tracks.starts[1][pair[part]][:, None] + np.arange(m)
            column, price = np.full((len(part), size), -1), np.full((len(part), size), MISSING_COST)
            # Being left over costs every track the same, so the shorter side chooses.
            if n and m:
                prior = ORDER_WEIGHT * np.abs(np.arange(n)[:, None] - np.arange(m)) / size
                cost = np.minimum(tracks.costs(own, other) + prior, 1.0)
                if n <= m:
                    column[:, :n] = assign_all(cost)
                else:
                    np.put_along_axis(column, assign_all(np.ascontiguousarray(cost.transpose(0, 2, 1))), np.arange(m)[None], 1)
                taken = column[:, :n] >= 0
                price[:, :n][taken] = np.take_along_axis(cost, column[:, :n, None], 2)[:, :, 0][taken]
            if n < m:
                left = np.ones((len(part), m), bool)
                np.put_along_axis(left, column[:, :n], False, 1)
                column[:, n:] = np.nonzero(left)[1].reshape(len(part), m - n)
            out = (ends[part] - size)[:, None] + np.arange(size)
            flat[0][out[:, :n]] = own - tracks.starts[0][pair[part]][:, None]
            flat[1][out], flat[2][out] = column, price
    count = np.bincount(pair, weights=width, minlength=len(local)).astype(np.int64)
    cell = lambda x: pa.array(x.astype(np.int32), pa.int32(), mask=x < 0)
    structs = pa.StructArray.from_arrays([cell(flat[0]), cell(flat[1]), pa.array(flat[2], pa.float64())], ["local", "candidate", "cost"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), structs)


@F.arrow_udf(ALIGNMENT)
def _aligned(local: pa.Array, candidate: pa.Array) -> pa.Array:
    return align_batch(local, candidate, False)


@F.arrow_udf(ALIGNMENT)
def _aligned_by_disc(local: pa.Array, candidate: pa.Array) -> pa.Array:
    return align_batch(local, candidate)


def aligned(pairs: DataFrame, local: str = "local_tracks", candidate: str = "tracks", by_disc: bool = True) -> DataFrame:
    """``pairs`` with ``alignment`` (array of local, candidate, cost).

    Where the local tracks have a field ``disc``, all of them know theirs and there are several,
    each disc is aligned with the whole candidate by itself.  Null lists are empty; two empty
    lists have an empty alignment.  Only the two lists are handed to Python, and nothing is
    aligned for a reader that takes other columns alone.
    """
    return pairs.withColumn("alignment", (_aligned_by_disc if by_disc else _aligned)(local, candidate))
