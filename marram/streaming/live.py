"""Streams: ordered replay, coalesced progress, token buckets, incremental scans.

Every stateful step exists twice over one fold: in batches over rows sorted inside
partitions, holding one key's state and no group, and in streams with state kept by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marram.operators.changes import apply_changes
from marram.sources.versioned import KeyedTable

#: Seconds within which progress is held back.
COALESCE = 0.25


class Throttle:
    """Emit at least COALESCE after the last emission; hold the latest other row."""

    out = "at double, value double, flushed boolean"

    def __init__(self, state=None, seconds: float = COALESCE):
        self.last, self.held, self.seconds = (state or (None, None)) + (seconds,)

    def step(self, at: float, value: float) -> list[tuple]:
        if self.last is not None and at - self.last < self.seconds:
            self.held = (at, value)
            return []
        self.last, self.held = at, None
        return [(at, value, False)]

    def end(self) -> list[tuple]:
        held, self.held = self.held, None
        return [(*held, True)] if held else []

    def state(self) -> tuple:
        return self.last, self.held


class TokenBucket:
    """Seconds that each request waits for its token; requests are served in order."""

    out = "at double, wait double"

    def __init__(self, state=None, rate: float = 1.0, burst: float = 2.0):
        self.rate, self.burst = rate, burst
        self.last, self.tokens = state or (None, burst)

    def step(self, at: float, value: float) -> list[tuple]:
        now = at if self.last is None else max(at, self.last)
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        if self.tokens >= 1:
            self.last, self.tokens = now, self.tokens - 1
        else:
            self.last, self.tokens = now + (1 - self.tokens) / self.rate, 0.0
        return [(at, self.last - at)]

    def end(self) -> list[tuple]:
        return []

    def state(self) -> tuple:
        return self.last, self.tokens


def fold(rows: DataFrame, make: Callable[[], Throttle | TokenBucket]) -> DataFrame:
    """Fold (key, at, value) rows of each key in order of time; a key streams through one task."""
    names = [c.split()[0] for c in make().out.split(", ")]

    def run(frames: Iterator[pd.DataFrame]):
        key, state = None, None
        for pdf in frames:
            out = []
            for k, at, value in zip(pdf["key"], pdf["at"], pdf["value"], strict=True):
                if state is None or k != key:
                    out += [(key, *r) for r in (state.end() if state else [])]
                    key, state = k, make()
                out += [(k, *r) for r in state.step(at, value)]
            yield pd.DataFrame(out, columns=["key", *names])
        if state:
            yield pd.DataFrame([(key, *r) for r in state.end()], columns=["key", *names])

    return rows.select("key", "at", "value").repartition("key").sortWithinPartitions("key", "at", "value").mapInPandas(run, f"key {dict(rows.dtypes)['key']}, {make().out}")


def fold_stream(rows: DataFrame, make: Callable, restore: Callable) -> DataFrame:
    """The same over a stream; rows of a batch are taken in order of time.  What is held stays held."""
    names = [c.split()[0] for c in make().out.split(", ")]

    def run(key, frames, state):
        own = restore(state.get[0] and eval_state(state.get[0])) if state.exists else make()
        pdf = pd.concat(list(frames)).sort_values(["at", "value"], kind="stable")
        out = [(key[0], *r) for at, value in zip(pdf["at"], pdf["value"], strict=True) for r in own.step(at, value)]
        state.update((repr(own.state()),))
        yield pd.DataFrame(out, columns=["key", *names])

    return rows.groupBy("key").applyInPandasWithState(run, f"key {dict(rows.dtypes)['key']}, {make().out}", "state string", "append", GroupStateTimeout.NoTimeout)


def eval_state(text: str):
    import ast

    return ast.literal_eval(text)


class _Held(StatefulProcessor):
    """Progress of a key: when it was last emitted, and what is held back until then."""

    def __init__(self, seconds: float, names: list[str]):
        self.seconds, self.names = seconds, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")
        self.held = handle.getValueState("held", "at double, value double, due long")

    def _out(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        held = self.held.get() if self.held.exists() else None
        own = Throttle((last, held and held[:2]), self.seconds)
        pdf = pd.concat(list(rows)).sort_values(["at", "value"], kind="stable")
        out = [r for at, value in zip(pdf["at"], pdf["value"], strict=True) for r in own.step(at, value)]
        now, waiting = own.state()
        self.last.update((now,))
        if held is not None:
            self.handle.deleteTimer(held[2])
            self.held.clear()
        if waiting is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000)
            self.held.update((*waiting, due))
            self.handle.registerTimer(due)
        yield from self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            at, value, _ = self.held.get()
            self.held.clear()
            self.last.update((at,))
            yield from self._out(key, [(at, value, True)])

    def close(self) -> None:
        pass


def throttle_stream(rows: DataFrame, seconds: float = COALESCE) -> DataFrame:
    """(key, at, value, flushed): progress of each key, at most once in ``seconds``.

    What is held back comes out, flushed, once ``seconds`` have passed without a successor: a
    timer of processing time sees to that, so the last row of a quiet key is never lost.  The
    session's state store must be the one with column families (RocksDB).
    """
    schema = f"key {dict(rows.dtypes)['key']}, at double, value double, flushed boolean"
    names = ["key", "at", "value", "flushed"]
    return rows.select("key", "at", "value").groupBy("key").transformWithStateInPandas(_Held(seconds, names), schema, "append", "ProcessingTime")


def replay(stream: DataFrame, seq: str, after: int) -> DataFrame:
    """Events behind a cursor, as they arrive."""
    return stream.filter(F.col(seq) > after)


def incremental_scan(listing: DataFrame, catalog: DataFrame, target: str, root: str, checkpoint: str):
    """Apply every batch of a listing stream to a catalogue kept as numbered versions under ``target``.

    A batch writes version ``batch_id`` from the one before, so a batch that runs again writes
    the same version again.
    """
    spark = catalog.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        before = catalog if number == 0 else spark.read.parquet(f"{target}/v{number - 1}")
        seen = before.filter("missing_since is null").select("path", "size_bytes", "mtime").join(batch.select("path"), "path", "left_anti")
        listed = batch.select("path", "size_bytes", "mtime").unionByName(seen)
        apply_changes(listed, before, root, number).write.mode("overwrite").parquet(f"{target}/v{number}")

    return listing.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of a catalogue that a stream of listings keeps up to date.
CATALOG = "path string, size_bytes long, mtime long, missing_since long"


def keep_catalog(listing: DataFrame, table: KeyedTable, checkpoint: str, keep: int = 3):
    """Merge every batch of a listing stream (path, size_bytes, mtime) into a catalogue by path.

    A batch writes the buckets of its paths alone, and nothing where no row changes, so one that
    runs again changes nothing; the newest row of a path in a batch counts, and a path that is
    listed again is missing no more.  The latest ``keep`` versions stay.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max(F.struct("mtime", "size_bytes")).alias("m")).select("path", "m.size_bytes", "m.mtime", F.lit(None).cast("long").alias("missing_since"))
        table.merge(newest)
        table.expire(keep)

    return listing.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
