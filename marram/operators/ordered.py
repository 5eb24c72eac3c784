"""Ordered analytics: first and latest rows, ranks, neighbours, interleaving, running states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.sources.shared import written


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` must be total.  Spark cuts each task's rows before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def best_match(matches: DataFrame) -> DataFrame:
    """The match with the highest score of each track; of equal ones the smallest id."""
    return first_per_key(matches, ["track_id"], [F.desc("score"), F.asc("id")])


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    return first_per_key(df, keys, [F.desc(by)])


def next_attempt(df: DataFrame, keys: list[str], attempt: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.max(attempt) + 1).alias("next_attempt"))


def beyond_newest(df: DataFrame, run: str, at: str, keep: int) -> DataFrame:
    """Runs ranked by their earliest time, newest first, without the first ``keep``; ties by run.

    The ranking is over runs, of which there are few beside rows: it keeps the newest
    ``keep`` as a top-k and drops them.
    """
    runs = df.groupBy(run).agg(F.min(at).alias("began"))
    newest = runs.orderBy(F.desc("began"), F.desc(run)).limit(keep)
    return runs.join(newest.select(run), run, "left_anti")


def numbered(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows with ``seq``: 1, 2, ... in each key."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def neighbours(df: DataFrame, key: str, order: list[Column], id_: str, reviewed: Column) -> DataFrame:
    """Previous, next and next unreviewed id of every row in its key's order.

    The next open id is the last one seen when the order is run backwards, so a row costs the
    same however long its key is.
    """
    numbered_ = df.withColumn("_open", F.when(~reviewed, F.col(id_))).withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    w = Window.partitionBy(key).orderBy(F.desc("_at"))
    behind = w.rowsBetween(Window.unboundedPreceding, -1)
    return numbered_.select(key, id_, F.lead(id_).over(w).alias("previous_id"), F.lag(id_).over(w).alias("next_id"), F.last("_open", ignorenulls=True).over(behind).alias("next_open_id"))


def neighbours_in_order(df: DataFrame, order: list[str], id_: str, open_: Column, parts: int | None = None) -> DataFrame:
    """(id, previous_id, next_id, next_open_id) of every row in one order over the whole table.

    ``order`` must be total.  Rows are dealt to ``parts`` by ranges of the order; neighbours
    are found inside a range, and what lies across its bounds comes from one row a range: its
    first, last and first open id.  No range is larger for a frequent value of the order, since
    the order is total.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*order, F.col(id_).alias("_id"), F.when(open_, F.col(id_)).alias("_open")).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "neighbour-ranges")
    w = Window.partitionBy("_part").orderBy(*[F.desc(c) for c in order])
    inside = dealt.select("_part", "_id", F.lead("_id").over(w).alias("p"), F.lag("_id").over(w).alias("n"), F.last("_open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("o"))
    at = F.struct(*order)
    ends = dealt.groupBy("_part").agg(F.min_by("_id", at).alias("first"), F.max_by("_id", at).alias("last"), F.min_by("_open", F.when(F.col("_open").isNotNull(), at)).alias("open"))
    # A row a range: as many as partitions.
    across = Window.orderBy(F.desc("_part"))
    ends = ends.select("_part", F.lead("last").over(across).alias("before"), F.lag("first").over(across).alias("after"), F.last("open", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("after_open"))
    joined = inside.join(F.broadcast(ends), "_part")
    return joined.select(F.col("_id").alias(id_), F.coalesce("p", "before").alias("previous_id"), F.coalesce("n", "after").alias("next_id"), F.coalesce("o", "after_open").alias("next_open_id"))


def rank_gap(df: DataFrame, key: str, value: str, id_: str) -> DataFrame:
    """The best two values of each key and their distance; null if there is one."""
    w = Window.partitionBy(key).orderBy(value, id_)
    best = df.select(key, F.col(value).alias("best"), F.lead(value).over(w).alias("second"), F.row_number().over(w).alias("r")).filter("r = 1")
    return best.select(key, "best", "second", (F.col("second") - F.col("best")).alias("gap"))


def interleave(df: DataFrame, source: str, position: str, order: dict[str, int], same: list[str], limit: int) -> DataFrame:
    """Round-robin over sources: first rows of each source, then second ones; repeats dropped.

    Sources follow ``order`` (others come first); of rows that agree in ``same`` the one that
    comes first stays.  Only the first rows of each source are read into the merge: as many as
    ``limit`` at first, and four times as many while repeats leave fewer than ``limit`` rows and
    a source has more.
    """
    place = F.create_map(*[x for s, k in order.items() for x in (F.lit(s), F.lit(k))])
    turn = F.row_number().over(Window.partitionBy(source).orderBy(position))
    deep = limit
    while True:
        # A row number under a bound is a top-k of each task before the shuffle.
        head = written(df.withColumn("turn", turn).filter(F.col("turn") <= deep).withColumn("place", F.element_at(place, F.col(source))), "interleave-heads")
        kept = first_per_key(head, same, [F.asc("turn"), F.asc("place")])
        if kept.count() >= limit or head.filter(F.col("turn") == deep).isEmpty():
            return kept.orderBy("turn", "place").limit(limit)
        deep *= 4


def keep_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Order-preserving removal of repeats."""
    return first_per_key(df, keys, [F.asc(position)])


def after_sequence(df: DataFrame, seq: str, last: int) -> DataFrame:
    """Replay: rows behind a sequence number, in order."""
    return df.filter(F.col(seq) > last).orderBy(seq)


def offset_page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows and the row behind it, which tells whether more follow."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
