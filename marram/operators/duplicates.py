"""Duplicates by shared recordings: evidence, confidence, reconciliation with what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.sources.shared import written
from marram.sources.versioned import BUCKETS, KeyedTable

from .ordered import best_match


def claimed(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """Live tracks under the recording of their best match."""
    return best_match(matches).select("track_id", "mb_recording_id").join(tracks.filter("not is_missing").select(F.col("id").alias("track_id"), "duration_ms", "format", "size_bytes"), "track_id")


def duration_factor(share: Column) -> Column:
    """How far a spread of durations (percent of their mean) lowers the confidence."""
    return F.when(share.isNull(), 0.8).when(share <= 5, 1.0).when(share <= 10, 0.8).when(share <= 20, 0.5).otherwise(0.3)


def confidence_class(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.5, "medium").otherwise("low")


def evidence(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row for each recording that two or more live tracks claim.

    A member's score is its first stored match for the recording.  All aggregates are
    counts, sums and bounds, so a recording with very many members is combined before the
    shuffle.
    """
    members = claimed(matches, tracks)
    first = Window.partitionBy("track_id", "mb_recording_id").orderBy("id")
    scores = matches.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("track_id", "mb_recording_id", "score")
    groups = members.join(scores, ["track_id", "mb_recording_id"]).groupBy("mb_recording_id").agg(
        F.count("*").alias("members"),
        F.avg("score").alias("mean_score"),
        F.min("duration_ms").alias("shortest"),
        F.max("duration_ms").alias("longest"),
        F.avg("duration_ms").alias("mean_duration"),
        F.countDistinct("format").alias("formats"),
    )
    spread = F.col("longest") - F.col("shortest")
    found = groups.filter("members >= 2").withColumn("spread_ms", spread).withColumn("spread_percent", 100 * spread / F.nullif("mean_duration", F.lit(0.0)))
    found = found.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_score") * duration_factor(F.col("spread_percent")))))
    wide = lambda share: (F.col("confidence") < 0.5) | F.coalesce(F.col("spread_percent") > share, F.lit(False))
    return found.withColumns({"label": confidence_class(F.col("confidence")), "is_uncertain": wide(10), "is_false_positive": wide(20)})


def quality(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """(mb_recording_id, track_id, format, duration_ms, size_bytes): the facts that members of groups are compared by."""
    own = claimed(matches, tracks)
    size = own.groupBy("mb_recording_id").agg(F.count("*").alias("n")).filter("n >= 2").select("mb_recording_id")
    return own.join(size, "mb_recording_id", "left_semi").select("mb_recording_id", "track_id", "format", "duration_ms", "size_bytes")


def reconcile(new: DataFrame, known: DataFrame, key: str = "mb_recording_id") -> DataFrame:
    """(key, action): created, updated, removed, or kept dismissed, over the union of keys.

    A dismissed group stays as it is, whether it would be found again or not.
    """
    n, k = new.select(key, F.lit(True).alias("found")), known.select(key, F.coalesce("dismissed", F.lit(False)).alias("dismissed"), F.lit(True).alias("stored"))
    action = F.when(F.col("dismissed"), "dismissed_skipped").when(F.col("stored").isNull(), "created").when(F.col("found").isNull(), "removed").otherwise("updated")
    return n.join(k, key, "full_outer").select(key, action.alias("action"))


def members(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """(mb_recording_id, track_id) of the groups of two or more."""
    own = claimed(matches, tracks).select("mb_recording_id", "track_id")
    size = own.groupBy("mb_recording_id").agg(F.count("*").alias("n")).filter("n >= 2").select("mb_recording_id")
    return own.join(size, "mb_recording_id", "left_semi")


def stale_members(stored: DataFrame, now: DataFrame) -> DataFrame:
    return stored.join(now, ["mb_recording_id", "track_id"], "left_anti")


def visible(groups: DataFrame, limit: int = 100) -> DataFrame:
    """Groups that are not dismissed, the newest first."""
    return groups.filter(~F.coalesce("dismissed", F.lit(False))).orderBy(F.desc("id")).limit(limit)


#: Columns of a stored group beside its key and whether it is dismissed.
EVIDENCE = "members long, mean_score double, spread_ms long, spread_percent double, formats long, confidence double, label string, is_uncertain boolean, is_false_positive boolean"


class DuplicateStore:
    """Duplicate groups and their members, as two keyed tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.groups = KeyedTable(spark, f"{root}/groups", f"mb_recording_id string, {EVIDENCE}, dismissed boolean", ["mb_recording_id"], buckets)
        self.members = KeyedTable(spark, f"{root}/members", "mb_recording_id string, track_id long", ["mb_recording_id", "track_id"], buckets)

    def dismiss(self, keys: DataFrame, dismissed: bool = True) -> None:
        """Dismiss the groups of ``keys`` (mb_recording_id), or take them up again."""
        self.groups.merge(self.groups.read().join(keys, "mb_recording_id", "left_semi").withColumn("dismissed", F.lit(dismissed)))

    def run(self, matches: DataFrame, tracks: DataFrame) -> dict[str, int]:
        """Detect duplicates anew and store what changes: groups that no longer qualify go, dismissed ones stay.

        Gives the numbers of groups created, updated (found and there before), removed and
        dismissed_skipped.  The same matches again change no stored row.
        """
        key = "mb_recording_id"
        found = written(evidence(matches, tracks), "duplicate-evidence")
        actions = written(reconcile(found, self.groups.read()), "duplicate-actions")
        open_ = actions.filter("action in ('created', 'updated')").select(key)
        names = [c.split()[0] for c in EVIDENCE.split(", ")]
        put = found.join(open_, key, "left_semi").select(key, *names).withColumns({"dismissed": F.lit(False), "removed": F.lit(False)})
        gone = actions.filter("action = 'removed'").select(key)
        drop = self.groups.read().join(gone, key, "left_semi").withColumn("removed", F.lit(True))
        now = written(members(matches, tracks).join(open_, key, "left_semi"), "duplicate-members")
        # Members of dismissed groups stay with them.
        stored = self.members.read().join(actions.filter("action <> 'dismissed_skipped'").select(key), key, "left_semi")
        left = stale_members(stored, now).withColumn("removed", F.lit(True))
        self.groups.merge(put.unionByName(drop))
        self.members.merge(now.withColumn("removed", F.lit(False)).unionByName(left))
        count = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        return {k: count.get(k, 0) for k in ("created", "updated", "removed", "dismissed_skipped")}
