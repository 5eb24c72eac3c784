"""Revisions, keyed merges and status folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import first_per_key


def keyed_merge(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` whose key does not come in, and all rows that do; null keys are equal."""
    named = incoming.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = part if same is None else same & part
    return current.join(named, same, "left_anti").unionByName(incoming)


def precedence_merge(manual: DataFrame, candidate: DataFrame, force: bool) -> DataFrame:
    """Edits of both hands; where both set a field (whatever the track) the candidate wins only by force.

    Without ``force`` such fields are answered as conflicts.
    """
    shared = manual.select("field").intersect(candidate.select("field"))
    if force:
        return manual.join(shared, "field", "left_anti").withColumn("origin", F.lit("manual")).unionByName(candidate.withColumn("origin", F.lit("candidate")))
    mark = shared.withColumn("both", F.lit(True))
    both = manual.withColumn("origin", F.lit("manual")).unionByName(candidate.withColumn("origin", F.lit("candidate"))).join(mark, "field", "left")
    return both.withColumn("origin", F.when(F.col("both"), "conflict").otherwise(F.col("origin"))).drop("both")


def idempotent(revisions: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """Revisions without those that repeat a sibling's content (same parent and digest)."""
    return first_per_key(revisions, [*keys, digest], [F.asc(order)])


def carry_decisions(old: DataFrame, new: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """Rows of ``new`` with the decisions of equal rows of ``old``, first to first; else pending."""
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(key, content).orderBy(order)))
    given = nth(old).select(key, content, "nth", "decision")
    return nth(new).join(given, [key, content, "nth"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending"))).drop("nth")


def undo_expired(runs: DataFrame, attempts: DataFrame, journals: DataFrame) -> DataFrame:
    """Applied runs with an applied track that no journal covers."""
    bare = attempts.filter("state = 'applied'").select("run_id", "track_id").join(journals.select("run_id", "track_id"), ["run_id", "track_id"], "left_anti")
    return runs.filter("state = 'applied'").join(bare, "run_id", "left_semi").select("run_id")


def retryable(attempts: DataFrame, key: str) -> DataFrame:
    """Items whose latest attempt failed for a passing reason."""
    return first_per_key(attempts, [key], [F.desc("attempt_no")]).filter("outcome = 'transient_failure'").select(key)


def newest_active(reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """(review_id, job_id): of each review's list of jobs the last that is active.

    Where the review was applied, the last that exists.
    """
    listed = reviews.select("review_id", "applied", F.posexplode("job_ids").alias("pos", "job_id"))
    known = listed.join(jobs.select(F.col("id").alias("job_id"), "state"), "job_id").filter(F.col("applied") | F.col("state").isin("queued", "running"))
    return known.groupBy("review_id").agg(F.max(F.struct("pos", "job_id")).alias("m")).select("review_id", F.col("m.job_id").alias("job_id"))


def overlapping(reviews: DataFrame) -> DataFrame:
    """(track_id, reviews, first, last) of the tracks that several open reviews touch.

    A track's reviews are counted, not paired with each other.
    """
    touched = reviews.filter("open").select("review_id", F.explode("track_ids").alias("track_id")).distinct()
    return touched.groupBy("track_id").agg(F.count("*").alias("reviews"), F.min("review_id").alias("first_review"), F.max("review_id").alias("last_review")).filter("reviews > 1")


def touched(reviews: DataFrame) -> DataFrame:
    """(review_id, track_id) of open reviews: their scope's tracks, their operations' targets and their snapshots' tracks."""
    lists = [F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in ("scope_ids", "target_ids", "snapshot_ids")]
    return reviews.filter("open").select("review_id", F.explode(F.array_distinct(F.flatten(F.array(*lists)))).alias("track_id")).filter("track_id is not null")


def conflicts(reviews: DataFrame, review_id) -> DataFrame:
    """(track_id, review_id) of a review's tracks that other open reviews touch too."""
    every = touched(reviews)
    own = every.filter(F.col("review_id") == review_id).select("track_id")
    return every.filter(F.col("review_id") != review_id).join(own, "track_id", "left_semi").select("track_id", "review_id")


def provider_status(events: DataFrame, key: str) -> DataFrame:
    """State of each provider after its latest event of the newest generation, with its last success and error."""
    code = F.col("status")
    state = F.when(code == 429, "rate_limited").when((code < 400) | (code == 404), "operational").when(code.isin(401, 403), "invalid_credentials").otherwise("unavailable")
    good = F.col("state") == "operational"
    rows = events.withColumn("state", state)
    newest = rows.groupBy(key).agg(F.max("generation").alias("generation"))
    live = rows.join(newest, [key, "generation"], "left_semi")
    return live.groupBy(key).agg(
        F.max(F.struct("at", "id", "state")).alias("last"), F.max(F.when(good, F.col("at"))).alias("last_success"), F.max(F.when(~good, F.col("at"))).alias("last_error")
    ).select(key, F.col("last.state").alias("state"), "last_success", "last_error")


def request_counts(events: DataFrame, host: str) -> DataFrame:
    return events.groupBy(host, F.when(F.col("status") < 400, "success").otherwise("failure").alias("outcome")).agg(F.count("*").alias("n"))


def has_drifted(staged: Column, current: Column, readable: Column) -> Column:
    """Does a file differ from the tags that an edit was staged on?  Without a baseline it does not; unreadable it does."""
    return F.when(~readable, True).when(staged.isNull(), False).otherwise(~staged.eqNullSafe(current))


def edits(best: DataFrame, fields: list[str], id_: str) -> DataFrame:
    """(id, field, value) of the fields that are not null."""
    return best.select(id_, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(id_, fields, "field", "value").filter("value is not null")


#: Fields that a release, and the track of it that a local one is aligned with, give.
RELEASE_FIELDS = ("album", "album_artist", "year", "original_year", "label", "catalog_number", "barcode", "country", "media", "mb_release_id", "discogs_release_id")
TRACK_FIELDS = {"title": "title", "disc_no": "disc_number", "track_no": "position", "isrc": "isrc", "mb_track_id": "mb_track_id", "mb_recording_id": "mb_recording_id"}


def candidate_edits(chosen: DataFrame, id_: str = "id", track: str = "aligned") -> DataFrame:
    """(id, field, value) of what a chosen candidate says of a track.

    ``chosen`` has some of RELEASE_FIELDS and a struct of the aligned track, null where the
    local track has no partner; what is null gives no edit.
    """
    inside = chosen.schema[track].dataType.names
    cells = {f: F.col(f) for f in RELEASE_FIELDS if f in chosen.columns} | {f: F.col(track)[c] for f, c in TRACK_FIELDS.items() if c in inside}
    given = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in cells.items()])
    return chosen.select(id_, F.explode(given).alias("e")).select(id_, "e.*").filter("value is not null")


#: Where each review state may go.
TRANSITIONS = {
    "preparing": ("ready", "needs_attention", "failed", "discarded"),
    "ready": ("needs_attention", "applying", "discarded"),
    "needs_attention": ("ready", "applying", "discarded"),
    "applying": ("applied", "partially_applied", "failed"),
    "applied": (),
    "partially_applied": ("applying", "failed"),
    "failed": ("applying",),
    "discarded": ("ready", "needs_attention"),
}


def invalid_transitions(log: DataFrame, key: str, order: str) -> DataFrame:
    """Steps of a state log that the transitions do not allow."""
    allowed = F.create_map(*[x for s, to in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))])
    steps = log.select(key, order, "state", F.lag("state").over(Window.partitionBy(key).orderBy(order)).alias("before"))
    return steps.filter(F.col("before").isNotNull() & ~F.array_contains(F.element_at(allowed, F.col("before")), F.col("state")))
