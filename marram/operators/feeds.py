"""Feeds, queues, inboxes, cache entries and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import phrase
from .ordered import beyond_newest, first_per_key, neighbours_in_order

#: Order of inbox states, those shown only if asked for, those still open.
STATE_RANK = {"needs_attention": 0, "failed": 0, "preparing": 1, "ready": 2, "applying": 3, "partially_applied": 4, "applied": 5, "discarded": 6}
HIDDEN_STATES = ("applied", "discarded")
ACTIVE_STATES = ("preparing", "ready", "needs_attention", "applying")
#: Columns that an inbox search looks at.
INBOX_SEARCHED = ("title", "filename", "path", "candidate_source", "candidate_title", "candidate_artist", "candidate_album", "issue_message")
#: Days that an answer stays fresh, by operation; then it may serve while stale.
TTL_DAYS = {"get_release": 30, "search_releases": 7, "get_lyrics": 90, "get_art": 7, "fingerprint_lookup": 180}
GRACE_DAYS = 30
#: States in which a job stays.
TERMINAL_STATES = ("succeeded", "failed", "cancelled")


def activity(sources: dict[str, DataFrame], cursor: tuple | None = None, limit: int = 50) -> DataFrame:
    """The newest rows of several sources (id, created_at, state, detail) as one feed.

    Ordered by time, then by the text ``kind:id``, both falling.  Each source is cut to a
    page and one row before the union, so only that much is merged.
    """
    size = max(1, min(limit, 100)) + 1
    order = [F.desc("created_at"), F.desc("key")]

    def part(kind: str, df: DataFrame) -> DataFrame:
        rows = df.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("key"), "created_at", "state", "detail")
        if cursor is not None:
            at, key = cursor
            rows = rows.filter((F.col("created_at") < F.lit(at)) | ((F.col("created_at") == F.lit(at)) & (F.col("key") < key)))
        return rows.orderBy(*order).limit(size)

    return reduce(DataFrame.unionByName, [part(k, df) for k, df in sources.items()]).orderBy(*order).limit(size)


#: The order of the inbox, and the states that still wait for a review.
INBOX_ORDER = ["issue_rank", "state_rank", "id"]
UNREVIEWED = ("ready", "needs_attention")


def state_rank(c: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), STATE_RANK.items(), F.when(F.lit(False), 0)).otherwise(99)


def decode_inbox_cursor(text: str) -> tuple[int, int, int]:
    """The parts of ``issue_rank:state_rank:id``; anything else is an error."""
    parts = text.split(":")
    if len(parts) != 3 or not all(p.strip().lstrip("-").isdigit() for p in parts):
        raise ValueError(f"not an inbox cursor: {text!r}")
    return tuple(int(p) for p in parts)


def selected(entries: DataFrame, states: list[str] | None = None, label: str = "", q: str = "", issue: str = "", source: str = "", session: str = "") -> DataFrame:
    """The entries of an inbox with issue_rank and state_rank; finished states only if asked for.

    ``session`` is the number of an import session, or ``none`` for entries outside any; any
    other text is an error.  ``q`` is a phrase in one of INBOX_SEARCHED.
    """
    rows = entries.filter(F.col("state").isin(states)) if states else entries.filter(~F.col("state").isin(*HIDDEN_STATES))
    if source:
        rows = rows.filter(F.col("candidate_source") == source)
    if issue:
        rows = rows.filter(F.col("issue_kind") == issue)
    if label:
        rows = rows.filter(F.lower("confidence_label") == label.replace("_", " ").strip().lower())
    if session == "none":
        rows = rows.filter("import_session_id is null")
    elif session:
        if not session.strip().lstrip("-").isdigit():
            raise ValueError(f"not an import session: {session!r}")
        rows = rows.filter(F.col("import_session_id") == int(session))
    if (found := phrase(q, INBOX_SEARCHED)) is not None:
        rows = rows.filter(found)
    return rows.withColumn("issue_rank", F.when(F.col("issue_kind").isNotNull(), 0).otherwise(1)).withColumn("state_rank", state_rank(F.col("state")))


def inbox(entries: DataFrame, cursor: tuple[int, int, int] | None = None, limit: int = 50, **filters) -> DataFrame:
    """A page of the inbox of :func:`selected` entries: those with an issue first, then by state and id."""
    rows = selected(entries, **filters)
    if cursor is not None:
        at = F.struct(*[F.lit(x).cast("bigint" if k == 2 else "int") for k, x in enumerate(cursor)])
        rows = rows.filter(F.struct("issue_rank", "state_rank", "id") > at)
    return rows.orderBy(*INBOX_ORDER).limit(limit + 1)


def inbox_neighbours(entries: DataFrame, **filters) -> DataFrame:
    """(id, previous_id, next_id, next_open_id) of every entry of an inbox, in its order."""
    return neighbours_in_order(selected(entries, **filters), INBOX_ORDER, "id", F.col("state").isin(*UNREVIEWED))


def neighbours_of(entries: DataFrame, id_: int, **filters) -> tuple[int | None, int | None, int | None]:
    """(previous, next, next open id) of one entry of an inbox; an id that is not in it is an error."""
    rows = selected(entries, **filters).select(*INBOX_ORDER, "state")
    own = rows.filter(F.col("id") == id_).first()
    if own is None:
        raise ValueError(f"review {id_} is not in the selected inbox")
    kinds = dict(rows.dtypes)
    here = F.struct(*[F.lit(own[c]).cast(kinds[c]).alias(c) for c in INBOX_ORDER])
    at = F.struct(*INBOX_ORDER)
    ahead = at > here
    found = rows.agg(F.max(F.when(at < here, at)).alias("p"), F.min(F.when(ahead, at)).alias("n"), F.min(F.when(ahead & F.col("state").isin(*UNREVIEWED), at)).alias("o")).first()
    return tuple(x["id"] if x else None for x in found)


def active_bundle(bundles: DataFrame, logical_key) -> DataFrame:
    """The review of a logical key that is still open."""
    return bundles.filter((F.col("logical_key") == logical_key) & F.col("state").isin(*ACTIVE_STATES))


def current_revision(revisions: DataFrame, bundles: DataFrame) -> DataFrame:
    """The current revision of each of the reviews."""
    return revisions.filter("is_current").join(bundles.select(F.col("id").alias("bundle_id")), "bundle_id", "left_semi")


def first_issue() -> Column:
    """struct(kind, message) of a review's first issue, or null.

    The review has ``error``, ``attempts`` (array of kind, state, error) and ``operations``
    (array of collision, collision_path, conflicting, errors).  Its own error comes first,
    unless a failed attempt has the same message; then failed attempts, then operations.
    """
    failed = F.filter("attempts", lambda a: a["state"].isin("transient_failure", "permanent_failure"))
    tasks = F.transform(failed, lambda a: F.struct(F.lit("task").alias("kind"), F.coalesce(F.nullif(a["error"], F.lit("")), F.concat(a["kind"], F.lit(" could not be completed"))).alias("message")))
    own = F.when((F.col("error") != "") & ~F.exists(tasks, lambda t: t["message"] == F.col("error")), F.array(F.struct(F.lit("review").alias("kind"), F.col("error").alias("message"))))

    def said(o):
        where = F.when(o["collision_path"] != "", F.concat(F.lit("Destination collision: '"), o["collision_path"], F.lit("'"))).otherwise("Path collision")
        ids = F.when(F.size(o["conflicting"]) > 0, F.concat(F.lit("conflicts with track(s) ["), F.array_join(F.array_sort(o["conflicting"]).cast("array<string>"), ", "), F.lit("]")))
        errors = F.when(F.size(o["errors"]) > 0, F.array_join(o["errors"], "; "))
        return F.struct(F.when(o["collision"], "collision").otherwise("review").alias("kind"), F.when(o["collision"], F.concat_ws(" \u2014 ", where, ids, errors)).otherwise(errors).alias("message"))

    bad = F.transform(F.filter("operations", lambda o: o["collision"] | (F.size(o["errors"]) > 0)), said)
    none = F.array().cast("array<struct<kind:string,message:string>>")
    return F.get(F.concat(F.coalesce(own, none), F.coalesce(tasks, none), F.coalesce(bad, none)), F.lit(0))


def job_events(events: DataFrame, jobs: DataFrame, job_id: int, after: int) -> DataFrame:
    """(seq, kind, payload): a job's events behind a cursor, then its end if it has ended.

    The last row is (null, done, state) once the job is in a terminal state, and
    (null, error, 'job not found') where there is no such job.
    """
    behind = events.filter((F.col("job_id") == job_id) & (F.col("seq") > after)).select(F.col("seq").cast("long").alias("seq"), "kind", "payload")
    own = jobs.filter(F.col("id") == job_id).agg(F.max("state").alias("state"))
    end = own.select(F.lit(None).cast("long").alias("seq"), F.when(F.col("state").isNull(), "error").otherwise("done").alias("kind"), F.coalesce("state", F.lit("job not found")).alias("payload"))
    return behind.unionByName(end.filter((F.col("kind") == "error") | F.col("payload").isin(*TERMINAL_STATES))).orderBy(F.col("seq").asc_nulls_last())


def jobs_page(jobs: DataFrame, state: str = "", before: int | None = None, limit: int = 50) -> DataFrame:
    rows = jobs.filter("type <> 'retention_sweep'")
    if state:
        rows = rows.filter(F.col("state") == state)
    if before is not None:
        rows = rows.filter(F.col("id") < before)
    return rows.orderBy(F.desc("id")).limit(limit + 1)


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.filter("state = 'queued'").orderBy(F.desc("priority"), "created_at", "id").limit(1)


def expired_leases(jobs: DataFrame, as_of) -> DataFrame:
    return jobs.filter((F.col("state") == "running") & (F.col("lease_until").isNull() | (F.col("lease_until") <= F.lit(as_of))))


def freshness(entries: DataFrame, as_of: Column, version: int) -> DataFrame:
    """Cache entries with ``status``: fresh, stale (still of use), expired, or of another version."""
    late = F.col("expires_at") <= as_of
    status = F.when(F.col("schema_version") != version, "other_version").when(~late, "fresh").when(F.col("expires_at") + F.expr(f"INTERVAL {GRACE_DAYS} DAYS") > as_of, "stale").otherwise("expired")
    return entries.withColumn("status", status)


def put(entries: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Entries after an upsert: the latest row of each key."""
    return first_per_key(entries.unionByName(incoming), keys, [F.desc(at)])


def expiry(operation: Column, created: Column) -> Column:
    days = F.element_at(F.create_map(*[x for k, v in TTL_DAYS.items() for x in (F.lit(k), F.lit(v))]), operation)
    return created + F.make_dt_interval(days)


def retention(rows: DataFrame, run: str, at: str, cutoff: Column, keep: int, protected: DataFrame) -> DataFrame:
    """(run, reason) of runs to drop: too old, or beyond the newest ``keep``; protected ones stay."""
    old = rows.groupBy(run).agg(F.max(at).alias("_last")).filter(F.col("_last") < cutoff).select(run)
    many = beyond_newest(rows, run, at, keep).select(run)
    both = old.withColumn("age", F.lit(True)).join(many.withColumn("count", F.lit(True)), run, "full_outer")
    reason = F.when(F.col("age") & F.col("count"), "age+count").when(F.col("age"), "age").otherwise("count")
    return both.join(protected.select(run).distinct(), run, "left_anti").select(run, reason.alias("reason"))


def mixed_groups(df: DataFrame, key: str, inside: Column) -> DataFrame:
    """Keys with members both inside and outside."""
    return df.groupBy(key).agg(F.bool_or(inside).alias("i"), F.bool_or(~inside).alias("o")).filter("i and o").select(key)


def progress(tasks: DataFrame, key: str) -> DataFrame:
    """(key, done, total, running): the running stage that comes first."""
    return tasks.groupBy(key).agg(F.count_if(F.col("state") == "done").alias("done"), F.count("*").alias("total"), F.min(F.when(F.col("state") == "running", F.struct("position", "stage"))).alias("r")).select(key, "done", "total", F.col("r.stage").alias("running"))


def decision_counts(operations: DataFrame, key: str) -> DataFrame:
    return operations.groupBy(key).agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "pending", "rejected")])


def last_job(manifests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Manifest rows with the state of the last job that their JSON list names."""
    last = F.element_at(F.filter(F.from_json("manifest", "array<bigint>"), lambda x: x.isNotNull()), -1)
    return manifests.withColumn("job_id", last).join(jobs.select(F.col("id").alias("job_id"), F.col("state").alias("job_state")), "job_id", "left")
