"""The driver's tables in the shapes that operators take, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.sources.tables import GROUPS, TRACKS, groups, table, tracks

__all__ = ["GROUPS", "JOBS", "MATCHES", "TRACKS", "attempts", "groups", "jobs", "matches", "split_list", "table", "tracks", "turns"]

MATCHES = "matches AS (SELECT event_id AS id, user_id AS track_id, concat(event_type, '-', CAST(user_id % 40 AS VARCHAR)) AS mb_recording_id, [concat('rel-', CAST(user_id % 9 AS VARCHAR)), concat('rel-', CAST(event_id % 23 AS VARCHAR))] AS mb_release_ids, value / 500 AS score FROM events)"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint matches over events: users are tracks, event types with a bucket are recordings."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS track_id", "concat(event_type, '-', CAST(user_id % 40 AS STRING)) AS mb_recording_id", "array(concat('rel-', CAST(user_id % 9 AS STRING)), concat('rel-', CAST(event_id % 23 AS STRING))) AS mb_release_ids", "value / 500 AS score"
    )


_JOB = "o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'running' END AS state, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, CASE WHEN o_orderkey % 50 = 0 THEN 'retention_sweep' ELSE 'scan' END AS type, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS lease_until, CAST(o_custkey AS STRING) AS detail"
JOBS = "jobs AS (SELECT " + _JOB.replace("STRING", "VARCHAR") + " FROM orders)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*split_list(_JOB))


def split_list(text: str) -> list[str]:
    """The expressions of a select list whose own commas stand in parentheses."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts over lineitem: an order's lines are the attempts of an item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_key"), F.col("l_linenumber").alias("attempt_no"), F.when(F.col("l_returnflag") == "R", "transient_failure").when(F.col("l_returnflag") == "A", "failed").otherwise("applied").alias("outcome"), "l_partkey"
    )
