"""Parquet tables and the binding of catalogue tracks to the table ``part``.

A catalogue track is a row of ``part`` with derived columns; the derivation is stated once
and read in both SQL dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TRACK = """
p_partkey AS id,
CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS title,
CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS artist,
CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS album,
CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_brand END AS album_artist,
{split}(p_name, ' ') AS genre,
CASE WHEN p_size < 10 THEN 'MP3' WHEN p_size < 30 THEN 'FLAC' ELSE NULL END AS format,
p_partkey % 17 = 0 AS is_missing,
CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_size * 1000 END AS duration_ms,
CAST(CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 1980 + p_partkey % 40 END AS INT) AS year,
CAST(1 + p_partkey % 12 AS INT) AS track_no,
CAST(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 3 + p_partkey {div} 40 % 9 END AS INT) AS track_total,
CASE WHEN p_partkey % 3 = 0 THEN CAST(10000000 + p_partkey {div} 9 AS STRING) END AS barcode,
CASE WHEN p_partkey % 5 = 1 THEN concat('rel-', CAST(p_partkey {div} 20 AS STRING)) END AS mb_release_id,
CASE WHEN p_partkey % 2 = 0 THEN concat('cat-', CAST(p_partkey {div} 8 AS STRING)) END AS catalog_number,
CASE WHEN p_partkey % 4 < 3 THEN p_brand END AS label,
concat('lib/', p_brand, '/', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.mp3' ELSE '.flac' END) AS path,
p_partkey {div} 10 AS group_id,
p_partkey % 3 = 1 AS has_art,
p_partkey % 4 = 0 AS has_lyrics,
CASE WHEN p_partkey % 97 = 0 THEN 'unreadable' END AS probe_error,
CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_retailprice END AS rg_track_gain,
CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE concat('fp', CAST(p_partkey AS STRING)) END AS fingerprint,
p_partkey * 7919 % 100003 AS size_bytes,
p_partkey % 500 AS added
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [e.strip() for e in _TRACK.format(split="split", div="div").strip().split(",\n")]
    return table(spark, sf_dir, "part").selectExpr(*exprs)


#: The same rows as a common table expression of the other dialect.
TRACKS = "tracks AS (SELECT " + _TRACK.format(split="string_split", div="//").replace("AS STRING", "AS VARCHAR").strip() + " FROM part)"

_GROUP = """
g AS id,
CASE WHEN g % 5 = 0 THEN 'partial_album' WHEN g % 3 = 0 THEN 'singleton' WHEN g % 11 = 0 THEN 'unknown' ELSE 'album' END AS kind,
g % 4 = 0 AS is_pinned,
CASE WHEN g % 6 = 0 THEN NULL ELSE CAST(g % 11 AS DOUBLE) / 10 END AS confidence,
CASE WHEN g % 2 = 0 THEN concat('rel-', CAST(g AS STRING)) END AS mb_release_id,
CASE WHEN g % 3 = 0 THEN 'matched' ELSE 'unmatched' END AS match_state
"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work units: one for each group_id of tracks."""
    exprs = [e.strip() for e in _GROUP.strip().split(",\n")]
    return table(spark, sf_dir, "part").selectExpr("p_partkey div 10 AS g").distinct().selectExpr(*exprs)


GROUPS = "groups AS (SELECT " + _GROUP.replace("AS STRING", "AS VARCHAR").strip() + " FROM (SELECT DISTINCT p_partkey // 10 AS g FROM part))"
