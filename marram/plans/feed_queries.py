"""Scans, feeds, queues, retention and revisions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions.scalars import activity_state, review_label
from marram.operators import changes as X
from marram.operators import feeds as E
from marram.operators import ordered as O
from marram.operators import revisions as V
from marram.operators.search_index import PhraseIndex
from marram.sources import providers as P
from marram.sources.shared import shared_path

from .bindings import GROUPS, JOBS, MATCHES, TRACKS, attempts, jobs, matches, split_list, table, tracks
from .book import Book

Q = Book()

# Scans: part as it was (old) and as it is listed (new)
_OLD = "old AS (SELECT path, size_bytes, added AS mtime, id % 23 = 0 AS missing, CASE WHEN id % 23 = 0 THEN 5 END AS missing_since FROM tracks WHERE id % 5 <> 1)"
_NEW = "new AS (SELECT path, CASE WHEN id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, added AS mtime FROM tracks WHERE id % 11 <> 3)"
S = f"WITH {TRACKS}, {_OLD}, {_NEW} "
_BOTH = S.rstrip() + ", c AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'missing' WHEN n.size_bytes = o.size_bytes AND n.mtime = o.mtime AND NOT o.missing THEN 'unchanged' ELSE 'updated' END AS change, n.path IS NULL AND NOT coalesce(o.missing, false) AS newly_missing FROM new n FULL JOIN old o ON o.path = n.path) "


def _old(s, d):
    return tracks(s, d).filter("id % 5 <> 1").selectExpr("path", "size_bytes", "added AS mtime", "id % 23 = 0 AS missing", "CASE WHEN id % 23 = 0 THEN 5L END AS missing_since")


def _new(s, d):
    return tracks(s, d).filter("id % 11 <> 3").selectExpr("path", "CASE WHEN id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes", "added AS mtime")


Q.add("s4_scan_changes", lambda s, d: X.scan_changes(_new(s, d), _old(s, d), "lib"), _BOTH + "SELECT path, change, newly_missing FROM c")
_FAULTY = "CASE WHEN size_bytes % 3 = 0 THEN 'unreadable' END AS error"
_ERRED = S.rstrip() + ", c AS (SELECT CASE WHEN n.path IS NULL THEN 'missing' WHEN n.size_bytes = o.size_bytes AND n.mtime = o.mtime AND NOT o.missing THEN 'unchanged' WHEN n.size_bytes % 3 = 0 THEN 'errored' WHEN o.path IS NULL THEN 'added' ELSE 'updated' END AS change FROM new n FULL JOIN old o ON o.path = n.path) "
Q.add("s4_scan_stats", lambda s, d: X.scan_stats(X.scan_changes(_new(s, d).selectExpr("*", _FAULTY), _old(s, d), "lib")), _ERRED + "SELECT count(*) FILTER (change <> 'missing') AS scanned, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'errored') AS errored, count(*) FILTER (change = 'missing') AS missing FROM c")
Q.add("s5_apply_changes", lambda s, d: X.apply_changes(_new(s, d), _old(s, d), "lib", 9), S + "SELECT coalesce(n.path, o.path) AS path, coalesce(n.size_bytes, o.size_bytes) AS size_bytes, coalesce(n.mtime, o.mtime) AS mtime, CASE WHEN n.path IS NULL THEN coalesce(o.missing_since, 9) END::BIGINT AS missing_since FROM new n FULL JOIN old o ON o.path = n.path")
Q.add("s10_rescan_one", lambda s, d: X.scan_changes(_new(s, d).filter("path = 'lib/Brand#2/0.mp3'"), _old(s, d), "lib/Brand#2/0.mp3"), _BOTH + "SELECT path, change, newly_missing FROM c WHERE path = 'lib/Brand#2/0.mp3'")
_LISTED = "CASE id % 7 WHEN 0 THEN concat(path, '.cue') WHEN 1 THEN concat('lib/', CAST(id AS {s}), '/Cover.JPG') WHEN 2 THEN concat('lib/@eaDir/', CAST(id AS {s}), '.flac') WHEN 3 THEN concat('lib/', CAST(id AS {s}), '.AIFF') WHEN 4 THEN concat('lib/', CAST(id AS {s}), '/.git') ELSE path END AS path, id % 11 = 0 AS symlink"
_LISTING = f"WITH {TRACKS}, p AS (SELECT id, {_LISTED.replace('{s}', 'VARCHAR')} FROM tracks)"


def _listing(s, d):
    return tracks(s, d).selectExpr(*split_list(_LISTED.replace("{s}", "STRING")))


Q.add("s11_scope_preview", lambda s, d: X.preview(_listing(s, d), root="lib"), _LISTING + ", k AS (SELECT path, CASE WHEN symlink THEN 'symlink' WHEN id % 7 = 2 THEN 'excluded' WHEN id % 7 = 1 THEN 'sidecar' WHEN id % 7 IN (0, 4) THEN 'unsupported' ELSE 'supported' END AS class FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY path) AS r FROM k) SELECT class, count(*) AS n, string_agg(path, '|' ORDER BY path) FILTER (r <= 5) AS examples FROM r GROUP BY 1")
Q.add("s1_audio_files", lambda s, d: X.audio_only(_listing(s, d), "lib").select("path"), _LISTING + " SELECT path FROM p WHERE id % 7 IN (3, 5, 6)")
Q.add("s10_stale_matches", lambda s, d: X.stale_matches(matches(s, d).select("id", "track_id"), tracks(s, d).filter("id % 3 = 0").select(F.col("id").alias("track_id"))), f"WITH {MATCHES} SELECT id, track_id FROM matches WHERE track_id % 3 <> 0 OR track_id NOT IN (SELECT p_partkey FROM part)")
Q.add("s12_browse", lambda s, d: X.browse(tracks(s, d), "lib", 10), f"WITH {TRACKS} SELECT DISTINCT 'folder' AS kind, string_split(path, '/')[2] AS name FROM tracks ORDER BY lower(name), name LIMIT 11")


# Cache entries over events: the type is the operation
_CACHE = "c AS (SELECT event_id AS id, event_type AS operation, user_id AS query_hash, ts AS created_at, ts + INTERVAL 5 DAY AS expires_at, CAST(event_id % 2 AS INT) AS schema_version FROM events)"


def _cache(s, d):
    return table(s, d, "events").selectExpr("event_id AS id", "event_type AS operation", "user_id AS query_hash", "ts AS created_at", "ts + INTERVAL 5 DAYS AS expires_at", "CAST(event_id % 2 AS INT) AS schema_version")


_AS_OF = "TIMESTAMP '2024-02-10 00:00:00'"
Q.add("s13_freshness", lambda s, d: E.freshness(_cache(s, d), F.expr(_AS_OF), 1).select("id", "status"), f"WITH {_CACHE} SELECT id, CASE WHEN schema_version <> 1 THEN 'other_version' WHEN expires_at > {_AS_OF} THEN 'fresh' WHEN expires_at + INTERVAL 30 DAY > {_AS_OF} THEN 'stale' ELSE 'expired' END AS status FROM c")
Q.add("st6_pruned", lambda s, d: E.freshness(_cache(s, d), F.expr("TIMESTAMP '2024-02-20 00:00:00'"), 1).filter("status <> 'expired'").groupBy("status").agg(F.count("*").alias("n")), f"WITH {_CACHE} SELECT CASE WHEN schema_version <> 1 THEN 'other_version' WHEN expires_at > TIMESTAMP '2024-02-20' THEN 'fresh' ELSE 'stale' END AS status, count(*) AS n FROM c WHERE schema_version <> 1 OR expires_at + INTERVAL 30 DAY > TIMESTAMP '2024-02-20' GROUP BY 1")
Q.add("s14_put", lambda s, d: E.put(_cache(s, d).filter("id % 3 > 0"), _cache(s, d).filter("id % 3 = 0"), ["operation", "query_hash"], "id").select("id", "operation", "query_hash"), f"WITH {_CACHE} SELECT max(id) AS id, operation, query_hash FROM c GROUP BY 2, 3")
_OPERATION = "CASE event_type WHEN 'click' THEN 'search_releases' WHEN 'view' THEN 'get_release' WHEN 'purchase' THEN 'get_lyrics' WHEN 'error' THEN 'get_art' ELSE 'fingerprint_lookup' END"
Q.add("s14_expiry", lambda s, d: table(s, d, "events").select("event_id", E.expiry(F.expr(_OPERATION), F.col("ts")).alias("expires_at")), "SELECT event_id, ts + CASE event_type WHEN 'click' THEN INTERVAL 7 DAY WHEN 'view' THEN INTERVAL 30 DAY WHEN 'purchase' THEN INTERVAL 90 DAY WHEN 'error' THEN INTERVAL 7 DAY ELSE INTERVAL 180 DAY END AS expires_at FROM events")

# Provider answers
_JSON = "concat('{\"id\":\"r', CAST(id AS {s}), '\",\"title\":\"', coalesce(album, ''), '\",\"date\":\"', coalesce(CAST(year AS {s}), ''), '-02\",\"barcode\":\"', coalesce(barcode, ''), '\",\"country\":\"XW\",\"artist-credit\":[{\"name\":\"', coalesce(artist, ''), '\",\"joinphrase\":\" & \"},{\"name\":\"B\"}],\"media\":[{\"tracks\":[{\"title\":\"t1\",\"length\":', CAST(id AS {s}), '}]},{\"tracks\":[{\"title\":\"t2\"}]}]}')"
Q.add("s15_candidates", lambda s, d: P.candidates(tracks(s, d).selectExpr("'musicbrainz' AS source", _JSON.replace("{s}", "STRING") + " AS payload")).select("source", "ref_id", "album", "album_artist", "year", "barcode", "country", F.size("tracks").alias("n_tracks"), F.col("tracks")[0]["duration_ms"].alias("first_ms")), f"WITH {TRACKS} SELECT 'musicbrainz' AS source, 'r' || id AS ref_id, coalesce(album, '') AS album, coalesce(artist, '') || ' & B' AS album_artist, year, coalesce(barcode, '') AS barcode, 'XW' AS country, 2 AS n_tracks, id AS first_ms FROM tracks")
_DISCOGS = "concat('{\"id\":', CAST(id AS {s}), ',\"title\":\"', coalesce(album, ''), '\",\"year\":', CAST(1960 + id % 60 AS {s}), ',\"country\":\"DE\",\"artists\":[{\"name\":\"', coalesce(artist, ''), '\"},{\"name\":\"B\"}],\"identifiers\":[{\"type\":\"Matrix\",\"value\":\"m\"},{\"type\":\"Barcode\",\"value\":\"0 12-3\"}],\"tracklist\":[{\"title\":\"t1\",\"duration\":\"3:05\"},{\"title\":\"t2\",\"duration\":\"\"}]}')"
_DEEZER = "concat('{\"id\":', CAST(id AS {s}), ',\"title\":\"', coalesce(album, ''), '\",\"upc\":\"77\",\"release_date\":\"', CAST(1960 + id % 60 AS {s}), '-01-02\",\"artist\":{\"name\":\"', coalesce(artist, ''), '\"},\"tracks\":{\"data\":[{\"title\":\"t1\",\"duration\":', CAST(id AS {s}), '}]}}')"
_CELLS = ("source", "ref_id", "album", "album_artist", "year", "barcode", "country")
for _source, _text, _own in (("discogs", _DISCOGS, "coalesce(artist, '') || ', B' AS album_artist, (1960 + id % 60)::INT AS year, '0123' AS barcode, 'DE' AS country, 2 AS n_tracks, 185000::BIGINT AS first_ms"), ("deezer", _DEEZER, "coalesce(artist, '') AS album_artist, (1960 + id % 60)::INT AS year, '77' AS barcode, NULL::VARCHAR AS country, 1 AS n_tracks, id * 1000 AS first_ms")):
    Q.add(f"s15_{_source}", lambda s, d, n=_source, t=_text: P.candidates(tracks(s, d).selectExpr(f"'{n}' AS source", t.replace("{s}", "STRING") + " AS payload")).select(*_CELLS, F.size("tracks").alias("n_tracks"), F.col("tracks")[0]["duration_ms"].alias("first_ms")), f"WITH {TRACKS} SELECT '{_source}' AS source, CAST(id AS VARCHAR) AS ref_id, coalesce(album, '') AS album, {_own} FROM tracks")
_LRC = "concat('{\"id\":1,\"plainLyrics\":\"la\"', CASE WHEN id % 3 = 0 THEN ',\"syncedLyrics\":\"[00:01.00]la\"' ELSE '' END, CASE WHEN id % 2 = 0 THEN ',\"instrumental\":true' ELSE '' END, '}')"
Q.add("s15_lyrics", lambda s, d: P.lyrics(tracks(s, d).selectExpr("id AS track_id", _LRC + " AS payload")), f"WITH {TRACKS} SELECT id AS track_id, CASE WHEN id % 3 = 0 THEN '[00:01.00]la' ELSE 'la' END AS lyrics, id % 3 = 0 AS synced, id % 2 = 0 AS instrumental FROM tracks")
_FP = "concat('{\"status\":\"ok\",\"results\":[{\"score\":0.5,\"recordings\":[{\"id\":\"a', CAST(id % 10 AS {s}), '\",\"releases\":[{\"id\":\"x\"},{\"id\":\"\"}]},{\"id\":\"\"},{\"releases\":[]}]},{\"score\":0.25,\"recordings\":[{\"id\":\"b\"}]}]}')"
Q.add("s16_fingerprints", lambda s, d: P.fingerprint_matches(tracks(s, d).selectExpr("id AS track_id", _FP.replace("{s}", "STRING") + " AS payload")).select("track_id", "mb_recording_id", F.array_join("mb_release_ids", ",").alias("releases"), "score"), f"WITH {TRACKS} SELECT id AS track_id, 'a' || (id % 10) AS mb_recording_id, 'x' AS releases, 0.5::DOUBLE AS score FROM tracks UNION ALL SELECT id, 'b', '', 0.25 FROM tracks")
Q.add("b18_loudness", lambda s, d: P.loudness(table(s, d, "nation").select(F.col("n_name").alias("Filename"), F.concat(F.lit("-"), F.col("n_nationkey").cast("string"), F.lit(".5 dB")).alias("Gain (dB)"), F.lit("0.9").alias("Peak")).unionByName(s.createDataFrame([("Album", "-7.25 dB", "1.0")], "Filename string, `Gain (dB)` string, Peak string"))), "SELECT n_name AS path, -(n_nationkey + 0.5)::DOUBLE AS gain, 0.9::DOUBLE AS peak, -7.25::DOUBLE AS album_gain, 1.0::DOUBLE AS album_peak FROM nation")
Q.add("e20_outcomes", lambda s, d: table(s, d, "nation").select("n_nationkey", P.outcome(F.col("n_regionkey") > 0, F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") % 3).alias("outcome")), "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'not_configured' WHEN n_nationkey % 5 = 0 THEN 'failed' WHEN n_nationkey % 3 = 0 THEN 'zero_results' ELSE 'results' END AS outcome FROM nation")
_ASKED = {"offline": "event_id % 11 = 0", "refresh": "event_id % 5 = 0", "fresh": "CASE WHEN event_id % 4 = 0 THEN event_id % 3 END", "stale": "CASE WHEN event_id % 2 = 0 THEN event_id % 3 END", "failed": "event_id % 7 < 3", "hits": "event_id % 6"}
Q.add("e20_cached_outcomes", lambda s, d: table(s, d, "events").select("event_id", P.retrieval_outcome(*[F.expr(x) for x in _ASKED.values()]).alias("o")).select("event_id", "o.*"), "WITH a AS (SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in _ASKED.items()) + " FROM events), b AS (SELECT event_id, failed, CASE WHEN offline THEN 'offline cache (stale)' WHEN NOT refresh AND fresh IS NOT NULL THEN 'cache' WHEN NOT failed THEN 'live' WHEN coalesce(stale, 0) > 0 THEN 'stale cache' ELSE 'search failed' END AS way, CASE way WHEN 'offline cache (stale)' THEN coalesce(stale, 0) WHEN 'cache' THEN fresh WHEN 'live' THEN hits WHEN 'stale cache' THEN stale ELSE 0 END AS n FROM a) SELECT event_id, CASE WHEN way = 'search failed' THEN 'failed' WHEN n > 0 THEN 'results' ELSE 'zero_results' END AS status, n::BIGINT AS results, CASE WHEN way = 'search failed' OR n > 0 AND way <> 'live' THEN way END AS detail FROM b")
Q.add("e21_outcomes_in_order", lambda s, d: P.outcomes_in_order(table(s, d, "region").selectExpr("r_regionkey AS position", "r_name AS source"), table(s, d, "nation").join(table(s, d, "region").filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("source")).agg(F.lit("results").alias("outcome"), F.count("*").alias("hits"))), "SELECT r_regionkey AS position, r_name AS source, CASE WHEN r_regionkey < 3 AND n > 0 THEN 'results' ELSE 'not_configured' END AS outcome, CASE WHEN r_regionkey < 3 THEN coalesce(n, 0) ELSE 0 END::BIGINT AS hits FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey")

# Feeds and queues
_FEED = "f AS (SELECT 'job' AS kind, 'job:' || o_orderkey AS key, o_orderdate AS created_at, o_orderstatus AS state, CAST(o_custkey AS VARCHAR) AS detail FROM orders UNION ALL SELECT 'event', 'event:' || event_id, ts, event_type, props FROM events)"


def _sources(s, d):
    return {
        "job": table(s, d, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS created_at", "o_orderstatus AS state", "CAST(o_custkey AS STRING) AS detail"),
        "event": table(s, d, "events").selectExpr("event_id AS id", "ts AS created_at", "event_type AS state", "props AS detail"),
    }


Q.add("u1_l5_activity", lambda s, d: E.activity(_sources(s, d), limit=40), f"WITH {_FEED} SELECT * FROM f ORDER BY created_at DESC, key DESC LIMIT 41")
Q.add("l5_activity_cursor", lambda s, d: E.activity(_sources(s, d), ("2001-06-15 00:00:00", "job:5"), 100), f"WITH {_FEED} SELECT * FROM f WHERE created_at < TIMESTAMP '2001-06-15' OR (created_at = TIMESTAMP '2001-06-15' AND key < 'job:5') ORDER BY created_at DESC, key DESC LIMIT 101")
_ENTRY = """o_orderkey AS id
CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 8 = 0 THEN 'partially_applied' WHEN o_orderkey % 5 = 0 THEN 'discarded' WHEN o_orderkey % 4 = 0 THEN 'preparing' WHEN o_orderstatus = 'O' THEN 'needs_attention' WHEN o_orderstatus = 'F' THEN 'applied' ELSE 'ready' END AS state
CASE WHEN o_orderkey % 2 = 0 THEN 'High confidence' ELSE 'Not scored' END AS confidence_label
CASE WHEN o_orderkey % 7 = 0 THEN 'collision' WHEN o_orderkey % 13 = 0 THEN 'task' END AS issue_kind
CASE WHEN o_orderkey % 7 = 0 THEN 'Path collision' END AS issue_message
concat(o_orderpriority, ' order') AS title
concat('file ', CAST(o_custkey AS {s}), '.mp3') AS filename
concat('lib/', CAST(o_custkey AS {s})) AS path
CASE o_orderkey % 3 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'discogs' END AS candidate_source
concat('Cafe ', o_orderpriority) AS candidate_title
'The Band' AS candidate_artist
CASE WHEN o_orderkey % 6 = 0 THEN 'Motorhead Live' END AS candidate_album
CASE WHEN o_orderkey % 10 > 2 THEN o_orderkey % 10 END AS import_session_id"""
_RANK = "CASE state WHEN 'needs_attention' THEN 0 WHEN 'failed' THEN 0 WHEN 'preparing' THEN 1 WHEN 'ready' THEN 2 WHEN 'applying' THEN 3 WHEN 'partially_applied' THEN 4 WHEN 'applied' THEN 5 WHEN 'discarded' THEN 6 ELSE 99 END"
_INBOX = "i AS (SELECT " + _ENTRY.replace("{s}", "VARCHAR").replace("\n", ", ") + f" FROM orders), r AS (SELECT *, CASE WHEN issue_kind IS NULL THEN 1 ELSE 0 END AS issue_rank, {_RANK} AS state_rank FROM i)"


def _inbox(s, d):
    return table(s, d, "orders").selectExpr(*_ENTRY.replace("{s}", "STRING").split("\n"))


_OPEN = "state NOT IN ('applied', 'discarded')"
_IN_ORDER = "ORDER BY issue_rank, state_rank, id LIMIT"
Q.add("l4_f14_inbox", lambda s, d: E.inbox(_inbox(s, d), limit=60), f"WITH {_INBOX} SELECT * FROM r WHERE {_OPEN} {_IN_ORDER} 61")
Q.add("l4_inbox_cursor", lambda s, d: E.inbox(_inbox(s, d), cursor=E.decode_inbox_cursor("0:1:500"), limit=60), f"WITH {_INBOX} SELECT * FROM r WHERE {_OPEN} AND (issue_rank, state_rank, id) > (0, 1, 500) {_IN_ORDER} 61")
Q.add("f14_inbox_filters", lambda s, d: E.inbox(_inbox(s, d), label="high_confidence", issue="collision", source="musicbrainz", session="8"), f"WITH {_INBOX} SELECT * FROM r WHERE {_OPEN} AND confidence_label = 'High confidence' AND issue_kind = 'collision' AND candidate_source = 'musicbrainz' AND import_session_id = 8 {_IN_ORDER} 51")
Q.add("f14_inbox_no_session", lambda s, d: E.inbox(_inbox(s, d), states=["applied", "discarded"], session="none"), f"WITH {_INBOX} SELECT * FROM r WHERE state IN ('applied', 'discarded') AND import_session_id IS NULL {_IN_ORDER} 51")
Q.add("f10_inbox_search", lambda s, d: E.inbox(_inbox(s, d), states=["applied"], label="Not_Scored", q="low order"), f"WITH {_INBOX} SELECT * FROM r WHERE state = 'applied' AND confidence_label = 'Not scored' AND title = '5-LOW order' {_IN_ORDER} 51")
Q.add("f10_inbox_search_columns", lambda s, d: E.inbox(_inbox(s, d), q="MOTÖRHEAD", limit=500), f"WITH {_INBOX} SELECT * FROM r WHERE {_OPEN} AND candidate_album = 'Motorhead Live' {_IN_ORDER} 501")
Q.add("f10_inbox_search_issue", lambda s, d: E.inbox(_inbox(s, d), q="path collision"), f"WITH {_INBOX} SELECT * FROM r WHERE {_OPEN} AND issue_message IS NOT NULL {_IN_ORDER} 51")


def _inbox_by_index(s, d, q):
    index = PhraseIndex(s, shared_path(s, "phrases"), E.INBOX_SEARCHED)
    index.update(_inbox(s, d))
    return E.inbox(_inbox(s, d).join(index.search(q), "id", "left_semi"), limit=500)


Q.add("f10_indexed_inbox", lambda s, d: _inbox_by_index(s, d, "MOTÖRHEAD live"), Q.oracles["f10_inbox_search_columns"])
_NEAR = "lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, min(CASE WHEN state IN ('ready', 'needs_attention') THEN n END) OVER (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS open_n"


def _around(condition: str) -> str:
    return f"WITH {_INBOX}, o AS (SELECT *, row_number() OVER (ORDER BY issue_rank, state_rank, id) AS n FROM r WHERE {condition}), b AS (SELECT id, {_NEAR} FROM o WINDOW w AS (ORDER BY n)) SELECT b.id, previous_id, next_id, o.id AS next_open_id FROM b LEFT JOIN o ON o.n = open_n"


Q.add("w3_inbox_neighbours", lambda s, d: E.inbox_neighbours(_inbox(s, d)), _around(_OPEN))
Q.add("w3_filtered_neighbours", lambda s, d: E.inbox_neighbours(_inbox(s, d), source="discogs", label="high_confidence", states=["ready", "applied", "failed"]), _around("candidate_source = 'discogs' AND confidence_label = 'High confidence' AND state IN ('ready', 'applied', 'failed')"))


def _bundles(s, d):
    return _inbox(s, d).select("id", "state", (F.col("id") % 1000).alias("logical_key"))


def _revisions(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").alias("revision"), (F.col("l_linenumber") == 1).alias("is_current"))


Q.add("f21_active_bundle", lambda s, d: E.active_bundle(_bundles(s, d), 34), f"WITH {_INBOX} SELECT id, state, id % 1000 AS logical_key FROM i WHERE id % 1000 = 34 AND state IN ('preparing', 'ready', 'needs_attention', 'applying')")
Q.add("f21_current_revision", lambda s, d: E.current_revision(_revisions(s, d), _bundles(s, d).filter("state = 'ready'")), f"WITH {_INBOX} SELECT l_orderkey AS bundle_id, l_linenumber AS revision, true AS is_current FROM lineitem JOIN i ON i.id = l_orderkey WHERE l_linenumber = 1 AND state = 'ready'")


def _reviews(s, d):
    o = F.col("o_orderkey")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    attempt = F.struct(F.lit("match").alias("kind"), F.when(o % 2 == 0, "transient_failure").otherwise("applied").alias("state"), F.when(o % 4 == 0, "no answer").alias("error"))
    operation = F.struct((o % 5 == 0).alias("collision"), F.when(o % 10 == 0, F.lit("lib/x")).alias("collision_path"), F.when(o % 3 == 0, F.array(F.lit(9), F.lit(4))).otherwise(none("int")).alias("conflicting"), F.when(o % 7 == 0, F.array(F.lit("bad"), F.lit("worse"))).otherwise(none("string")).alias("errors"))
    return table(s, d, "orders").select(o.alias("id"), F.when(o % 12 == 0, "no answer").when(o % 11 == 0, "broken").alias("error"), F.array(attempt).alias("attempts"), F.array(operation).alias("operations"))


_ISSUE = """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS failed, o_orderkey % 5 = 0 AS hit FROM orders),
k AS (SELECT id, CASE WHEN id % 11 = 0 AND id % 12 <> 0 THEN 'review' WHEN failed THEN 'task' WHEN hit THEN 'collision' WHEN id % 7 = 0 THEN 'review' END AS kind, failed FROM o)
SELECT id, kind, CASE WHEN id % 11 = 0 AND id % 12 <> 0 THEN 'broken' WHEN failed THEN CASE WHEN id % 4 = 0 THEN 'no answer' ELSE 'match could not be completed' END
  WHEN kind = 'collision' THEN CASE WHEN id % 10 = 0 THEN 'Destination collision: ' || chr(39) || 'lib/x' || chr(39) ELSE 'Path collision' END || CASE WHEN id % 3 = 0 THEN ' \u2014 conflicts with track(s) [4, 9]' ELSE '' END || CASE WHEN id % 7 = 0 THEN ' \u2014 bad; worse' ELSE '' END
  WHEN kind = 'review' THEN 'bad; worse' END AS message FROM k"""
Q.add("b22_first_issue", lambda s, d: _reviews(s, d).select("id", E.first_issue().alias("i")).select("id", "i.kind", "i.message"), _ISSUE)
Q.add("b15_review_label", lambda s, d: _inbox(s, d).select("id", review_label(F.col("candidate_source").isNotNull(), F.when(F.col("id") % 4 > 1, (F.col("id") % 100) / 100), F.col("state")).alias("label")), f"WITH {_INBOX} SELECT id, CASE WHEN id % 4 > 1 THEN CASE WHEN id % 100 >= 85 THEN 'High confidence' WHEN id % 100 >= 65 THEN 'Medium confidence' ELSE 'Low confidence' END WHEN candidate_source IS NOT NULL THEN 'Manual selection' WHEN state = 'needs_attention' THEN 'Needs attention' WHEN state = 'preparing' THEN 'Preparing' ELSE 'Not scored' END AS label FROM i")


def _job_log(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))


_ENDED = "CASE WHEN o_orderkey % 2 = 0 THEN 'succeeded' ELSE 'running' END"
for _name, _job in (("s19_events_of_ended_job", 8), ("s19_events_of_running_job", 7), ("s19_events_of_no_job", -1)):
    Q.add(_name, lambda s, d, j=_job: E.job_events(_job_log(s, d), table(s, d, "orders").selectExpr("o_orderkey AS id", f"{_ENDED} AS state"), j, 900), f"SELECT event_id AS seq, event_type AS kind, props AS payload FROM events WHERE user_id = {_job} AND event_id > 900 UNION ALL SELECT NULL, CASE WHEN count(*) = 0 THEN 'error' ELSE 'done' END, coalesce(max({_ENDED}), 'job not found') FROM orders WHERE o_orderkey = {_job} HAVING count(*) = 0 OR max({_ENDED}) = 'succeeded'")
_J = f"WITH {JOBS} "
Q.add("l6_jobs", lambda s, d: E.jobs_page(jobs(s, d), "running", 9000, 30).select("id", "state", "priority"), _J + "SELECT id, state, priority FROM jobs WHERE type <> 'retention_sweep' AND state = 'running' AND id < 9000 ORDER BY id DESC LIMIT 31")
Q.add("l7_next_job", lambda s, d: E.next_job(jobs(s, d)).select("id", "priority"), _J + "SELECT id, priority FROM jobs WHERE state = 'queued' ORDER BY priority DESC, created_at, id LIMIT 1")
Q.add("l8_latest_sessions", lambda s, d: jobs(s, d).orderBy(F.desc("id")).limit(5).select("id", "state"), _J + "SELECT id, state FROM jobs ORDER BY id DESC LIMIT 5")
Q.add("st4_expired_leases", lambda s, d: E.expired_leases(jobs(s, d), "1996-01-01 00:00:00").select("id"), _J + "SELECT id FROM jobs WHERE state = 'running' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '1996-01-01')")
Q.add("st1_replay", lambda s, d: O.after_sequence(table(s, d, "events").filter("user_id = 7"), "event_id", 5000).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_id > 5000")
Q.add("a23_progress", lambda s, d: E.progress(_tasks(s, d), "session_id"), "WITH t AS (SELECT l_orderkey AS session_id, l_linenumber AS position, concat('stage', CAST(l_linenumber AS VARCHAR)) AS stage, CASE l_returnflag WHEN 'R' THEN 'running' WHEN 'A' THEN 'done' ELSE 'waiting' END AS state FROM lineitem) SELECT session_id, count(*) FILTER (state = 'done') AS done, count(*) AS total, 'stage' || CAST(min(position) FILTER (state = 'running') AS VARCHAR) AS running FROM t GROUP BY 1")
Q.add("a18_decisions", lambda s, d: E.decision_counts(table(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending").alias("decision")), "l_orderkey"), "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS accepted, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS pending, count(*) FILTER (l_returnflag = 'R') AS rejected FROM lineitem GROUP BY 1")
Q.add("j12_last_job", lambda s, d: E.last_job(table(s, d, "events").select("event_id", F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(",null,"), (F.col("event_id") * 2).cast("string"), F.lit("]")).alias("manifest")), jobs(s, d)).select("event_id", "job_id", "job_state"), f"WITH {JOBS} SELECT event_id, event_id * 2 AS job_id, jobs.state AS job_state FROM events LEFT JOIN jobs ON jobs.id = event_id * 2")
_STATES = {"import": ["pending", "scanning", "fingerprinting", "grouping", "matching", "reviewing", "completed", "failed", "cancelled"], "apply": ["pending", "applying", "applied", "partially_applied", "failed"], "undo": ["pending", "undoing", "undone", "partially_undone", "failed"]}
_MEANT = {"import": ["pending", "running", "running", "running", "running", "succeeded", "succeeded", "failed", "cancelled"], "apply": ["pending", "running", "succeeded", "failed", "failed"], "undo": ["pending", "running", "succeeded", "failed", "failed"]}


def _activity(s, d):
    picked = lambda k: F.element_at(F.array(*map(F.lit, _STATES[k])), (F.col("event_id") % len(_STATES[k]) + 1).cast("int"))
    return table(s, d, "events").select("event_id", *[activity_state(k, picked(k)).alias(f"{k}_state") for k in _STATES])


Q.add("b17_states", _activity, "SELECT event_id, " + ", ".join(f"{v}[event_id % {len(v)} + 1] AS {k}_state" for k, v in _MEANT.items()) + " FROM events")
Q.add("u4_mixed_groups", lambda s, d: E.mixed_groups(tracks(s, d), "group_id", F.startswith("path", F.lit("lib/Brand#1"))), f"WITH {TRACKS} SELECT group_id FROM tracks GROUP BY 1 HAVING bool_or(starts_with(path, 'lib/Brand#1')) AND bool_or(NOT starts_with(path, 'lib/Brand#1'))")
_RET = "WITH a AS (SELECT user_id, max(ts) AS last, min(ts) AS began FROM events GROUP BY 1), o AS (SELECT user_id FROM a WHERE last < TIMESTAMP '2024-01-30 12:00:00'), m AS (SELECT user_id FROM a QUALIFY row_number() OVER (ORDER BY began DESC, user_id DESC) > 100), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60) SELECT coalesce(o.user_id, m.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'count' WHEN m.user_id IS NULL THEN 'age' ELSE 'age+count' END AS reason FROM o FULL JOIN m ON o.user_id = m.user_id WHERE coalesce(o.user_id, m.user_id) NOT IN (SELECT user_id FROM p)"
Q.add("u5_st7_retention", lambda s, d: E.retention(table(s, d, "events"), "user_id", "ts", F.expr("TIMESTAMP '2024-01-30 12:00:00'"), 100, table(s, d, "events").filter("event_type = 'error' and value > 60")), _RET)


def _tasks(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("stage"), F.col("l_linenumber").cast("string")).alias("stage"), F.when(F.col("l_returnflag") == "R", "running").when(F.col("l_returnflag") == "A", "done").otherwise("waiting").alias("state"))


# Revisions
def _ops(s, d, rest):
    return table(s, d, "orders").filter(f"o_orderkey % 2 = {rest}").selectExpr("o_orderstatus AS kind", "o_orderpriority AS field", "o_custkey AS target_id", "o_totalprice AS value")


_OPS = "SELECT o_orderstatus AS kind, o_orderpriority AS field, o_custkey AS target_id, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = {}"
Q.add("r1_keyed_merge", lambda s, d: V.keyed_merge(_ops(s, d, 0), _ops(s, d, 1), ["kind", "field", "target_id"]), f"WITH a AS ({_OPS.format(0)}), b AS ({_OPS.format(1)}) SELECT * FROM a WHERE (kind, field, target_id) NOT IN (SELECT (kind, field, target_id) FROM b) UNION ALL SELECT * FROM b")
Q.add("r2_precedence_merge", lambda s, d: V.precedence_merge(_edits(s, d, "l_linenumber < 4"), _edits(s, d, "l_linenumber > 2"), False), "WITH e AS (SELECT CAST(l_linenumber AS VARCHAR) AS field, l_orderkey AS track_id, l_linenumber AS n FROM lineitem) SELECT field, track_id, CASE WHEN n = 3 THEN 'conflict' ELSE 'manual' END AS origin FROM e WHERE n < 4 UNION ALL SELECT field, track_id, CASE WHEN n = 3 THEN 'conflict' ELSE 'candidate' END FROM e WHERE n > 2")
Q.add("r2_forced", lambda s, d: V.precedence_merge(_edits(s, d, "l_linenumber < 4"), _edits(s, d, "l_linenumber > 2"), True), "WITH e AS (SELECT CAST(l_linenumber AS VARCHAR) AS field, l_orderkey AS track_id, l_linenumber AS n FROM lineitem) SELECT field, track_id, 'manual' AS origin FROM e WHERE n < 3 UNION ALL SELECT field, track_id, 'candidate' FROM e WHERE n > 2")
Q.add("r3_idempotent", lambda s, d: V.idempotent(table(s, d, "events").selectExpr("event_id", "user_id AS bundle", "event_type AS digest"), ["bundle"], "digest", "event_id"), "SELECT min(event_id) AS event_id, user_id AS bundle, event_type AS digest FROM events GROUP BY 2, 3")
Q.add("r4_carry_decisions", lambda s, d: V.carry_decisions(table(s, d, "events").filter("event_id % 2 = 0").selectExpr("event_id", "user_id", "event_type", "CASE WHEN value > 20 THEN 'accepted' ELSE 'rejected' END AS decision"), table(s, d, "events").filter("event_id % 2 = 1").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id").select("event_id", "decision"), "WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_id % 2, user_id, event_type ORDER BY event_id) AS nth FROM events) SELECT n.event_id, CASE WHEN o.event_id IS NULL THEN 'pending' WHEN o.value > 20 THEN 'accepted' ELSE 'rejected' END AS decision FROM e n LEFT JOIN e o ON o.event_id % 2 = 0 AND o.user_id = n.user_id AND o.event_type = n.event_type AND o.nth = n.nth WHERE n.event_id % 2 = 1")
Q.add("r5_undo_expired", lambda s, d: V.undo_expired(table(s, d, "orders").selectExpr("o_orderkey AS run_id", "CASE o_orderstatus WHEN 'F' THEN 'applied' ELSE 'open' END AS state"), table(s, d, "lineitem").selectExpr("l_orderkey AS run_id", "l_partkey AS track_id", "CASE WHEN l_returnflag = 'A' THEN 'applied' ELSE 'failed' END AS state"), table(s, d, "lineitem").filter("l_quantity > 10").selectExpr("l_orderkey AS run_id", "l_partkey AS track_id")), "SELECT o_orderkey AS run_id FROM orders o WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem j WHERE j.l_orderkey = l.l_orderkey AND j.l_partkey = l.l_partkey AND j.l_quantity > 10))")
Q.add("r6_retryable", lambda s, d: V.retryable(_distinct_attempts(s, d), "item_key"), "WITH a AS (SELECT l_orderkey, l_linenumber, max(CASE l_returnflag WHEN 'R' THEN 'transient_failure' WHEN 'A' THEN 'failed' ELSE 'applied' END) AS outcome FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS item_key FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1) WHERE outcome = 'transient_failure'")
Q.add("r7_newest_active", lambda s, d: V.newest_active(table(s, d, "customer").selectExpr("c_custkey AS review_id", "c_custkey % 2 = 0 AS applied", "array(c_custkey, c_custkey * 3, c_custkey * 7 + 100000) AS job_ids"), jobs(s, d)), f"WITH {JOBS}, l AS (SELECT c_custkey AS review_id, c_custkey % 2 = 0 AS applied, unnest([c_custkey, c_custkey * 3, c_custkey * 7 + 100000]) AS job_id, generate_subscripts([1, 2, 3], 1) AS pos FROM customer) SELECT review_id, arg_max(l.job_id, pos) AS job_id FROM l JOIN jobs ON jobs.id = l.job_id WHERE applied OR state IN ('queued', 'running') GROUP BY 1")
Q.add("r8_overlapping", lambda s, d: V.overlapping(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("review_id")).agg(F.collect_list("l_partkey").alias("track_ids"), F.lit(True).alias("open"))), "WITH t AS (SELECT DISTINCT l_orderkey AS review_id, l_partkey AS track_id FROM lineitem) SELECT track_id, count(*) AS reviews, min(review_id) AS first_review, max(review_id) AS last_review FROM t GROUP BY 1 HAVING count(*) > 1")
Q.add("r10_provider_status", lambda s, d: V.provider_status(_requests(s, d), "host"), "WITH e AS (SELECT event_type AS host, event_id AS id, ts AS moment, CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 200 END AS status, CAST(event_id // 3000 AS BIGINT) AS generation FROM events), s AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN status < 400 OR status = 404 THEN 'operational' WHEN status = 401 THEN 'invalid_credentials' ELSE 'unavailable' END AS state FROM e QUALIFY generation = max(generation) OVER (PARTITION BY host)) SELECT host, arg_max(state, epoch_us(moment) * 1000000::HUGEINT + id) AS state, max(moment) FILTER (state = 'operational') AS last_success, max(moment) FILTER (state <> 'operational') AS last_error FROM s GROUP BY 1")
Q.add("r11_request_counts", lambda s, d: V.request_counts(_requests(s, d), "host"), "SELECT event_type AS host, CASE WHEN event_id % 5 = 4 THEN 'success' ELSE 'failure' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
Q.add("r9_cover_candidates", lambda s, d: _covers(s, d), f"WITH {TRACKS}, {GROUPS} SELECT id FROM groups g WHERE (mb_release_id IS NOT NULL AND EXISTS (SELECT 1 FROM tracks t WHERE t.group_id = g.id AND NOT is_missing AND NOT has_art)) OR EXISTS (SELECT 1 FROM tracks t WHERE t.group_id = g.id AND NOT is_missing AND t.mb_release_id IS NOT NULL)")
Q.add("c_drift", lambda s, d: tracks(s, d).select("id", V.has_drifted(F.col("barcode"), F.when(F.col("id") % 2 == 0, F.col("barcode")).otherwise("x"), F.col("probe_error").isNull()).alias("drifted")), f"WITH {TRACKS} SELECT id, CASE WHEN probe_error IS NOT NULL THEN true WHEN barcode IS NULL THEN false ELSE id % 2 = 1 END AS drifted FROM tracks")
_RELEASE = "concat('{\"id\":\"r\",\"title\":\"', coalesce(album, ''), '\",\"date\":\"', coalesce(CAST(year AS STRING), ''), '\",\"artist-credit\":[{\"name\":\"A\"}],\"media\":[{\"tracks\":[{\"title\":\"t1\"},{\"title\":\"t2\"}]}]}')"


def _chosen(s, d):
    made = P.candidates(tracks(s, d).selectExpr("id", "'musicbrainz' AS source", _RELEASE + " AS payload"), keep=("id",))
    return made.withColumn("aligned", F.when(F.col("id") % 3 > 0, F.get("tracks", (F.col("id") % 3 - 1).cast("int"))))


Q.add("e17_candidate_edits", lambda s, d: V.candidate_edits(_chosen(s, d)), f"WITH {TRACKS} SELECT id, 'album' AS field, coalesce(album, '') AS value FROM tracks UNION ALL SELECT id, 'album_artist', 'A' FROM tracks UNION ALL SELECT id, 'year', CAST(year AS VARCHAR) FROM tracks WHERE year IS NOT NULL UNION ALL SELECT id, 'title', 't' || (id % 3) FROM tracks WHERE id % 3 > 0 UNION ALL SELECT id, 'track_no', CAST(id % 3 AS VARCHAR) FROM tracks WHERE id % 3 > 0")


def _open_reviews(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("review_id")).agg(F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("scope_ids"), F.collect_set(F.when(F.col("l_linenumber") == 2, F.col("l_partkey"))).alias("target_ids"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_partkey"))).alias("snapshot_ids"))
    return lines.withColumn("open", F.col("review_id") % 4 > 0)


Q.add("r8_conflicts", lambda s, d: V.conflicts(_open_reviews(s, d), 7), "WITH t AS (SELECT DISTINCT l_orderkey AS review_id, l_partkey AS track_id FROM lineitem WHERE l_orderkey % 4 > 0) SELECT track_id, review_id FROM t WHERE review_id <> 7 AND track_id IN (SELECT track_id FROM t WHERE review_id = 7)")
Q.add("e17_edits", lambda s, d: V.edits(tracks(s, d), ["title", "album", "year"], "id"), f"WITH {TRACKS} SELECT id, 'title' AS field, title AS value FROM tracks WHERE title IS NOT NULL UNION ALL SELECT id, 'album', album FROM tracks WHERE album IS NOT NULL UNION ALL SELECT id, 'year', CAST(year AS VARCHAR) FROM tracks WHERE year IS NOT NULL")
_LOGGED = ["preparing", "ready", "needs_attention", "applying", "partially_applied", "failed", "applied", "discarded"]
_ALLOWED = "('preparing', 'ready'), ('preparing', 'needs_attention'), ('preparing', 'failed'), ('preparing', 'discarded'), ('ready', 'needs_attention'), ('ready', 'applying'), ('ready', 'discarded'), ('needs_attention', 'ready'), ('needs_attention', 'applying'), ('needs_attention', 'discarded'), ('applying', 'applied'), ('applying', 'partially_applied'), ('applying', 'failed'), ('partially_applied', 'applying'), ('partially_applied', 'failed'), ('failed', 'applying'), ('discarded', 'ready'), ('discarded', 'needs_attention')"
Q.add("c_invalid_transitions", lambda s, d: V.invalid_transitions(table(s, d, "events").select("user_id", "event_id", F.element_at(F.array(*map(F.lit, _LOGGED)), (F.col("event_id") % 8 + 1).cast("int")).alias("state")), "user_id", "event_id"), f"WITH l AS (SELECT user_id, event_id, {_LOGGED}[event_id % 8 + 1] AS state FROM events), p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM l) SELECT user_id, event_id, state, before FROM p WHERE before IS NOT NULL AND (before, state) NOT IN ({_ALLOWED})")


def _edits(s, d, cond):
    return table(s, d, "lineitem").filter(cond).select(F.col("l_linenumber").cast("string").alias("field"), F.col("l_orderkey").alias("track_id"))


def _distinct_attempts(s, d):
    return attempts(s, d).groupBy("item_key", "attempt_no").agg(F.max("outcome").alias("outcome"))


def _requests(s, d):
    return table(s, d, "events").selectExpr("event_type AS host", "event_id AS id", "ts AS at", "CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 200 END AS status", "event_id div 3000 AS generation")


def _covers(s, d):
    from marram.operators.catalog import needing_art

    from .bindings import groups

    t = tracks(s, d)
    proposed = t.filter("mb_release_id is not null and not is_missing").select(F.col("group_id").alias("id")).distinct()
    return needing_art(groups(s, d), t).unionByName(groups(s, d).join(proposed, "id", "left_semi").select("id")).distinct()


