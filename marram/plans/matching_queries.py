"""Duplicates, grouping, matching and stateful folds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marram.functions.text import match_key_column, name_distance_column, path_key_column, text_diff_column
from marram.operators import duplicates as D
from marram.operators import grouping as G
from marram.operators import matching as M
from marram.sources.shared import shared_path
from marram.streaming import live as L

from .bindings import MATCHES, TRACKS, matches, table, tracks
from .book import Book

Q = Book()
TM = f"WITH {TRACKS}, {MATCHES}"
_CLAIMED = TM + ", b AS (SELECT track_id, mb_recording_id FROM matches QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, id) = 1), c AS (SELECT b.*, t.duration_ms, t.format FROM b JOIN tracks t ON t.id = b.track_id WHERE NOT t.is_missing)"
_EVIDENCE = _CLAIMED + """, f AS (SELECT track_id, mb_recording_id, score FROM matches QUALIFY row_number() OVER (PARTITION BY track_id, mb_recording_id ORDER BY id) = 1),
g AS (SELECT mb_recording_id, count(*) AS members, avg(score) AS mean_score, min(duration_ms) AS shortest, max(duration_ms) AS longest, avg(duration_ms) AS mean_duration, count(DISTINCT format) AS formats FROM c JOIN f USING (track_id, mb_recording_id) GROUP BY 1 HAVING count(*) >= 2),
h AS (SELECT *, longest - shortest AS spread_ms, 100 * (longest - shortest) / nullif(mean_duration, 0) AS spread_percent FROM g),
k AS (SELECT *, greatest(0, least(1, mean_score * CASE WHEN spread_percent IS NULL THEN 0.8 WHEN spread_percent <= 5 THEN 1.0 WHEN spread_percent <= 10 THEN 0.8 WHEN spread_percent <= 20 THEN 0.5 ELSE 0.3 END)) AS confidence FROM h)"""
_ECOLS = "mb_recording_id, members, round(mean_score, 6) AS mean_score, spread_ms, round(spread_percent, 6) AS spread_percent, formats, round(confidence, 6) AS confidence"


def _evidence(s, d):
    return D.evidence(matches(s, d), tracks(s, d))


Q.add("a13_a14_evidence", lambda s, d: _evidence(s, d).selectExpr(*_ECOLS.split(", ")[:2], "round(mean_score, 6) AS mean_score", "spread_ms", "round(spread_percent, 6) AS spread_percent", "formats", "round(confidence, 6) AS confidence", "label", "is_uncertain", "is_false_positive"), _EVIDENCE + f" SELECT {_ECOLS}, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS label, confidence < 0.5 OR coalesce(spread_percent > 10, false) AS is_uncertain, confidence < 0.5 OR coalesce(spread_percent > 20, false) AS is_false_positive FROM k")
Q.add("a13_quality", lambda s, d: D.quality(matches(s, d), tracks(s, d)), _CLAIMED.replace("t.format", "t.format, t.size_bytes") + " SELECT mb_recording_id, track_id, format, duration_ms, size_bytes FROM c QUALIFY count(*) OVER (PARTITION BY mb_recording_id) >= 2")
Q.add("a12_e19_members", lambda s, d: D.members(matches(s, d), tracks(s, d)), _CLAIMED + " SELECT mb_recording_id, track_id FROM c QUALIFY count(*) OVER (PARTITION BY mb_recording_id) >= 2")


def _known(s, d):
    return matches(s, d).filter("id % 7 = 0").groupBy("mb_recording_id").agg(F.min("id").alias("id")).select("mb_recording_id", (F.col("id") % 3 == 0).alias("dismissed"), "id")


_KNOWN = ", known AS (SELECT mb_recording_id, min(id) % 3 = 0 AS dismissed, min(id) AS id FROM matches WHERE id % 7 = 0 GROUP BY 1)"
Q.add("j7_reconcile", lambda s, d: D.reconcile(_evidence(s, d), _known(s, d)), _EVIDENCE + _KNOWN + " SELECT coalesce(k.mb_recording_id, n.mb_recording_id) AS mb_recording_id, CASE WHEN n.dismissed THEN 'dismissed_skipped' WHEN n.mb_recording_id IS NULL THEN 'created' WHEN k.mb_recording_id IS NULL THEN 'removed' ELSE 'updated' END AS action FROM k FULL JOIN known n ON n.mb_recording_id = k.mb_recording_id")


def _stored_duplicates(s, d):
    """Half of the matches first; some groups are dismissed; then all of them."""
    store = D.DuplicateStore(s, shared_path(s, "duplicates"))
    store.run(matches(s, d).filter("id % 2 = 0"), tracks(s, d))
    store.dismiss(store.groups.read().filter("mb_recording_id like '%-1%'").select("mb_recording_id"))
    store.run(matches(s, d), tracks(s, d))
    return store.groups.read().selectExpr("mb_recording_id", "members", "round(mean_score, 6) AS mean_score", "spread_ms", "formats", "round(confidence, 6) AS confidence", "label", "dismissed")


_KEPT = "mb_recording_id, members, round(mean_score, 6) AS mean_score, spread_ms, formats, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS label"
_PASS = "(WITH matches AS (SELECT * FROM all_matches WHERE {w})" + _EVIDENCE[len(TM) :].replace("{", "{{").replace("}", "}}") + f" SELECT {_KEPT} FROM k)"
Q.add("j7_stored_groups", _stored_duplicates, f"WITH {TRACKS}, {MATCHES.replace('matches AS', 'all_matches AS', 1)}, e1 AS {_PASS.format(w='id % 2 = 0')}, e2 AS {_PASS.format(w='true')} SELECT *, true AS dismissed FROM e1 WHERE mb_recording_id LIKE '%-1%' UNION ALL SELECT *, false FROM e2 WHERE mb_recording_id NOT IN (SELECT mb_recording_id FROM e1 WHERE mb_recording_id LIKE '%-1%')")
Q.add("u3_stale_members", lambda s, d: D.stale_members(matches(s, d).select("mb_recording_id", "track_id").distinct(), D.members(matches(s, d), tracks(s, d))), _CLAIMED + ", m AS (SELECT mb_recording_id, track_id FROM c QUALIFY count(*) OVER (PARTITION BY mb_recording_id) >= 2) SELECT DISTINCT mb_recording_id, track_id FROM matches EXCEPT SELECT mb_recording_id, track_id FROM m")
Q.add("l9_visible_groups", lambda s, d: D.visible(_known(s, d), 20), f"WITH {MATCHES}{_KNOWN} SELECT mb_recording_id, dismissed, id FROM known WHERE NOT dismissed ORDER BY id DESC LIMIT 20")

# Names
Q.add("b1_match_key", lambda s, d: tracks(s, d).select("id", match_key_column(F.concat(F.lit("The "), "title", F.lit(" (Remastered 2009) [feat. É] Pt. II"))).alias("key")), f"WITH {TRACKS} SELECT id, coalesce(title || ' feat e pt 2', '') AS key FROM tracks")
_FORMS = [lambda t: t, lambda t: F.concat(F.lit("The "), t), lambda t: F.concat(t, F.lit(" (Remastered 2009)")), lambda t: F.concat(t, F.lit(" ft. Zed")), lambda t: F.concat(t, F.lit(" Vol. VII")), lambda t: F.concat(F.upper(t), F.lit("!")), lambda t: F.concat(F.lit("\u00c1 "), t), lambda t: F.concat(t, F.lit(" [Explicit]  with\tNo. IX"))]


def _in_forms(t):
    out = F.lit(None).cast("string")
    for k, form in enumerate(_FORMS):
        out = F.when(F.col("id") % len(_FORMS) == k, form(F.col("title"))).otherwise(out)
    return t.select("id", match_key_column(out).alias("key"))


Q.add("b1_match_key_forms", lambda s, d: _in_forms(tracks(s, d)), f"WITH {TRACKS} SELECT id, coalesce(title || CASE id % 8 WHEN 3 THEN ' feat zed' WHEN 4 THEN ' vol 7' WHEN 7 THEN ' feat no 9' ELSE '' END, '') AS key FROM tracks")
Q.add("s7_composed_path", lambda s, d: tracks(s, d).select("id", path_key_column(F.concat("path", F.when(F.col("id") % 2 == 0, F.lit("e\u0301")).otherwise(F.lit("o\u0308")))).alias("key")), f"WITH {TRACKS} SELECT id, path || CASE WHEN id % 2 = 0 THEN 'é' ELSE 'ö' END AS key FROM tracks")
Q.add("b3_name_distance", lambda s, d: tracks(s, d).select("title", "album").distinct().select("title", "album", F.round(name_distance_column("title", "album"), 6).alias("distance")))
Q.add("s7_path_key", lambda s, d: tracks(s, d).select("id", path_key_column(F.concat("path", F.lit("é"))).alias("key")), f"WITH {TRACKS} SELECT id, path || 'é' AS key FROM tracks")

# Grouping
_KEY = ", k AS (SELECT *, CASE WHEN mb_release_id <> '' THEN 'release_id:' || mb_release_id WHEN barcode <> '' THEN 'barcode:' || barcode WHEN catalog_number <> '' AND label <> '' THEN 'catalog_label:' || catalog_number || '|' || label END AS gk FROM tracks), n AS (SELECT * FROM k WHERE gk IS NOT NULL QUALIFY count(*) OVER (PARTITION BY gk) > 1)"
Q.add("e1_e8_by_ids", lambda s, d: G.by_ids(tracks(s, d))[0], f"WITH {TRACKS}{_KEY} SELECT substr(sha256(gk), 1, 32) AS key, split_part(gk, ':', 1) AS basis, id FROM n")
Q.add("e2_fingerprint_groups", lambda s, d: G.fingerprint_groups(G.release_votes(matches(s, d))))
Q.add("e3_tag_clusters", lambda s, d: G.tag_clusters(tracks(s, d).filter("album is not null"), "id").withColumn("distance", F.round("distance", 6)))
Q.add("e4_cluster_confidence", lambda s, d: G.cluster_confidence(G.tag_clusters(tracks(s, d).filter("album is not null"), "id")))
Q.add("e5_singletons", lambda s, d: tracks(s, d).filter(G.is_singleton()).select("id"), f"WITH {TRACKS} SELECT id FROM tracks WHERE album IS NULL OR trim(album) = '' OR lower(album) = lower(title) OR track_total = 1")
Q.add("e6_partial_albums", lambda s, d: G.partial_albums(G.by_ids(tracks(s, d))[0].join(tracks(s, d).select("id", "track_total"), "id")), f"WITH {TRACKS}{_KEY}, p AS (SELECT substr(sha256(gk), 1, 32) AS key, count(*) AS members, CASE WHEN count(DISTINCT nullif(track_total, 0)) = 1 THEN max(nullif(track_total, 0)) END AS agreed FROM n GROUP BY 1) SELECT *, CASE WHEN agreed > members THEN 'partial_album' ELSE 'album' END AS kind FROM p")
Q.add("e7_cascade", lambda s, d: G.cascade(tracks(s, d), matches(s, d), tracks(s, d).filter("group_id % 4 = 0").select("group_id").distinct()))


def _stored_groups(s, d):
    """The cascade from tracks to the groups it stores."""
    store = G.GroupStore(s, shared_path(s, "groups"))
    store.run(tracks(s, d), matches(s, d))
    return store.groups.read().withColumn("confidence", F.round("confidence", 3))


Q.add("e7_stored_groups", _stored_groups)
Q.add("e7_upsert_counts", lambda s, d: G.upsert_counts(G.by_ids(tracks(s, d))[0], G.by_ids(tracks(s, d).filter("id % 2 = 0"))[0].select("key").distinct().withColumn("is_pinned", F.lit(False))), f"WITH {TRACKS}{_KEY}, s AS (SELECT gk FROM k WHERE id % 2 = 0 AND gk IS NOT NULL GROUP BY 1 HAVING count(*) > 1), p AS (SELECT DISTINCT gk FROM n) SELECT count(*) FILTER (s.gk IS NULL) AS created, count(*) FILTER (s.gk IS NOT NULL) AS updated, 0::BIGINT AS skipped FROM p LEFT JOIN s USING (gk)")


# Matching: a part is a local track, parts of nearby numbers are its candidates
def album_pairs(s, d):
    """(case, candidate) pairs: orders as local releases, with three derived candidates each."""
    lines = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    # Dealt by order as they are: lists gathered before would travel as parts, for no fewer bytes.
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", "p_name", "p_brand").repartition("l_orderkey")
    track = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("isrc"), F.lit(None).cast("string").alias("track_id"))
    items = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), track.alias("track"))))
    local = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(items["track"].alias("items"), F.min("p_name").alias("local_album"), F.min("p_brand").alias("local_album_artist"))
    made = F.explode(
        F.array(
            F.struct(F.lit("musicbrainz").alias("source"), F.lit(0).alias("position"), F.col("items").alias("tracks"), F.col("local_album").alias("album"), F.lit(2000).alias("year"), F.when(F.col("case_id") % 3 == 0, 1970).alias("original_year")),
            F.struct(F.lit("discogs").alias("source"), F.lit(1).alias("position"), F.reverse("items").alias("tracks"), F.concat("local_album", F.lit(" x")).alias("album"), F.lit(2001).alias("year"), F.when(F.col("case_id") % 3 == 1, 1970).otherwise(0).alias("original_year")),
            F.struct(F.lit("deezer").alias("source"), F.lit(2).alias("position"), F.slice("items", 1, 1).alias("tracks"), F.lit("something else").alias("album"), F.lit(1990).alias("year"), F.lit(None).cast("int").alias("original_year")),
        )
    )
    null = F.lit(None).cast("string")
    pairs = local.select("case_id", F.col("items").alias("local_tracks"), "local_album", "local_album_artist", F.lit(2000).alias("local_year"), made.alias("c")).select("*", "c.*").drop("c")
    pairs = pairs.withColumn("ref_id", F.concat("source", F.lit("-"), F.col("case_id").cast("string"))).withColumn("album_artist", F.col("local_album_artist"))
    return pairs.withColumns({c: null for c in ("local_media", "local_country", "local_label", "local_catalog_number", "local_barcode", "media", "country", "label", "catalog_number", "barcode", "release_id")})


def _scored(s, d):
    return M.score_albums(album_pairs(s, d))


def _short(scored):
    """What ranking reads, without the track lists."""
    return scored.select("case_id", "source", "ref_id", "position", "album", "barcode", "release_id", "year", "original_year", "distance", "related", F.size("tracks").alias("n_tracks"))


def _with_discs(pairs):
    """Local tracks on two discs; every tenth case has a track without one."""
    disc = lambda x, k: F.when((F.col("case_id") % 10 == 0) & (k == 0), F.lit(None)).otherwise(k % 2 + 1).cast("int")
    return pairs.withColumn("local_tracks", F.transform("local_tracks", lambda x, k: x.withField("disc", disc(x, k))))


def _adjacent(s, d):
    return M.rank(_short(_scored(s, d)), "case_id", earliest=True, adjacency=True)


Q.add("e10_alignment_cost", lambda s, d: M.aligned(album_pairs(s, d)).select("case_id", "ref_id", F.round(F.aggregate("alignment", F.lit(0.0), lambda a, x: a + x["cost"]), 6).alias("cost")))
Q.add("e11_album_scores", lambda s, d: _scored(s, d).select("case_id", "ref_id", F.round("distance", 6).alias("distance"), "related", F.size("signals").alias("n_signals")))
Q.add("e13_corroboration", lambda s, d: M.corroborators(_short(_scored(s, d)), "case_id").select("case_id", "ref_id", F.array_join("corroborated_by", ",").alias("corroborated_by")))
Q.add("e10_by_disc", lambda s, d: M.aligned(_with_discs(album_pairs(s, d))).select("case_id", "ref_id", F.size("alignment").alias("rows"), F.round(F.aggregate("alignment", F.lit(0.0), lambda a, x: a + x["cost"]), 6).alias("cost")))
Q.add("e14_duplicates", lambda s, d: _adjacent(s, d).select("case_id", "ref_id", "rank", F.array_join(F.col("is_duplicate_of").cast("array<string>"), ",").alias("is_duplicate_of")))
Q.add("w8_page_of_candidates", lambda s, d: M.page_of(_adjacent(s, d), "case_id", 0, 2).select("case_id", "ref_id", "rank", "more", F.array_join(F.col("is_duplicate_of").cast("array<string>"), ",").alias("is_duplicate_of")))
Q.add("e14_e16_rank", lambda s, d: M.rank(_short(_scored(s, d)), "case_id", earliest=True).select("case_id", "ref_id", F.round("adjusted", 6).alias("adjusted"), "rank", "rejection"))
Q.add("e15_decisions", lambda s, d: M.decide(M.rank(_short(_scored(s, d)), "case_id"), "case_id").select("case_id", "winner", F.round("adjusted", 6).alias("adjusted"), "band"))


def _singles(s, d):
    pairs = album_pairs(s, d)
    first = F.col("local_tracks")[0]
    return pairs.withColumns({"local_title": first["title"], "local_artist": first["artist"], "local_duration_ms": first["duration_ms"], "local_isrc": F.lit(None).cast("string"), "local_acoustid": F.lit(None).cast("string"), "acoustid": F.lit(None).cast("string")})


Q.add("e9_e12_single_scores", lambda s, d: M.score_singles(_singles(s, d), ["case_id", "ref_id"]).select("case_id", "ref_id", F.round("distance", 6).alias("distance"), "related"))
Q.add("e18_local_evidence", lambda s, d: M.local_names(tracks(s, d).select("id", "title", F.lit(None).cast("string").alias("artist"), F.concat(F.lit("01 Artist - "), F.col("id").cast("string"), F.lit(".mp3")).alias("name")), "name").select("id", "title", "artist"), f"WITH {TRACKS} SELECT id, coalesce(title, CAST(id AS VARCHAR)) AS title, 'Artist' AS artist FROM tracks")


_FILE = "CASE id % 4 WHEN 0 THEN concat('01 - Band ', CAST(id % 9 AS {s}), ' - Song ', CAST(id AS {s}), '.mp3') WHEN 1 THEN concat('Take ', CAST(id AS {s}), '.flac') WHEN 2 THEN concat('dir - x/', '7. Trio - Part - ', CAST(id AS {s}), '.ogg') ELSE '.mp3' END"
Q.add(
    "e18_file_names",
    lambda s, d: M.local_names(tracks(s, d).selectExpr("id", "CASE WHEN id % 3 = 0 THEN title END AS title", "CASE WHEN id % 6 = 0 THEN artist END AS artist", _FILE.format(s="STRING") + " AS name"), "name").select("id", "title", "artist"),
    f"WITH {TRACKS} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN title END, CASE id % 4 WHEN 0 THEN 'Song ' || id WHEN 1 THEN 'Take ' || id WHEN 2 THEN 'Part - ' || id ELSE '.mp3' END) AS title, coalesce(CASE WHEN id % 6 = 0 THEN artist END, CASE id % 4 WHEN 0 THEN 'Band ' || (id % 9) WHEN 2 THEN 'Trio' END) AS artist FROM tracks",
)


def _ranked_events(s, d):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return table(s, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("ref_id"), F.row_number().over(w).alias("rank"))


Q.add("l11_top_candidates", lambda s, d: M.top_candidates(_ranked_events(s, d), "case_id").select("case_id", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["source"], x["ref_id"])), ",").alias("candidates")), "WITH r AS (SELECT user_id AS case_id, event_type || ':' || event_id AS c, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) SELECT case_id, string_agg(c, ',' ORDER BY r) AS candidates FROM r WHERE r <= 5 GROUP BY 1")
Q.add("e7_scoped_cascade", lambda s, d: G.cascade(tracks(s, d).withColumn("group_id", F.when(F.col("id") % 3 == 0, F.col("group_id"))), matches(s, d), tracks(s, d).filter("group_id % 4 = 0").select("group_id").distinct(), root="lib/Brand#1"))
_OWN = "CASE id % 3 WHEN 0 THEN concat('Live ', coalesce(title, 'x')) WHEN 1 THEN concat(coalesce(title, 'x'), ' now') ELSE coalesce(title, 'x') END"
Q.add("r15_text_diff", lambda s, d: tracks(s, d).selectExpr("id", "coalesce(title, 'x') AS a", _OWN + " AS b").select("id", F.array_join(F.transform(text_diff_column("a", "b"), lambda x: F.concat_ws("=", x["op"], x["text"])), "|").alias("diff")), f"WITH {TRACKS} SELECT id, CASE WHEN id % 3 = 0 THEN 'insert=Live |' ELSE '' END || 'equal=' || coalesce(title, 'x') || CASE WHEN id % 3 = 1 THEN '|insert= now' ELSE '' END AS diff FROM tracks")


# Stateful folds
def _ticks(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), "value")


Q.add("st2_throttle", lambda s, d: L.fold(_ticks(s, d), lambda: L.Throttle(seconds=3 * 3600.0)).select("key", F.round("at", 3).alias("at"), "value", "flushed"))
Q.add("st3_token_bucket", lambda s, d: L.fold(_ticks(s, d), lambda: L.TokenBucket(rate=1 / 7200, burst=2.0)).select("key", F.round("at", 3).alias("at"), F.round("wait", 3).alias("wait")))
