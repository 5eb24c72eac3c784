"""Catalogue pages, facets, reports and ordered analytics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions import scalars as S
from marram.operators import catalog as C
from marram.operators import ordered as O
from marram.operators import reports as R
from marram.operators.catalog import CatalogQuery
from marram.operators.search_index import PhraseIndex
from marram.sources.shared import shared_path

from .bindings import GROUPS, JOBS, MATCHES, TRACKS, attempts, groups, jobs, matches, table, tracks, turns
from .book import Book

Q = Book()
T = f"WITH {TRACKS} "
TG = f"WITH {TRACKS}, {GROUPS} "
_SHORT = "id, title, artist, album, format"


def _t(f):
    return lambda s, d: f(tracks(s, d))


def _short(df):
    return df.select("id", "title", "artist", "album", "format")


# Projections and filters
Q.add("f1_summary", _t(lambda t: C.summary(t).withColumn("genre", F.array_join("genre", "|"))), T + "SELECT id, title, artist, album, album_artist, array_to_string(genre, '|') AS genre, format, duration_ms, year, track_no, track_total, label, path, group_id, has_art, has_lyrics, probe_error, is_missing, added FROM tracks")
Q.add("f2_detail", lambda s, d: C.detail(tracks(s, d), groups(s, d)).select("id", "group_id", "kind", "confidence", "grouping_needs_resolution"), TG + "SELECT t.id, t.group_id, g.kind, g.confidence, coalesce(NOT g.is_pinned AND g.confidence < 0.8, false) AS grouping_needs_resolution FROM tracks t LEFT JOIN groups g ON g.id = t.group_id")
Q.add("f3_live", _t(lambda t: _short(t.filter(C.where(CatalogQuery())))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing")
Q.add("f4_equality", _t(lambda t: _short(t.filter(C.where(CatalogQuery(artist="Brand#3", format="FLAC"))))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND artist = 'Brand#3' AND format = 'FLAC'")
Q.add("f5_array_membership", _t(lambda t: _short(t.filter(C.where(CatalogQuery(genre="blue"))))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND list_contains(genre, 'blue')")
Q.add("f6_flags", _t(lambda t: _short(t.filter(C.where(CatalogQuery(flags=("missing-art", "unmatched", "unknown-flag")))))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND NOT has_art AND album IS NULL")
Q.add("f6_flag_missing", _t(lambda t: _short(t.filter(C.where(CatalogQuery(flags=("missing",)))))), T + f"SELECT {_SHORT} FROM tracks WHERE is_missing")
Q.add("f6_flag_errored", _t(lambda t: _short(t.filter(C.where(CatalogQuery(flags=("errored",)))))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND probe_error IS NOT NULL")
Q.add("f7_sort_fallback", _t(lambda t: _short(C.list_tracks(t, CatalogQuery(sort="nonsense", order="up", limit=20)))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing ORDER BY title ASC NULLS FIRST, id LIMIT 21")


def _tok(c: str) -> str:
    return f"' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


def _phrase(words: str) -> str:
    return " OR ".join(f"contains({_tok(c)}, ' {words} ')" for c in C.SEARCHED)


Q.add("f9_phrase", _t(lambda t: _short(t.filter(C.where(CatalogQuery(q='"Blue-Gear"'))))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND coalesce({_phrase('blue gear')}, false)")
Q.add("f9_phrase_across_columns", _t(lambda t: _short(t.filter(C.where(CatalogQuery(q="gear brand"))))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND coalesce({_phrase('gear brand')}, false)")
_MARKED = "concat('Björk Ńandú ', coalesce(title, 'x'))"
Q.add("f9_phrase_without_marks", _t(lambda t: _short(t.selectExpr(*[c for c in t.columns if c != "title"], _MARKED + " AS title").filter(C.where(CatalogQuery(q="BJORK nandu"))))), T + f", m AS (SELECT * REPLACE ({_MARKED} AS title) FROM tracks) SELECT {_SHORT} FROM m WHERE NOT is_missing AND contains(strip_accents(lower(title)), 'bjork nandu')")
Q.add("f9_prose", lambda s, d: table(s, d, "documents").filter(C.phrase("that the", ("text",))).select("doc_id", "lang"), f"SELECT doc_id, lang FROM documents WHERE contains({_tok('text')}, ' that the ')")


def _indexed(rows, columns, text, id_="id"):
    """Rows of a table that a fresh index of it finds."""
    index = PhraseIndex(rows.sparkSession, shared_path(rows.sparkSession, "phrases"), columns)
    index.update(rows, id_=id_)
    return rows.join(index.search(text).withColumnRenamed("id", id_), id_, "left_semi")


def _indexed_after_change(s, d):
    """The index of an older state of the catalogue, brought up to date by what changed since."""
    now = tracks(s, d)
    old = now.withColumn("title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("blue gear "), "title")).otherwise(F.col("title"))).filter("id % 5 <> 1")
    index = PhraseIndex(s, shared_path(s, "phrases"), C.SEARCHED)
    index.update(old.unionByName(now.filter("id < 50").withColumn("id", -F.col("id") - 1)))
    index.update(now.filter("id % 3 = 0 or id % 5 = 1"), removed=now.filter("id < 50").select((-F.col("id") - 1).alias("id")))
    return index.search("Blue Gear")


Q.add("f9_indexed_phrase", _t(lambda t: _short(_indexed(t, C.SEARCHED, '"Blue-Gear"').filter("not is_missing"))), Q.oracles["f9_phrase"])
Q.add("f9_indexed_word", _t(lambda t: _short(_indexed(t, C.SEARCHED, "brand"))), T + f"SELECT {_SHORT} FROM tracks WHERE coalesce({_phrase('brand')}, false)")
Q.add("f9_indexed_after_change", _indexed_after_change, T + f"SELECT id FROM tracks WHERE coalesce({_phrase('blue gear')}, false)")
Q.add("f9_indexed_prose", lambda s, d: _indexed(table(s, d, "documents").select("doc_id", "lang", "text"), ("text",), "that the", "doc_id").select("doc_id", "lang"), Q.oracles["f9_prose"])
Q.add("f11_facet_needle", _t(lambda t: C.facet(t, "artist", CatalogQuery(), needle="AND#1")), T + "SELECT artist AS value, count(*) AS n FROM tracks WHERE NOT is_missing AND artist IS NOT NULL AND contains(lower(artist), 'and#1') GROUP BY 1 ORDER BY 1 LIMIT 100")
Q.add("f13_mini_query", _t(lambda t: _short(t.filter(C.matches("artist:BRAND#2,title:g,album:", t.columns)))), T + f"SELECT {_SHORT} FROM tracks WHERE contains(lower(coalesce(artist, '')), 'brand#2') AND contains(lower(coalesce(title, '')), 'g')")
Q.add("f15_needing_gain", _t(C.needing_gain), T + "SELECT DISTINCT group_id FROM tracks WHERE NOT is_missing AND rg_track_gain IS NULL")
Q.add("f16_needing_art", lambda s, d: C.needing_art(groups(s, d), tracks(s, d)), TG + "SELECT id FROM groups g WHERE mb_release_id IS NOT NULL AND EXISTS (SELECT 1 FROM tracks t WHERE t.group_id = g.id AND NOT is_missing AND NOT has_art)")
Q.add("f17_needing_lyrics", _t(lambda t: C.needing_lyrics(t).select("id")), T + "SELECT id FROM tracks WHERE NOT is_missing AND NOT has_lyrics AND title IS NOT NULL AND artist IS NOT NULL")
Q.add("f18_needing_fingerprint", _t(lambda t: C.needing_fingerprint(t, "lib/Brand#1").select("id", "path")), T + "SELECT id, path FROM tracks WHERE NOT is_missing AND fingerprint IS NULL AND (path = 'lib/Brand#1' OR starts_with(path, 'lib/Brand#1/'))")
Q.add("f19_units_to_match", lambda s, d: C.units_to_match(groups(s, d), tracks(s, d), "lib"), TG + "SELECT id FROM groups g WHERE match_state = 'unmatched' AND (SELECT bool_and(starts_with(path, 'lib/')) FROM tracks t WHERE t.group_id = g.id)")
Q.add("f20_ids_by_semi_join", lambda s, d: tracks(s, d).join(table(s, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("id")), "id", "left_semi").select("id", "title"), T + "SELECT id, title FROM tracks WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
Q.add("f22_effective_settings", lambda s, d: C.effective(table(s, d, "nation").select(F.lower("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value")), {"france": "env"}, {"france": "d", "nation#3": "d", "nowhere": "d"}), "WITH k(name, env, fallback) AS (VALUES ('france', 'env', 'd'), ('nation#3', NULL, 'd'), ('nowhere', NULL, 'd')), s AS (SELECT lower(n_name) AS name, CAST(n_regionkey AS VARCHAR) AS value FROM nation) SELECT k.name, coalesce(env, value, fallback) AS value, CASE WHEN env IS NOT NULL THEN 'env' WHEN value IS NOT NULL THEN 'stored' ELSE 'default' END AS origin FROM k LEFT JOIN s USING (name)")
Q.add("s17_by_path", _t(lambda t: _short(t.filter(F.col("path") == "lib/Brand#2/0.mp3"))), T + f"SELECT {_SHORT} FROM tracks WHERE path = 'lib/Brand#2/0.mp3'")
Q.add("s6_scope", _t(lambda t: t.filter(C.in_scope(F.col("path"), "lib/Brand#2/")).select("id", "path")), T + "SELECT id, path FROM tracks WHERE starts_with(path, 'lib/Brand#2/')")

# Joins
Q.add("j1_unnest", _t(lambda t: t.select("id", F.explode("genre").alias("g"))), T + "SELECT id, unnest(genre) AS g FROM tracks")
Q.add("j13_unknown_ids", lambda s, d: C.unknown_ids(table(s, d, "events").select((F.col("user_id") * 20).alias("id")).distinct(), tracks(s, d)), T + "SELECT DISTINCT user_id * 20 AS id FROM events WHERE user_id * 20 NOT IN (SELECT id FROM tracks)")
Q.add("j14_same_collection", lambda s, d: tracks(s, d).groupBy(S.identity(F.col("album")).alias("album_key"), S.identity(F.col("album_artist")).alias("artist_key")).agg(F.count("*").alias("n")).filter("album_key <> '' and artist_key <> '' and n > 1"), T + "SELECT lower(trim(regexp_replace(album, '\\s+', ' ', 'g'))) AS album_key, lower(trim(regexp_replace(album_artist, '\\s+', ' ', 'g'))) AS artist_key, count(*) AS n FROM tracks GROUP BY 1, 2 HAVING album_key <> '' AND artist_key <> '' AND n > 1")

# Facets and reports
_FACET = "SELECT {c} AS value, count(*) AS n FROM tracks WHERE NOT is_missing AND {w} AND {c} IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 100"
Q.add("a1_total", _t(lambda t: C.count_tracks(t, CatalogQuery(album="PROMO"))), T + "SELECT count(*) AS total FROM tracks WHERE NOT is_missing AND album = 'PROMO'")
Q.add("a2_facet_artist", _t(lambda t: C.facet(t, "artist", CatalogQuery(album="PROMO", artist="Brand#1"))), T + _FACET.format(c="artist", w="album = 'PROMO'"))
Q.add("a2_facet_cursor", _t(lambda t: C.facet(t, "album", CatalogQuery(artist="Brand#1"), cursor="LARGE", limit=3)), T + "SELECT album AS value, count(*) AS n FROM tracks WHERE NOT is_missing AND artist = 'Brand#1' AND album > 'LARGE' GROUP BY 1 ORDER BY 1 LIMIT 3")
Q.add("a3_facet_genre", _t(lambda t: C.facet(t, "genre", CatalogQuery(format="MP3"))), T + "SELECT g AS value, count(*) AS n FROM (SELECT unnest(genre) AS g FROM tracks WHERE NOT is_missing AND format = 'MP3') GROUP BY 1 ORDER BY 1 LIMIT 100")
Q.add("a3_all_facets", _t(lambda t: C.facets(t, CatalogQuery(album="PROMO", format="FLAC"))), T + ", f AS (SELECT * FROM tracks WHERE NOT is_missing) SELECT 'artist' AS facet, artist AS value, count(*) AS n FROM f WHERE album = 'PROMO' AND format = 'FLAC' AND artist IS NOT NULL GROUP BY 2 UNION ALL SELECT 'album', album, count(*) FROM f WHERE format = 'FLAC' AND album IS NOT NULL GROUP BY 2 UNION ALL SELECT 'format', format, count(*) FROM f WHERE album = 'PROMO' AND format IS NOT NULL GROUP BY 2 UNION ALL SELECT 'genre', g, count(*) FROM (SELECT unnest(genre) AS g FROM f WHERE album = 'PROMO' AND format = 'FLAC') GROUP BY 2")
Q.add("a4_dashboard", lambda s, d: R.dashboard(tracks(s, d), groups(s, d)), TG + "SELECT count(*) FILTER (NOT is_missing) AS tracks, count(*) FILTER (NOT is_missing AND NOT has_art) AS without_art, count(*) FILTER (NOT is_missing AND album IS NULL) AS unmatched, count(*) FILTER (NOT is_missing AND probe_error IS NOT NULL) AS errored, count(*) FILTER (is_missing) AS missing, (SELECT count(*) FROM groups WHERE kind IN ('album', 'partial_album')) AS albums, (SELECT count(*) FROM groups WHERE kind = 'singleton') AS singletons, (SELECT count(*) FROM groups WHERE kind = 'unknown') AS unknown_units FROM tracks")
_METRICS = f"WITH {TRACKS}, {GROUPS}, {JOBS}, m AS (SELECT 'tracks' AS name, '' AS label, count(*) AS value FROM tracks UNION ALL SELECT 'groups', '', count(*) FROM groups UNION ALL SELECT 'missing', '', count(*) FROM tracks WHERE is_missing UNION ALL SELECT 'jobs', state, count(*) FROM jobs GROUP BY state) "
Q.add("a5_metrics", lambda s, d: R.metrics(tracks(s, d), groups(s, d), jobs(s, d)), _METRICS + "SELECT * FROM m")
Q.add("s18_prometheus", lambda s, d: R.prometheus(R.metrics(tracks(s, d), groups(s, d), jobs(s, d))), _METRICS + "SELECT 'catalog_' || name || CASE WHEN label = '' THEN '' ELSE '{state=\"' || label || '\"}' END || ' ' || CAST(value AS VARCHAR) AS line FROM m")
Q.add("a6_split", _t(R.split_report), T + ", x AS (SELECT *, album IS NULL OR trim(album) = '' OR album_artist IS NULL OR trim(album_artist) = '' AS single FROM tracks) SELECT count(*) AS total, count(*) FILTER (single) AS singletons, count(DISTINCT (album_artist, album)) FILTER (NOT single) AS albums FROM x")
_FIELDS = ["title", "artist", "album", "album_artist", "genre", "year", "track_total", "barcode", "has_art", "label"]
Q.add("a7_completeness", _t(lambda t: R.completeness(t, _FIELDS)), T + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (NOT ({f} IS NULL{' OR trim(' + f + chr(41) + ' = ' + chr(39) * 2 if f in ('title', 'artist', 'album', 'album_artist', 'barcode', 'label') else ' OR len(genre) = 0' if f == 'genre' else ''})) AS present, count(*) AS total FROM tracks" for f in _FIELDS))
Q.add("a8_exact_duplicates", _t(lambda t: R.exact_duplicates(t).select("artist_key", "title_key", F.array_join("ids", ",").alias("ids"))), T + "SELECT lower(trim(artist)) AS artist_key, lower(trim(title)) AS title_key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM tracks WHERE trim(artist) <> '' AND trim(title) <> '' GROUP BY 1, 2 HAVING count(*) > 1")
Q.add("a8_duplicate_rows", _t(R.exact_duplicate_rows), T + "SELECT lower(trim(artist)) AS artist_key, lower(trim(title)) AS title_key, id FROM tracks WHERE trim(artist) <> '' AND trim(title) <> '' QUALIFY count(*) OVER (PARTITION BY 1, 2) > 1".replace("PARTITION BY 1, 2", "PARTITION BY lower(trim(artist)), lower(trim(title))"))
Q.add("a9_breakdown", _t(R.breakdown), T + "SELECT format AS value, count(*) AS n FROM tracks WHERE format IS NOT NULL GROUP BY 1")
Q.add("a10_mean", _t(lambda t: R.mean_of(t, "duration_ms")), T + "SELECT round(avg(duration_ms), 6) AS mean FROM tracks")
Q.add("a16_next_attempt", lambda s, d: O.next_attempt(attempts(s, d), ["item_key"], "attempt_no"), "SELECT l_orderkey AS item_key, max(l_linenumber) + 1 AS next_attempt FROM lineitem GROUP BY 1")
Q.add("a19_release_votes", lambda s, d: _votes(s, d), f"WITH {MATCHES}, v AS (SELECT DISTINCT track_id, unnest(mb_release_ids) AS release_id FROM matches) SELECT release_id, count(*) AS votes FROM v GROUP BY 1")
Q.add("a20_consensus", _t(lambda t: R.consensus(t, "group_id", "track_total")), T + "SELECT group_id, CASE WHEN count(DISTINCT nullif(track_total, 0)) = 1 THEN max(nullif(track_total, 0)) END AS agreed, count(*) AS members FROM tracks GROUP BY 1")
Q.add("a21_recount", _t(lambda t: t.groupBy("group_id").agg(F.count("*").alias("members"))), T + "SELECT group_id, count(*) AS members FROM tracks GROUP BY 1")
Q.add("a22_distinct", _t(lambda t: t.select("artist", "format").distinct()), T + "SELECT DISTINCT artist, format FROM tracks")
Q.add("a24_p95_of_all", lambda s, d: R.nearest_rank(table(s, d, "lineitem").withColumn("every", F.lit(0)), "every", "l_extendedprice"), "SELECT 0 AS every, list_sort(list(l_extendedprice))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS p FROM lineitem")
Q.add("a24_p95", lambda s, d: R.nearest_rank(table(s, d, "events"), "event_type", "value"), "SELECT event_type, list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS p FROM events GROUP BY 1")
Q.add("r16_common_value", _t(lambda t: R.common_value(t, "group_id", "format")), T + "SELECT group_id, CASE WHEN count(DISTINCT coalesce(format, '<null>')) = 1 THEN max(format) END AS value, count(DISTINCT coalesce(format, '<null>')) > 1 AS multiple FROM tracks GROUP BY 1")

# Windows
Q.add("a11_best_match", lambda s, d: O.best_match(matches(s, d)).select("track_id", "mb_recording_id", "score"), f"WITH {MATCHES} SELECT track_id, mb_recording_id, score FROM matches QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, id) = 1")
Q.add("a15_beyond_newest", lambda s, d: O.beyond_newest(table(s, d, "events"), "user_id", "ts", 20), "WITH r AS (SELECT user_id, min(ts) AS began FROM events GROUP BY 1) SELECT user_id, began FROM r QUALIFY row_number() OVER (ORDER BY began DESC, user_id DESC) > 20")
Q.add("a17_latest", lambda s, d: O.latest(turns(s, d), ["conv_id", "role"], "turn").select("conv_id", "role", "turn"), "SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY 1, 2")
Q.add("w3_neighbours", lambda s, d: O.neighbours(turns(s, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "conv_id", [F.asc("turn")], "id", F.col("role") != "user"), "WITH c AS (SELECT conv_id, conv_id * 1000 + turn AS id, turn, role FROM conversations) SELECT conv_id, id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, min(CASE WHEN role = 'user' THEN id END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open_id FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
Q.add("w4_sequence", lambda s, d: O.numbered(table(s, d, "events"), "user_id", [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", F.col("seq").cast("long").alias("seq")), "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
Q.add("w5_rank_gap", lambda s, d: O.rank_gap(table(s, d, "events"), "user_id", "value", "event_id").withColumn("gap", F.round("gap", 6)), "SELECT user_id, value AS best, lead(value) OVER w AS second, round(lead(value) OVER w - value, 6) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id) QUALIFY row_number() OVER w = 1")
Q.add("w6_interleave", lambda s, d: O.interleave(table(s, d, "events").withColumn("item", F.col("event_id") % 500), "event_type", "event_id", {"click": 0, "view": 1, "purchase": 2, "error": 3}, ["event_type", "item"], 40).select("event_type", "item"), "WITH r AS (SELECT event_type, event_id % 500 AS item, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END AS place FROM events), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY event_type, item ORDER BY turn, place) = 1) SELECT event_type, item FROM f ORDER BY turn, place NULLS FIRST LIMIT 40")
Q.add("w7_keep_first", lambda s, d: O.keep_first(table(s, d, "events"), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type"), "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
Q.add("w8_remap", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a")).select("o_custkey", F.array_join(F.transform(F.filter("a", lambda x: x % 3 != 0), lambda x: x % 100), ",").alias("remapped")), "SELECT o_custkey, coalesce(string_agg(CAST(o_orderkey % 100 AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_orderkey % 3 <> 0), '') AS remapped FROM orders GROUP BY 1")

# Pages
_ASC = "ORDER BY {c} ASC NULLS FIRST, id LIMIT {n}"
_DESC = "ORDER BY {c} DESC NULLS LAST, id DESC LIMIT {n}"
Q.add("l1_first_page", _t(lambda t: _short(C.list_tracks(t, CatalogQuery(limit=50)))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing " + _ASC.format(c="title", n=51))
Q.add("l1_after_null_asc", _t(lambda t: _short(C.list_tracks(t, CatalogQuery(sort="artist", cursor=(None, 300), limit=30)))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND (artist IS NOT NULL OR id > 300) " + _ASC.format(c="artist", n=31))
Q.add("l1_after_value_asc", _t(lambda t: _short(C.list_tracks(t, CatalogQuery(sort="album", cursor=("LARGE", 700), limit=30)))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND (album > 'LARGE' OR (album = 'LARGE' AND id > 700)) " + _ASC.format(c="album", n=31))
Q.add("l1_after_value_desc", _t(lambda t: _short(C.list_tracks(t, CatalogQuery(sort="album", order="desc", cursor=("LARGE", 700), limit=30)))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND (album IS NULL OR album < 'LARGE' OR (album = 'LARGE' AND id < 700)) " + _DESC.format(c="album", n=31))
Q.add("l1_after_null_desc", _t(lambda t: _short(C.list_tracks(t, CatalogQuery(sort="album", order="desc", cursor=(None, 900), limit=30)))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND album IS NULL AND id < 900 " + _DESC.format(c="album", n=31))
Q.add("l1_added", _t(lambda t: _short(C.list_tracks(t, CatalogQuery(sort="added", order="desc", cursor=(250, 750), limit=30)))), T + f"SELECT {_SHORT} FROM tracks WHERE NOT is_missing AND (added < 250 OR (added = 250 AND id < 750)) " + _DESC.format(c="added", n=31))
Q.add("l10_offset_page", _t(lambda t: _short(O.offset_page(t, [F.asc("id")], 3, 25))), T + f"SELECT {_SHORT} FROM tracks ORDER BY id LIMIT 26 OFFSET 50")


def _votes(s, d):
    from marram.operators.grouping import release_votes, vote_counts

    return vote_counts(release_votes(matches(s, d)))


# Scalar functions
def _scalars(s, d):
    t = tracks(s, d)
    return t.select(
        "id",
        F.round(S.numeric_distance(F.col("year"), F.col("track_no") + 1990, 10.0), 6).alias("numeric"),
        S.exact_distance(F.col("artist"), F.col("album_artist")).alias("exact"),
        F.round(S.weighted_distance({"year": S.numeric_distance(F.col("year"), F.lit(2000), 40.0), "fmt": F.when(F.col("format").isNotNull(), S.exact_distance(F.col("format"), F.lit("MP3")))}, {"year": 2.0, "fmt": 0.5}), 6).alias("weighted"),
        S.barcode(F.concat(F.lit(" "), "barcode")).alias("code"),
        S.recording_code(F.lit("us-ab1-23-45678")).alias("isrc"),
        S.release_id(F.lit(" 0E1F2A3B-0000-4000-8000-00000000ABCD ")).alias("mbid"),
        S.format_label(F.col("path")).alias("label_of_path"),
        S.confidence_label(F.col("year") / 2100).alias("confidence"),
    )


Q.add("b4_b15_scalars", _scalars, T + """SELECT id, round(CASE WHEN year IS NULL THEN 1.0 ELSE least(abs(year - (track_no + 1990)) / 10.0, 1.0) END, 6)::DOUBLE AS numeric,
  CASE WHEN artist = album_artist THEN 0.0 ELSE 1.0 END::DOUBLE AS exact,
  round(((CASE WHEN year IS NULL THEN 1.0 ELSE least(abs(year - 2000) / 40.0, 1.0) END) * 2 + CASE WHEN format IS NULL THEN 0 WHEN format = 'MP3' THEN 0 ELSE 0.5 END) / (2 + CASE WHEN format IS NULL THEN 0 ELSE 0.5 END), 6)::DOUBLE AS weighted,
  barcode AS code, 'USAB12345678' AS isrc, '0e1f2a3b-0000-4000-8000-00000000abcd' AS mbid, CASE WHEN ends_with(path, 'mp3') THEN 'MP3' ELSE 'FLAC' END AS label_of_path,
  CASE WHEN year IS NULL THEN 'manual' WHEN year / 2100 >= 0.85 THEN 'high' WHEN year / 2100 >= 0.65 THEN 'medium' ELSE 'low' END AS confidence FROM tracks""")
Q.add("b7_signals", _t(lambda t: t.select("id", F.explode(S.signals({"year": F.when(F.col("year").isNotNull(), S.numeric_distance(F.col("year"), F.lit(2000), 40.0)), "total": F.when(F.col("track_total").isNotNull(), S.exact_distance(F.col("track_total"), F.col("track_no")))}, {"year": 1.0, "total": 3.0})).alias("s")).select("id", "s.field", "s.weight", F.round("s.contribution", 6).alias("contribution"))), T + ", x AS (SELECT id, CASE WHEN year IS NOT NULL THEN least(abs(year - 2000) / 40.0, 1.0) END AS y, CASE WHEN track_total IS NULL THEN NULL WHEN track_total = track_no THEN 0.0 ELSE 1.0 END AS t FROM tracks), w AS (SELECT *, (CASE WHEN y IS NULL THEN 0 ELSE 1 END) + (CASE WHEN t IS NULL THEN 0 ELSE 3 END) AS total FROM x) SELECT id, 'year' AS field, 1.0::DOUBLE AS weight, round(y / total, 6)::DOUBLE AS contribution FROM w WHERE y IS NOT NULL UNION ALL SELECT id, 'total', 3.0, round(t * 3 / total, 6) FROM w WHERE t IS NOT NULL")
_NAME = "concat(CASE WHEN id % 3 = 0 THEN '0' || CAST(id % 90 + 10 AS {s}) || ' - ' ELSE '' END, CASE WHEN id % 2 = 0 THEN 'Some Artist - ' ELSE '' END, coalesce(title, ''), '.mp3')"
Q.add("b8_filename", _t(lambda t: t.selectExpr("id", _NAME.format(s="STRING") + " AS name").select("id", S.file_name_parts(F.col("name")).alias("p")).select("id", "p.artist", "p.title", "p.confidence")), T + f", n AS (SELECT id, trim(regexp_replace(regexp_replace({_NAME.format(s='VARCHAR')}, '(.)\\.mp3$', '\\1'), '^\\s*(\\d{{1,3}}[ ._-]+)?', '')) AS stem FROM tracks), p AS (SELECT id, stem, regexp_matches(stem, '^.*?\\S\\s+-\\s+\\S') AS two FROM n) SELECT id, CASE WHEN two THEN trim(regexp_extract(stem, '^(.*?)\\s+-\\s+(.*)$', 1)) END AS artist, CASE WHEN two THEN trim(regexp_extract(stem, '^(.*?)\\s+-\\s+(.*)$', 2)) WHEN stem <> '' THEN stem END AS title, CASE WHEN two THEN 0.95 WHEN stem <> '' THEN 0.45 ELSE 0.0 END::DOUBLE AS confidence FROM p")
Q.add("b10_b11_parsing", _t(lambda t: t.select("id", S.of_total(F.concat(F.col("track_no").cast("string"), F.lit("/"), F.coalesce(F.col("track_total").cast("string"), F.lit("x")))).alias("p"), S.year_of(F.concat(F.col("year").cast("string"), F.lit("-05"))).alias("y"), S.clock_ms(F.concat(F.col("track_no").cast("string"), F.lit(":07"))).alias("ms"), S.lenient_float(F.lit("-6.50 dB")).alias("gain"), S.lenient_int(F.lit(" 12 ")).alias("n")).select("id", "p.number", "p.total", "y", "ms", "gain", "n")), T + "SELECT id, track_no AS number, track_total AS total, year AS y, (track_no * 60 + 7) * 1000::BIGINT AS ms, -6.5::DOUBLE AS gain, 12 AS n FROM tracks")
Q.add("b12_candidate_url", lambda s, d: table(s, d, "pages").select("page_id", S.candidate_url(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.discogs.com/release/"), (F.col("page_id") + 1).cast("string"), F.lit("-x"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://www.deezer.com/en/album/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))).alias("u")).select("page_id", "u.provider", "u.type", "u.id"), "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'discogs' WHEN 1 THEN 'deezer' END AS provider, CASE page_id % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'album' END AS type, CASE page_id % 4 WHEN 0 THEN CAST(page_id + 1 AS VARCHAR) WHEN 1 THEN CAST(page_id AS VARCHAR) END AS id FROM pages")
Q.add("b19_digest", lambda s, d: table(s, d, "region").select("r_regionkey", S.digest(table(s, d, "region"), "r_regionkey", "r_name").alias("digest")), "SELECT r_regionkey, sha256('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}') AS digest FROM region")
_ISRC = "concat('us-', CASE WHEN id % 3 = 0 THEN 'ab' ELSE 'Z9' END, CAST(id % 10 AS {s}), '-', CAST(10 + id % 90 AS {s}), ' ', CAST(10000 + id AS {s}), CASE WHEN id % 4 = 0 THEN 'x' ELSE '' END)"
_UUID = "concat(substr(md5(path), 1, 8), '-', substr(md5(path), 9, 4), '-', substr(md5(path), 13, 4), '-', substr(md5(path), 17, 4), '-', substr(md5(path), 21, CASE WHEN id % 5 = 0 THEN 11 ELSE 12 END))"
Q.add("b5_b6_codes", _t(lambda t: t.selectExpr("id", _ISRC.format(s="STRING") + " AS isrc", f"concat(' ', upper({_UUID}), '\t') AS mbid").select("id", S.recording_code(F.col("isrc")).alias("isrc"), S.release_id(F.col("mbid")).alias("mbid"))), T + f"SELECT id, CASE WHEN id % 4 <> 0 AND id < 90000 THEN upper(replace(replace({_ISRC.format(s='VARCHAR')}, '-', ''), ' ', '')) END AS isrc, CASE WHEN id % 5 <> 0 THEN {_UUID} END AS mbid FROM tracks")
_EXT = [".mp3", ".FLAC", ".ogg", ".opus", ".m4a", ".wav", ".aiff", ".Aif", ".aac", ""]
Q.add("b14_format_labels", _t(lambda t: t.select("id", S.format_label(F.concat(F.lit("lib/a.b/x"), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("id") % len(_EXT)).cast("int") + 1))).alias("label"))), T + f"SELECT id, CASE lower({_EXT}[id % {len(_EXT)} + 1]) WHEN '.mp3' THEN 'MP3' WHEN '.flac' THEN 'FLAC' WHEN '.ogg' THEN 'OGG' WHEN '.opus' THEN 'Opus' WHEN '.m4a' THEN 'MP4' WHEN '.wav' THEN 'WAV' WHEN '.aiff' THEN 'AIFF' WHEN '.aif' THEN 'AIFF' END AS label FROM tracks")


def _map_digests(s, d):
    pairs = lambda *names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names)))
    t = tracks(s, d).select("id", F.when(F.col("id") % 2 == 0, pairs("title", "artist")).otherwise(pairs("artist", "title")).alias("tags"))
    return t.select("id", S.digest(t, "tags").alias("digest"))


_JSON = "coalesce('\"' || {c} || '\"', 'null')"
Q.add("b19_map_digest", _map_digests, T + f"SELECT id, sha256('{{\"tags\":{{\"artist\":' || {_JSON.format(c='artist')} || ',\"title\":' || {_JSON.format(c='title')} || '}}}}') AS digest FROM tracks")
Q.add("b21_search_terms", _t(lambda t: t.select("id", S.search_terms({"artist": "artist", "release": "album"}).alias("terms"))), T + "SELECT id, concat_ws(' AND ', CASE WHEN trim(artist) <> '' THEN 'artist:\"' || artist || '\"' END, CASE WHEN trim(album) <> '' THEN 'release:\"' || album || '\"' END) AS terms FROM tracks")
_VALUE = "CASE c_custkey % 6 WHEN 0 THEN '[\"a\",\"b\"]' WHEN 1 THEN '[]' WHEN 2 THEN '[1]' WHEN 3 THEN 'a' WHEN 4 THEN '{}' END"
Q.add("r12_lists", lambda s, d: table(s, d, "customer").select("c_custkey", S.valid_value(F.lit("multi_text"), F.expr(_VALUE), F.col("c_custkey") % 7 > 0).alias("is_list")), "SELECT c_custkey, c_custkey % 6 < 2 AND c_custkey % 7 > 0 AS is_list FROM customer")
_QUOTED = "CASE WHEN {c} <> '' THEN '{n}:\"' || {c} || '\"' END"
_OWN = "coalesce(nullif(artist, ''), nullif(album_artist, ''))"
Q.add("b21_plain_terms", _t(lambda t: t.select("id", S.plain_terms(("title", "album"), ("artist", "album_artist")).alias("plain"), S.tagged_terms({"album": ("album",), "artist": ("artist", "album_artist")}).alias("tagged"))), T + f"SELECT id, concat_ws(' ', coalesce(nullif(title, ''), nullif(album, '')), {_OWN}) AS plain, concat_ws(' ', {_QUOTED.format(c='album', n='album')}, 'artist:\"' || {_OWN} || '\"') AS tagged FROM tracks")
Q.add("b21_track_searches", _t(lambda t: t.withColumn("isrc", F.when(F.col("id") % 2 == 0, F.lit("X1"))).select("id", F.array_join(S.track_searches(), " / ").alias("searches"))), T + f"SELECT id, CASE WHEN title IS NULL AND id % 2 = 1 THEN '' ELSE concat_ws(' / ', CASE WHEN id % 2 = 0 OR title IS NULL THEN concat_ws(' ', CASE WHEN id % 2 = 0 THEN 'isrc:\"X1\"' END, {_QUOTED.format(c='title', n='track')}, {_QUOTED.format(c='artist', n='artist')}) END, CASE WHEN title <> '' AND artist <> '' THEN 'track:\"' || title || '\" artist:\"' || artist || '\"' END, {_QUOTED.format(c='title', n='track')}) END AS searches FROM tracks")
Q.add("r12_valid_values", lambda s, d: table(s, d, "customer").select("c_custkey", S.valid_value(F.lit("float"), F.col("c_acctbal").cast("string")).alias("is_float"), S.valid_value(F.lit("int"), F.col("c_name")).alias("name_is_int"), S.valid_value(F.lit("date"), F.when(F.col("c_custkey") % 2 == 0, "2024-02-30").otherwise("2024-02-29")).alias("is_date")), "SELECT c_custkey, true AS is_float, false AS name_is_int, c_custkey % 2 = 1 AS is_date FROM customer")
Q.add("r13_synced_lyrics", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", S.has_synced_lines(F.when(F.col("turn") == 0, F.regexp_replace("text", "(?m)^", "[0:01.5] ")).otherwise(F.col("text"))).alias("synced")), "SELECT conv_id, turn, turn = 0 AS synced FROM conversations")
Q.add("st10_retry_delay", _t(lambda t: t.select("id", F.round(S.retry_delay(F.col("track_no"), F.lit(0.5), F.when(F.col("id") % 5 == 0, F.lit(40.0))), 6).alias("delay"))), T + "SELECT id, round(greatest(least(pow(2.0, track_no), 60.0) * 0.5, CASE WHEN id % 5 = 0 THEN 40.0 ELSE 0.0 END), 6)::DOUBLE AS delay FROM tracks")
