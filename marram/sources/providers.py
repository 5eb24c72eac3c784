"""Provider answers (JSON texts) as candidate rows, and the loudness report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.scalars import clock_ms, year_of

CANDIDATE = ("source", "ref_id", "album", "album_artist", "year", "barcode", "country", "tracks")

_MB = "struct<id:string,title:string,date:string,barcode:string,country:string,`artist-credit`:array<struct<name:string,joinphrase:string>>,media:array<struct<tracks:array<struct<title:string,length:bigint>>>>>"
_DISCOGS = "struct<id:bigint,title:string,year:string,country:string,artists:array<struct<name:string>>,identifiers:array<struct<type:string,value:string>>,tracklist:array<struct<title:string,duration:string>>>"
_DEEZER = "struct<id:bigint,title:string,upc:string,release_date:string,artist:struct<name:string>,tracks:struct<data:array<struct<title:string,duration:bigint>>>>"
_ACOUSTID = "struct<status:string,results:array<struct<score:double,recordings:array<struct<id:string,releases:array<struct<id:string>>>>>>>"
_LYRICS = "struct<id:bigint,plainLyrics:string,syncedLyrics:string,instrumental:boolean>"


def _tracks(items: Column, ms) -> Column:
    made = F.transform(items, lambda t, i: F.struct((i + 1).alias("position"), t["title"].alias("title"), ms(t).cast("long").alias("duration_ms")))
    return F.coalesce(made, F.array().cast("array<struct<position:int,title:string,duration_ms:bigint>>"))


def candidates(answers: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and (source, ref_id, album, album_artist, year, barcode, country, tracks) of every release answer.

    ``answers`` has source (musicbrainz, discogs or deezer) and the JSON text; a text that is
    no such JSON gives a row of nulls.
    """
    mb, dg, dz = (F.from_json(payload, s) for s in (_MB, _DISCOGS, _DEEZER))
    credit = F.array_join(F.transform(mb["artist-credit"], lambda a: F.concat(a["name"], F.coalesce(a["joinphrase"], F.lit("")))), "")
    mb_tracks = F.flatten(F.transform(mb["media"], lambda m: F.coalesce(m["tracks"], F.array().cast("array<struct<title:string,length:bigint>>"))))
    code = F.get(F.transform(F.filter(dg["identifiers"], lambda x: F.lower(x["type"]) == "barcode"), lambda x: x["value"]), F.lit(0))
    rows = {
        "musicbrainz": (mb["id"], mb["title"], credit, year_of(mb["date"]), mb["barcode"], mb["country"], _tracks(mb_tracks, lambda t: t["length"])),
        "discogs": (dg["id"].cast("string"), dg["title"], F.array_join(F.transform(dg["artists"], lambda a: a["name"]), ", "), year_of(dg["year"]), F.regexp_replace(code, r"[\s-]", ""), dg["country"], _tracks(dg["tracklist"], lambda t: clock_ms(t["duration"]))),
        "deezer": (dz["id"].cast("string"), dz["title"], dz["artist"]["name"], year_of(dz["release_date"]), dz["upc"], F.lit(None).cast("string"), _tracks(dz["tracks"]["data"], lambda t: t["duration"] * 1000)),
    }
    out = []
    for k, name in enumerate(CANDIDATE[1:]):
        c = F.when(F.lit(False), list(rows.values())[0][k])
        for source, cells in rows.items():
            c = c.when(F.col("source") == source, cells[k])
        out.append(c.alias(name))
    return answers.select(*keep, "source", *out)


def fingerprint_matches(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """(track_id, mb_recording_id, mb_release_ids, score): a row a recording; those without id are dropped."""
    doc = F.from_json(payload, _ACOUSTID)
    results = answers.select("track_id", F.explode(F.when(doc["status"] == "ok", doc["results"])).alias("r"))
    found = results.select("track_id", F.coalesce("r.score", F.lit(0.0)).alias("score"), F.explode("r.recordings").alias("rec")).filter("rec.id <> ''")
    releases = F.filter(F.transform(F.coalesce("rec.releases", F.array().cast("array<struct<id:string>>")), lambda r: r["id"]), lambda x: x != "")
    return found.select("track_id", F.col("rec.id").alias("mb_recording_id"), releases.alias("mb_release_ids"), "score")


def lyrics(answers: DataFrame, payload: str = "payload") -> DataFrame:
    doc = F.from_json(payload, _LYRICS)
    return answers.select("track_id", F.coalesce(doc["syncedLyrics"], doc["plainLyrics"]).alias("lyrics"), doc["syncedLyrics"].isNotNull().alias("synced"), F.coalesce(doc["instrumental"], F.lit(False)).alias("instrumental"))


def loudness(rows: DataFrame) -> DataFrame:
    """(path, gain, peak, album_gain, album_peak) of a tab-separated loudness report read with a header.

    The row named Album fills album values that tracks lack.
    """
    number = lambda c: F.regexp_extract(F.col(c), r"([+-]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    named = lambda *names: next((c for n in names for c in rows.columns if c == n), None)
    path, gain, peak = named("Filename", "File"), named("Gain (dB)", "Gain"), named("Peak")
    own = [number(c).alias(a) if c else F.lit(None).cast("double").alias(a) for c, a in ((gain, "gain"), (peak, "peak"), (named("Album Gain (dB)", "Album Gain"), "album_gain"), (named("Album Peak"), "album_peak"))]
    every = rows.select(F.col(path).alias("path"), *own)
    album = every.filter("path = 'Album'").agg(F.first("gain").alias("_g"), F.first("peak").alias("_p"))
    return every.filter("path <> 'Album'").join(album).select("path", "gain", "peak", F.coalesce("album_gain", "_g").alias("album_gain"), F.coalesce("album_peak", "_p").alias("album_peak"))


def outcome(configured: Column, failed: Column, hits: Column) -> Column:
    """What a provider's request came to; a failure is not an empty result."""
    return F.when(~configured, "not_configured").when(failed, "failed").when(hits == 0, "zero_results").otherwise("results")


def retrieval_outcome(offline: Column, refresh: Column, fresh: Column, stale: Column, failed: Column, hits: Column) -> Column:
    """struct(status, results, detail) of a search that may be answered from the cache.

    ``fresh`` and ``stale`` are the numbers of results cached within and beyond their time,
    null where nothing is cached; ``hits`` what the provider answered.  Offline only the cache
    answers.  A failure falls back on a stale answer with results, never on an empty one.
    """
    made = lambda status, n, detail: F.struct(F.lit(status).alias("status"), n.cast("long").alias("results"), F.lit(detail).cast("string").alias("detail"))
    got = lambda n, detail: F.when(F.coalesce(n, F.lit(0)) > 0, made("results", n, detail)).otherwise(made("zero_results", F.lit(0), None))
    live = F.when(~failed, got(hits, None)).when(stale > 0, made("results", stale, "stale cache")).otherwise(made("failed", F.lit(0), "search failed"))
    return F.when(offline, got(stale, "offline cache (stale)")).when(~refresh & fresh.isNotNull(), got(fresh, "cache")).otherwise(live)


def outcomes_in_order(requested: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every requested provider, in order, with its outcome; absent ones are not configured."""
    return requested.join(outcomes, "source", "left").select("position", "source", F.coalesce("outcome", F.lit("not_configured")).alias("outcome"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits")).orderBy("position")
