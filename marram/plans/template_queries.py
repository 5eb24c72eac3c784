"""Path templates over tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions import template as P

from .bindings import TRACKS, tracks
from .book import Book

Q = Book()
T = f"WITH {TRACKS} "


def _value(source: str):
    def run(s, d):
        t = tracks(s, d)
        made = P.Template(source, t)
        return t.select("id", made.value.alias("value"), made.problem.alias("problem"))

    return run


def _add(name: str, source: str, sql: str) -> None:
    Q.add(name, _value(source), T + f"SELECT id, {sql} AS value, CAST(NULL AS VARCHAR) AS problem FROM tracks")


_add("p4_fields", "$title|${album}|$nothing|$has_art|$year|$$%%", "coalesce(title, '') || '|' || coalesce(album, '') || '||' || CASE WHEN has_art THEN '1' ELSE '' END || '|' || coalesce(CAST(year AS VARCHAR), '') || '|$%'")
_add("p5_case", "%upper{$title} %lower{$artist}", "upper(coalesce(title, '')) || ' ' || lower(coalesce(artist, ''))")
_add("p6_title", "%title{$title}", "coalesce(array_to_string(list_transform(string_split(title, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' '), '')")
_add("p7_left", "%left{$title,4}/%left{$title,-3}", "left(coalesce(title, ''), 4) || '/' || substr(coalesce(title, ''), 1, greatest(length(coalesce(title, '')) - 3, 0))")
_add("p8_right", "%right{$title,3}%right{$title,0}", "right(coalesce(title, ''), 3)")
_add("p9_if", "%if{$title,$title by $artist,unknown}", "CASE WHEN title IS NULL THEN 'unknown' ELSE title || ' by ' || coalesce(artist, '') END")
_add("p10_ifdef", "%ifdef{album}-%ifdef{year,y$year,none}", "coalesce(album, '') || '-' || coalesce('y' || CAST(year AS VARCHAR), 'none')")
_add("p11_asciify", "%asciify{Ærø $title}", "'AEro ' || coalesce(title, '')")
_add("p12_time", "%time{$year,%%d.%%m.%%Y}", "CASE WHEN year IS NULL THEN '' ELSE '01.01.' || CAST(year AS VARCHAR) END")
_add("p13_first", "%first{$genre}", "genre[1]")
_add("p14_the", "%the{The $title}|%the{a $title,strip}|%the{$title}", "coalesce(title, '') || ', The|' || coalesce(title, '') || '|' || coalesce(title, '')")
_add("p15_pad", "%pad{$track,3}%pad{-$track,4}", "lpad(CAST(track_no AS VARCHAR), 3, '0') || '-' || lpad(CAST(track_no AS VARCHAR), 3, '0')")
_add("p16_default", "%default{$album,Singles}", "coalesce(album, 'Singles')")
_add("p17_sanitize", "%sanitize{$title: x?. }", "coalesce(title, '') || '_ x_'")
Q.add("p18_joined", _value("$genre"), T + "SELECT id, array_to_string(genre, ', ') AS value, CAST(NULL AS VARCHAR) AS problem FROM tracks")
_PATH = "%default{$albumartist,Unknown}/%default{$album,Singles}/%pad{$track,2} $title"
_RENDERED = "CASE WHEN album_artist = ' ' THEN ' /' ELSE coalesce(replace(album_artist, ' ', ''), 'Unknown') || '/' END || coalesce(album, 'Singles') || '/' || lpad(CAST(track_no AS VARCHAR), 2, '0') || ' ' || coalesce(title, '')"
Q.add("p19_render", lambda s, d: P.render(tracks(s, d), _PATH).select("id", "rendered", "problem"), T + f"SELECT id, CASE WHEN album_artist = ' ' THEN {_RENDERED} ELSE rtrim({_RENDERED}, '. ') END AS rendered, CASE WHEN album_artist = ' ' THEN 'an empty component' END AS problem FROM tracks")
Q.add("p20_collisions", lambda s, d: P.collisions(tracks(s, d).select("id", F.lower("title").alias("rendered"), (F.col("id") % 10 == 0).alias("in_batch"))).select("path_key", F.array_join("ids", ",").alias("ids")), T + "SELECT lower(title) AS path_key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM tracks WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND bool_or(id % 10 = 0)")
Q.add("p21_template_choice", lambda s, d: tracks(s, d).select("id", P.choose_template([(F.col("format") == "FLAC", "lossless"), (F.col("year") < 1990, "old")], F.col("album").isNull(), "singleton", "album").alias("template")), T + "SELECT id, CASE WHEN format = 'FLAC' THEN 'lossless' WHEN year < 1990 THEN 'old' WHEN album IS NULL THEN 'singleton' ELSE 'album' END AS template FROM tracks")
Q.add("p22_rename_preview", lambda s, d: P.rename_preview(tracks(s, d).filter("title is not null"), tracks(s, d), "$title", "lib").select("id", "current", "rendered", "collides"), T + ", b AS (SELECT id, substr(path, 5) AS current, title || CASE WHEN id % 2 = 0 THEN '.mp3' ELSE '.flac' END AS rendered FROM tracks WHERE title IS NOT NULL) SELECT *, count(*) OVER (PARTITION BY rendered) > 1 AS collides FROM b")
