"""Catalogue queries: filters, phrase search, sorted keyset pages and facets.

Predicates are built as columns, so they reach the scan; a page is one top-k over the
filtered rows, and each facet is one grouping that ignores its own filter.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Page sizes and facet sizes are held between 1 and this.
MAX_LIMIT = 500

FLAGS = {
    "missing": lambda: F.col("is_missing"),
    "missing-art": lambda: ~F.col("has_art"),
    "unmatched": lambda: F.col("album").isNull(),
    "errored": lambda: F.col("probe_error").isNotNull(),
}
SORTS = {"title": "title", "artist": "artist", "album": "album", "added": "added"}
SEARCHED = ("title", "artist", "album", "album_artist")


@dataclass(frozen=True)
class CatalogQuery:
    """Parameters of a catalogue request; an empty string is no filter."""

    q: str = ""
    artist: str = ""
    album: str = ""
    format: str = ""
    genre: str = ""
    flags: tuple[str, ...] = ()
    sort: str = "title"
    order: str = "asc"
    cursor: tuple | None = None
    limit: int = 100


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters of one mark, and the letters without it."""
    parts = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x590), *range(0x1E00, 0x2000)))
    pairs = [(ch, d[0]) for ch, d in parts if ch == ch.lower() and len(d) == 2 and unicodedata.combining(d[1])]
    return "".join(ch for ch, _ in pairs), "".join(d for _, d in pairs)


MARKED, UNMARKED = _plain_letters()


def tokens(c: Column) -> Column:
    """The lower-cased words of a text without marks, joined by and between single spaces."""
    # Texts of a byte a letter have no marks, and taking them off costs more than the rest.
    plain = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.regexp_replace(F.translate(F.lower(c), MARKED, UNMARKED), r"[\u0300-\u036F]", ""))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def wanted_words(text: str) -> list[str] | None:
    """The words of a search: lower case, without marks, every other character parts them; None for a blank text."""
    if not text.strip():
        return None
    plain = text.lower().translate(str.maketrans(MARKED, UNMARKED))
    return "".join(ch if ch.isalnum() else " " for ch in plain if not "\u0300" <= ch <= "\u036f").split()


def phrase(text: str, columns: tuple[str, ...] = SEARCHED) -> Column | None:
    """Do the words of ``text`` stand together in one of the columns?  None for a blank text.

    Every character is literal: quotes, hyphens and operators only part words.  Neither case
    nor the mark of a letter counts.
    """
    wanted = wanted_words(text)
    if wanted is None:
        return None
    if not wanted:
        return F.lit(False)
    needle = F.lit(" " + " ".join(wanted) + " ")
    return reduce(Column.__or__, [F.coalesce(F.contains(tokens(F.col(c)), needle), F.lit(False)) for c in columns])


def where(query: CatalogQuery) -> Column:
    """The conjunction of a query's filters; unknown flags are ignored."""
    parts = [] if "missing" in query.flags else [~F.col("is_missing")]
    parts += [F.col(c) == v for c, v in (("artist", query.artist), ("album", query.album), ("format", query.format)) if v]
    if query.genre:
        parts.append(F.array_contains("genre", query.genre))
    parts += [FLAGS[f]() for f in query.flags if f in FLAGS]
    if (found := phrase(query.q)) is not None:
        parts.append(found)
    return reduce(Column.__and__, parts, F.lit(True))


def after(column: str, key: str, cursor: tuple | None, descending: bool) -> Column:
    """Rows behind a cursor (value, key) where nulls come first ascending and last descending."""
    if cursor is None:
        return F.lit(True)
    value, last = cursor
    c, k = F.col(column), F.col(key)
    if descending:
        if value is None:
            return c.isNull() & (k < last)
        return c.isNull() | (c < F.lit(value)) | ((c == F.lit(value)) & (k < last))
    if value is None:
        return c.isNotNull() | (k > last)
    return (c > F.lit(value)) | ((c == F.lit(value)) & (k > last))


def page(df: DataFrame, column: str, key: str, cursor: tuple | None = None, descending: bool = False, limit: int = 100) -> DataFrame:
    """One page and the row behind it, which tells whether there is a next page."""
    order = [F.col(column).desc_nulls_last(), F.col(key).desc()] if descending else [F.col(column).asc_nulls_first(), F.col(key).asc()]
    return df.filter(after(column, key, cursor, descending)).orderBy(*order).limit(max(1, min(limit, MAX_LIMIT)) + 1)


def list_tracks(tracks: DataFrame, query: CatalogQuery) -> DataFrame:
    column = SORTS.get(query.sort, "title")
    return page(tracks.filter(where(query)), column, "id", query.cursor, query.order == "desc", query.limit)


def count_tracks(tracks: DataFrame, query: CatalogQuery) -> DataFrame:
    return tracks.filter(where(query)).agg(F.count("*").alias("total"))


def encode_cursor(value, key) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, key]).encode()).decode().rstrip("=")


def decode_cursor(text: str | None) -> tuple | None:
    """The cursor's pair; None (the start) for an absent or invalid one."""
    try:
        value, key = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return value, key
    except (TypeError, ValueError):
        return None


def _narrowed(counts: DataFrame, needle: str, cursor: str | None, limit: int) -> DataFrame:
    if needle:
        counts = counts.filter(F.contains(F.lower("value"), F.lit(needle.lower())))
    if cursor is not None:
        counts = counts.filter(F.col("value") > cursor)
    return counts.orderBy("value").limit(max(1, min(limit, MAX_LIMIT)))


def facet(tracks: DataFrame, column: str, query: CatalogQuery, needle: str = "", cursor: str | None = None, limit: int = 100) -> DataFrame:
    """(value, n) of a column under every filter but its own; elements are counted for arrays."""
    rows = tracks.filter(where(replace(query, **{column: ""})))
    kind = dict(tracks.dtypes)[column]
    values = rows.select(F.explode(column).alias("value")) if kind.startswith("array") else rows.select(F.col(column).alias("value"))
    return _narrowed(values.filter("value is not null").groupBy("value").agg(F.count("*").alias("n")), needle, cursor, limit)


def facets(tracks: DataFrame, query: CatalogQuery, needle: str = "", cursor: str | None = None, limit: int = 100) -> DataFrame:
    """All four facets, tagged; one cursor value holds for each of them.

    One pass: every row gives its values to the facets whose other filters it passes.
    """
    kinds = dict(tracks.dtypes)

    def given(c: str) -> Column:
        values = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
        tagged = F.transform(values, lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))
        return F.coalesce(F.when(where(replace(query, **{c: ""})), tagged), F.array().cast("array<struct<facet:string,value:string>>"))

    counts = tracks.select(F.explode(F.flatten(F.array(*map(given, ("artist", "album", "format", "genre"))))).alias("f")).select("f.*").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    if needle:
        counts = counts.filter(F.contains(F.lower("value"), F.lit(needle.lower())))
    if cursor is not None:
        counts = counts.filter(F.col("value") > cursor)
    place = F.row_number().over(Window.partitionBy("facet").orderBy("value"))
    return counts.withColumn("_r", place).filter(F.col("_r") <= max(1, min(limit, MAX_LIMIT))).drop("_r")


def encode_facet_cursor(value: str) -> str:
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def decode_facet_cursor(text: str | None) -> str | None:
    """The value behind which a facet goes on; None (the start) for an absent or invalid cursor."""
    try:
        return str(json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))))
    except (TypeError, ValueError):
        return None


#: The last page and the largest page of a search by hand.
LAST_PAGE, MOST_RESULTS = 9, 20


@dataclass(frozen=True)
class ManualSearch:
    """What a user looks for by hand; :meth:`checked` puts it in order or refuses it."""

    title: str | None = None
    artist: str | None = None
    album: str | None = None
    isrc: str | None = None
    year: int | None = None
    duration_ms: int | None = None
    providers: tuple[str, ...] = ()
    page: int = 0
    page_size: int = 10

    def checked(self) -> ManualSearch:
        """Single spaces, blanks as None, providers in lower case and once each."""
        texts = {n: " ".join((getattr(self, n) or "").split()) or None for n in ("title", "artist", "album", "isrc")}
        providers = tuple(dict.fromkeys(p.strip().lower() for p in self.providers if p.strip()))
        wrong = [
            ("one of title, artist, album or isrc is needed", not any(texts.values())),
            ("year must have four digits", self.year is not None and not 1000 <= self.year <= 9999),
            ("duration_ms must be positive", self.duration_ms is not None and self.duration_ms <= 0),
            (f"page must be from 0 to {LAST_PAGE}", not 0 <= self.page <= LAST_PAGE),
            (f"page_size must be from 1 to {MOST_RESULTS}", not 1 <= self.page_size <= MOST_RESULTS),
        ]
        for message, is_so in wrong:
            if is_so:
                raise ValueError(message)
        return replace(self, providers=providers, **texts)


def parse_query(text: str) -> list[tuple[str, str]]:
    """(field, value) of every clause of ``field:value,field:value``; a clause without ``:`` is an error."""
    out = []
    for clause in text.split(","):
        if clause.strip():
            name, colon, value = clause.partition(":")
            if not colon or not name.strip():
                raise ValueError(f"not a field:value clause: {clause!r}")
            out.append((name.strip(), value.strip()))
    return out


def matches(text: str, columns: list[str]) -> Column:
    """All clauses hold: the value stands in the field, whatever the case; an absent field is empty."""
    parts = [F.contains(F.lower(F.coalesce(F.col(n).cast("string") if n in columns else F.lit(""), F.lit(""))), F.lit(v.lower())) for n, v in parse_query(text)]
    return reduce(Column.__and__, parts, F.lit(True))


def in_scope(path: Column, root: str) -> Column:
    """Is the path the root itself or below it?"""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


SUMMARY = ("id", "title", "artist", "album", "album_artist", "genre", "format", "duration_ms", "year", "track_no", "track_total", "label", "path", "group_id", "has_art", "has_lyrics", "probe_error", "is_missing", "added")


def summary(tracks: DataFrame) -> DataFrame:
    return tracks.select(*SUMMARY)


def detail(tracks: DataFrame, groups: DataFrame, below: float = 0.8) -> DataFrame:
    """Tracks with their work unit, and whether its grouping waits for a decision."""
    g = groups.select(F.col("id").alias("group_id"), "kind", "is_pinned", "confidence")
    open_ = F.coalesce(~F.col("is_pinned") & (F.col("confidence") < below), F.lit(False))
    return tracks.join(g, "group_id", "left").withColumn("grouping_needs_resolution", open_)


def needing_gain(tracks: DataFrame) -> DataFrame:
    """Work units that hold a live track without gain."""
    return tracks.filter(~F.col("is_missing") & F.col("rg_track_gain").isNull() & F.col("group_id").isNotNull()).select("group_id").distinct()


def needing_art(groups: DataFrame, tracks: DataFrame, prefer_existing: bool = True) -> DataFrame:
    """Work units with a release but no picture.

    With ``prefer_existing`` those whose live tracks all have art are left out; a unit
    without live tracks counts as such.
    """
    wanted = groups.filter("mb_release_id is not null")
    if not prefer_existing:
        return wanted.select("id")
    bare = tracks.filter("not is_missing and not has_art").select(F.col("group_id").alias("id")).distinct()
    return wanted.join(bare, "id", "left_semi").select("id")


def needing_lyrics(tracks: DataFrame) -> DataFrame:
    return tracks.filter("not is_missing and not has_lyrics and title is not null and artist is not null")


def needing_fingerprint(tracks: DataFrame, root: str) -> DataFrame:
    return tracks.filter(~F.col("is_missing") & F.col("fingerprint").isNull() & in_scope(F.col("path"), root))


def units_to_match(groups: DataFrame, tracks: DataFrame, root: str) -> DataFrame:
    """Unmatched work units whose members, at least one, all lie in scope."""
    members = tracks.groupBy(F.col("group_id").alias("id")).agg(F.bool_and(in_scope(F.col("path"), root)).alias("inside")).filter("inside")
    return groups.filter("match_state = 'unmatched'").join(members, "id", "left_semi").select("id")


def unknown_ids(wanted: DataFrame, tracks: DataFrame, key: str = "id") -> DataFrame:
    """Those of the wanted ids that name no track."""
    return wanted.join(tracks.select(key), key, "left_anti")


def effective(stored: DataFrame, env: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """(name, value, origin) of every setting: environment over stored over default."""
    spark = stored.sparkSession
    known = spark.createDataFrame([(k, env.get(k), v) for k, v in defaults.items()], "name string, env string, fallback string")
    origin = F.when(F.col("env").isNotNull(), "env").when(F.col("value").isNotNull(), "stored").otherwise("default")
    return known.join(stored.select("name", "value"), "name", "left").select("name", F.coalesce("env", "value", "fallback").alias("value"), origin.alias("origin"))
