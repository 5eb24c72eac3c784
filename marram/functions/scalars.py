"""Scalar functions as column expressions: identifiers, numbers, dates, distances, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def numeric_distance(a: Column, b: Column, scale: float) -> Column:
    """|a - b| / scale, 1 at most; 1 if either is null; equality if the scale is not positive."""
    if scale <= 0:
        return F.when(a == b, 0.0).otherwise(1.0)
    return F.when(a.isNull() | b.isNull(), 1.0).otherwise(F.least(F.abs(a.cast("double") - b.cast("double")) / scale, F.lit(1.0)))


def exact_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).otherwise(1.0)


def weighted_distance(fields: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the distances that are not null, by weight; 1 if there is none."""
    used = [(d, weights.get(n, 0.0)) for n, d in fields.items() if weights.get(n, 0.0) > 0]
    total = reduce(Column.__add__, [F.when(d.isNotNull(), w).otherwise(0.0) for d, w in used])
    return F.when(total > 0, reduce(Column.__add__, [F.coalesce(d * w, F.lit(0.0)) for d, w in used]) / total).otherwise(1.0)


def signals(fields: dict[str, Column], weights: dict[str, float]) -> Column:
    """Array of (field, distance, weight, contribution) of the fields that are not null."""
    used = [(n, d, weights.get(n, 0.0)) for n, d in fields.items() if weights.get(n, 0.0) > 0]
    total = reduce(Column.__add__, [F.when(d.isNotNull(), w).otherwise(0.0) for _, d, w in used])
    rows = [F.when(d.isNotNull(), F.struct(F.lit(n).alias("field"), d.alias("distance"), F.lit(w).alias("weight"), (d * w / total).alias("contribution"))) for n, d, w in used]
    return F.array_compact(F.array(*rows))


def file_name_parts(name: Column) -> Column:
    """struct(artist, title, confidence) read from ``01 - Artist - Title.ext``."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    stem = stripped(F.regexp_replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), r"^\s*(?:\d{1,3}[ ._-]+)?", ""))
    parts = F.split(stem, r"\s+-\s+", 2)
    two = (F.size(parts) == 2) & (stripped(parts[0]) != "") & (stripped(F.get(parts, F.lit(1))) != "")
    return F.struct(
        F.when(two, stripped(parts[0])).alias("artist"),
        F.when(two, stripped(F.get(parts, F.lit(1)))).when(stem != "", stem).alias("title"),
        F.when(two, 0.95).when(stem != "", 0.45).otherwise(0.0).alias("confidence"),
    )


def release_id(c: Column) -> Column:
    """A lower-case UUID, or null."""
    v = F.lower(stripped(c))
    return F.when(v.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), v)


def recording_code(c: Column) -> Column:
    v = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    return F.when(v.rlike(r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), v)


def barcode(c: Column) -> Column:
    v = F.regexp_replace(c, r"[\s-]", "")
    return F.when(v.rlike(r"^[0-9]{8,14}$"), v)


def of_total(c: Column) -> Column:
    """struct(number, total) of ``3/12``; what is no number is null."""
    part = lambda k: F.try_to_number(F.regexp_extract(F.get(F.split(c, "/"), F.lit(k)), r"^\s*([0-9]{1,9})\s*$", 1), F.lit("999999999")).cast("int")
    return F.struct(part(0).alias("number"), part(1).alias("total"))


def lenient_int(c: Column) -> Column:
    return stripped(c).try_cast("int")


def lenient_float(c: Column) -> Column:
    """The number before a unit, as in ``-6.5 dB``."""
    return F.regexp_extract(stripped(c), r"^([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def year_of(c: Column) -> Column:
    """The year that a date text begins with."""
    return F.regexp_extract(c, r"^([0-9]{4})(?:\D|$)", 1).try_cast("int")


def clock_ms(c: Column) -> Column:
    """Milliseconds of ``SS``, ``MM:SS`` or ``HH:MM:SS``; null for anything else."""
    total = F.aggregate(F.split(c, ":"), F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.try_cast("long"))
    return F.when(c.rlike(r"^[0-9]+(:[0-9]{1,2}){0,2}$"), total * 1000)


def candidate_url(c: Column) -> Column:
    """struct(provider, type, id) of an allow-listed https address; null for every other."""
    clean = c.rlike(r"^https://[^/@:?#\x00-\x20\x7f]+/[^?#\\\x00-\x20\x7f]*$") & ~F.lower(c).rlike("%2f|%5c") & (F.length(c) <= 2048)
    host = F.lower(F.regexp_extract(c, r"^https://([^/]+)", 1))
    path = F.regexp_extract(c, r"^https://[^/]+(/.*)$", 1)
    out = F.lit(None).cast("struct<provider:string,type:string,id:string>")
    for provider, hosts, pattern, kind in URL_FORMS:
        found = F.regexp_extract(path, pattern, 1)
        out = F.when(clean & host.isin(*hosts) & path.rlike(pattern), F.struct(F.lit(provider).alias("provider"), F.lit(kind).alias("type"), F.lower(found).alias("id"))).otherwise(out)
    return out


#: Provider, hosts, path, kind.
URL_FORMS = [
    ("musicbrainz", ("musicbrainz.org", "www.musicbrainz.org"), r"^/release/([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})/?$", "release"),
    ("discogs", ("discogs.com", "www.discogs.com"), r"^/(?:[a-z]{2}/)?release/([1-9][0-9]*)(?:-[^/]*)?/?$", "release"),
    ("deezer", ("deezer.com", "www.deezer.com"), r"^/(?:[a-z]{2}/)?album/([1-9][0-9]*)/?$", "album"),
    ("deezer", ("deezer.com", "www.deezer.com"), r"^/(?:[a-z]{2}/)?track/([1-9][0-9]*)/?$", "track"),
]


#: White space of any script, separators included.
WHITE = r"[\s\u001c-\u001f\u0085\p{Z}]"


def stripped(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def identity(c: Column) -> Column:
    return F.lower(stripped(F.regexp_replace(c, f"{WHITE}+", " ")))


#: Labels of audio extensions.
FORMATS = {"mp3": "MP3", "flac": "FLAC", "ogg": "OGG", "opus": "Opus", "m4a": "MP4", "wav": "WAV", "aiff": "AIFF", "aif": "AIFF"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?<=[^/])\.([^./]+)$", 1))


def format_label(path: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))]), extension(path))


def confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def confidence_label(score: Column) -> Column:
    return F.when(score.isNull(), "manual").when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def review_label(has_candidate: Column, score: Column, state: Column) -> Column:
    """The inbox's label of a review: by its score, else by its candidate, else by its state."""
    by_score = F.when(score >= 0.85, "High confidence").when(score >= 0.65, "Medium confidence").when(score.isNotNull(), "Low confidence")
    by_state = F.when(state == "needs_attention", "Needs attention").when(state == "preparing", "Preparing").otherwise("Not scored")
    return F.coalesce(by_score, F.when(has_candidate, "Manual selection"), by_state)


#: Activity states of imports, applies and undos; other states stand for themselves.
ACTIVITY = {
    "import": {"scanning": "running", "fingerprinting": "running", "grouping": "running", "matching": "running", "reviewing": "succeeded", "completed": "succeeded"},
    "apply": {"applying": "running", "applied": "succeeded", "partially_applied": "failed"},
    "undo": {"undoing": "running", "undone": "succeeded", "partially_undone": "failed"},
}


def activity_state(kind: str, c: Column) -> Column:
    """What a state of an import, an apply or an undo is in the feed."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ACTIVITY[kind].items() for x in pair]), c), c)


def _in_order(c: Column, kind: DataType) -> Column:
    """A value whose maps, at any depth, have their entries in order of their keys."""
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _in_order(e["value"], kind.valueType).alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    if isinstance(kind, ArrayType) and "map<" in kind.simpleString():
        return F.transform(c, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, StructType) and "map<" in kind.simpleString():
        return F.when(c.isNotNull(), F.struct(*[_in_order(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def digest(df: DataFrame, *columns: str) -> Column:
    """An opaque key of a row's content; the entries of maps count in order of their keys, at any depth."""
    cells = [_in_order(F.col(c), df.schema[c].dataType).alias(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)


def has_synced_lines(lyrics: Column) -> Column:
    """Does every line that is not blank begin with a time stamp, and is there one?"""
    lines = F.filter(F.split(lyrics, "\n"), lambda x: stripped(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"^\s*\[[0-9]+:[0-9]{2}(\.[0-9]{1,3})?\]"))


def valid_value(kind: Column, value: Column, editable: Column | None = None) -> Column:
    """Does a text hold a value of the field's type?  A field that may not be edited takes none."""
    may = F.lit(True) if editable is None else editable
    return may & (
        F.when(kind == "int", value.rlike(r"^[+-]?[0-9]+$"))
        .when(kind == "float", value.try_cast("double").isNotNull() & ~F.lower(value).isin("nan", "inf", "-inf", "infinity"))
        .when(kind == "bool", value.isin("true", "false"))
        .when(kind == "date", value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(value).isNotNull())
        .when(kind == "text", value.isNotNull())
        .when(kind == "multi_text", F.coalesce(F.schema_of_variant(F.try_parse_json(value)).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) & ~F.contains(value, F.lit("null")))
        .otherwise(False)
    )


def retry_delay(attempt: Column, jitter: Column, retry_after: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Seconds to wait: capped exponential times a jitter in [0, 1], and what the server asked for at least."""
    return F.greatest(F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap)) * jitter, F.coalesce(retry_after, F.lit(0.0)))


def search_terms(fields: dict[str, str | Column]) -> Column:
    """``name:"value" AND ...`` of the fields that are not blank, quotes and backslashes escaped."""
    part = lambda n, c: F.when(stripped(c) != "", F.concat(F.lit(n + ':"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat_ws(" AND ", *[part(n, F.col(c) if isinstance(c, str) else c) for n, c in fields.items()])


def plain_terms(*choices: tuple[str, ...]) -> Column:
    """Of each choice of columns the first that is not empty, joined by spaces."""
    return F.concat_ws(" ", *[F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in choice]) for choice in choices])


def tagged_terms(fields: dict[str, tuple[str, ...]]) -> Column:
    """``name:"value"`` of the first column of each choice that is not empty, joined by spaces; nothing is escaped."""
    part = lambda n, choice: F.concat(F.lit(n + ':"'), F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in choice]), F.lit('"'))
    return F.concat_ws(" ", *[part(n, choice) for n, choice in fields.items()])


def track_searches(title: str = "title", artist: str = "artist", isrc: str = "isrc") -> Column:
    """Searches for a single track, each looser than the one before; none without title and code."""
    strict = tagged_terms({"isrc": (isrc,), "track": (title,), "artist": (artist,)})
    both = F.when((F.col(title) != "") & (F.col(artist) != ""), tagged_terms({"track": (title,), "artist": (artist,)}))
    only = F.when(F.col(title) != "", tagged_terms({"track": (title,)}))
    asked = F.coalesce(F.col(title) != "", F.lit(False)) | F.coalesce(F.col(isrc) != "", F.lit(False))
    return F.when(asked, F.array_distinct(F.array_compact(F.array(strict, both, only)))).otherwise(F.array().cast("array<string>"))
