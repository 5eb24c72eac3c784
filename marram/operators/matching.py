"""Matching of local releases and single tracks with candidates of several sources.

Rows are (case, candidate) pairs: only the alignment of track lists is Python, a batch at a
time (:mod:`.alignment`); distances, weights, duplicates, ranking and decisions are columns and
windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.scalars import exact_distance, file_name_parts, numeric_distance, signals, weighted_distance
from marram.functions.text import name_distance_column, name_distances_column

from .alignment import LENGTH_SCALE, TRACK_WEIGHTS, aligned, assign

__all__ = ["aligned", "assign", "corroborators", "decide", "duplicates", "local_names", "page_of", "rank", "score_albums", "score_singles", "top_candidates", "track_distance_columns"]

#: Weights of the signals.
ALBUM_WEIGHTS = {"album": 3.0, "album_artist": 3.0, "tracks": 2.0, "missing_tracks": 0.9, "unmatched_tracks": 0.6, "year": 0.5, "media": 0.5, "country": 0.5, "label": 0.5, "catalog_number": 0.5, "barcode": 2.0}
SINGLE_WEIGHTS = {"title": 3.0, "artist": 3.0, "length": 2.5, "isrc": 4.0, "acoustid": 5.0}
#: Bands, gaps and costs.
STRONG, SINGLE_STRONG, REJECT, RELATED = 0.10, 0.06, 0.45, 0.45
MIN_GAP, YEAR_BAND, BONUS, PENALTY, EPSILON = 0.03, 0.02, 0.05, 0.02, 1e-9
YEAR_SCALE = 5.0

TRACK = "struct<title:string,artist:string,duration_ms:bigint,isrc:string,track_id:string>"


def _text(a: str, b: str) -> Column:
    return F.when((F.col(a) != "") & (F.col(b) != ""), name_distance_column(a, b))


def _same(a: str, b: str) -> Column:
    return F.when((F.col(a) != "") & (F.col(b) != ""), exact_distance(F.col(a), F.col(b)))


def _number(a: str, b: str, scale: float) -> Column:
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), numeric_distance(F.col(a), F.col(b), scale))


def score_albums(pairs: DataFrame) -> DataFrame:
    """``pairs`` (local_* and candidate columns, track lists) with distance, signals and related."""
    rows = aligned(pairs)
    matched = F.filter("alignment", lambda x: x["local"].isNotNull() & x["candidate"].isNotNull())
    rows = rows.withColumn("_m", matched).withColumn("_n", F.size("_m"))
    mean = F.when(F.col("_n") > 0, F.aggregate("_m", F.lit(0.0), lambda s, x: s + x["cost"]) / F.col("_n")).otherwise(1.0)
    share = lambda c: F.least(F.greatest(F.size(c) - F.col("_n"), F.lit(0)) / F.greatest(F.size(c), F.lit(1)), F.lit(1.0))
    parts = {
        "tracks": mean,
        "missing_tracks": share("tracks"),
        "unmatched_tracks": share("local_tracks"),
        "album": _text("local_album", "album"),
        "album_artist": _text("local_album_artist", "album_artist"),
        "year": _number("local_year", "year", YEAR_SCALE),
        "media": _same("local_media", "media"),
        "country": _same("local_country", "country"),
        "label": _text("local_label", "label"),
        "catalog_number": _same("local_catalog_number", "catalog_number"),
        "barcode": _same("local_barcode", "barcode"),
    }
    rows = rows.withColumns({f"_d_{n}": c for n, c in parts.items()})
    made = {n: F.col(f"_d_{n}") for n in parts}
    related = F.coalesce(F.col("_d_album") < RELATED, F.lit(False)) | F.exists("_m", lambda x: x["cost"] < RELATED)
    return rows.withColumn("distance", weighted_distance(made, ALBUM_WEIGHTS)).withColumn("signals", signals(made, ALBUM_WEIGHTS)).withColumn("related", related).drop(*[f"_d_{n}" for n in parts], "_m", "_n")


def track_distance_columns() -> Column:
    """Distance of the track columns local_* and t_* as a column; the position always counts as right."""
    return weighted_distance(
        {"index": F.lit(0.0), "title": _text("local_title", "t_title"), "artist": _text("local_artist", "t_artist"), "length": _number("local_duration_ms", "t_duration_ms", LENGTH_SCALE), "isrc": _same("local_isrc", "t_isrc")},
        TRACK_WEIGHTS,
    )


def score_singles(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Score by each candidate's track that is nearest to the local one (ties: the first).

    ``keys`` name a row of ``pairs``.  The nearest track is found within the row, so no track
    makes a row of its own and nothing is shuffled.
    """
    wanted = lambda own, name: F.transform("tracks", lambda t: (F.col(own) != "") & (t[name] != ""))
    names = {f"_n_{n}": name_distances_column(f"local_{n}", F.col("tracks")[n], wanted(f"local_{n}", n)) for n in ("title", "artist")}

    def near(t: Column, k: Column) -> Column:
        given = lambda own, x: F.col(own).isNotNull() & x.isNotNull()
        parts = {
            "index": F.lit(0.0),
            "title": F.get("_n_title", k),
            "artist": F.get("_n_artist", k),
            "length": F.when(given("local_duration_ms", t["duration_ms"]), numeric_distance(F.col("local_duration_ms"), t["duration_ms"], LENGTH_SCALE)),
            "isrc": F.when((F.col("local_isrc") != "") & (t["isrc"] != ""), exact_distance(F.col("local_isrc"), t["isrc"])),
        }
        return F.struct(weighted_distance(parts, TRACK_WEIGHTS).alias("near"), k.alias("at"))

    best = pairs.withColumns(names).withColumn("_at", F.array_min(F.transform("tracks", near))["at"])
    best = best.withColumn("_t", F.get("tracks", F.col("_at")))
    cells = {f"t_{f}": F.col(f"_t.{f}") for f in ("title", "artist", "duration_ms", "isrc")}
    best = best.withColumns(cells).withColumn("_title", F.when(F.col("_t").isNotNull(), F.col("t_title")).otherwise(F.col("album"))).withColumn("_artist", F.when(F.col("t_artist") != "", F.col("t_artist")).otherwise(F.col("album_artist")))
    parts = {"title": _text("local_title", "_title"), "artist": _text("local_artist", "_artist"), "length": _number("local_duration_ms", "t_duration_ms", LENGTH_SCALE), "isrc": _same("local_isrc", "t_isrc"), "acoustid": _same("local_acoustid", "acoustid")}
    best = best.withColumns({f"_d_{n}": c for n, c in parts.items()})
    made = {n: F.col(f"_d_{n}") for n in parts}
    related = F.coalesce(F.col("_d_isrc") == 0, F.lit(False)) | F.coalesce(F.col("_d_acoustid") == 0, F.lit(False)) | F.coalesce(F.col("_d_title") < RELATED, F.lit(False))
    return best.withColumn("distance", weighted_distance(made, SINGLE_WEIGHTS)).withColumn("signals", signals(made, SINGLE_WEIGHTS)).withColumn("related", related).drop(*[f"_d_{n}" for n in parts], *cells, *names, "_t", "_at", "_title", "_artist")


def _with_same(scored: DataFrame, case: str, id_: str) -> DataFrame:
    """``scored`` with ``_same``: (id, source) of the candidates of other sources that hold the same release.

    Candidates of one case are a provider's few answers; each row meets those of its case.  The
    number of tracks is ``n_tracks`` where there is such a column, else the size of ``tracks``.
    """
    n = F.col("n_tracks") if "n_tracks" in scored.columns else F.size("tracks")
    other = F.struct(F.col(id_).alias("id"), "source", "album", "barcode", "release_id", "year", n.alias("n"))
    rows = scored.withColumn("_all", F.collect_list(other).over(Window.partitionBy(case)))
    equal = lambda x, c: F.coalesce((F.col(c) != "") & (F.col(c) == x[c]), F.lit(False))
    known = lambda x: equal(x, "barcode") | equal(x, "release_id")
    years = lambda x: F.coalesce(F.abs(F.col("year") - x["year"]) <= 1, F.lit(True))
    alike = F.transform("_all", lambda x: (F.col("source") != x["source"]) & ~known(x) & (n == x["n"]) & (n > 0) & years(x))
    rows = rows.withColumn("_near", name_distances_column("album", F.col("_all")["album"], alike))
    same = F.filter("_all", lambda x, k: (F.col("source") != x["source"]) & (known(x) | F.coalesce(F.get("_near", k) < 0.10, F.lit(False))))
    return rows.withColumn("_same", F.transform(same, lambda x: F.struct(x["id"], x["source"]))).drop("_all", "_near")


def duplicates(scored: DataFrame, case: str, id_: str = "ref_id") -> DataFrame:
    """(case, ref_id, o_ref_id, o_source): candidates of other sources that hold the same release, both ways round."""
    return _with_same(scored, case, id_).select(case, id_, F.explode("_same").alias("_o")).select(case, id_, F.col("_o.id").alias(f"o_{id_}"), F.col("_o.source").alias("o_source"))


def _sources() -> Column:
    return F.array_sort(F.array_distinct(F.col("_same")["source"]))


def corroborators(scored: DataFrame, case: str, id_: str = "ref_id") -> DataFrame:
    """(case, ref_id, corroborated_by): other sources that hold the same release."""
    return _with_same(scored, case, id_).filter(F.size("_same") > 0).select(case, id_, _sources().alias("corroborated_by"))


def rank(scored: DataFrame, case: str, priority: tuple[str, ...] = ("musicbrainz", "discogs", "deezer"), min_gap: float = MIN_GAP, earliest: bool = False, id_: str = "ref_id", position: str = "position", adjacency: bool = False) -> DataFrame:
    """``scored`` with adjusted distance, rejection and rank in its case.

    Corroboration lowers the distance; the order of sources counts only among candidates
    within ``min_gap`` of the best, which come first.  ``scored``, with the costly alignment in
    it, is read once: all steps are windows over the case.

    With ``adjacency`` there is also ``is_duplicate_of``: the places (from 0, in the final
    order) of the candidates of other sources that hold the same release, in order.
    """
    rows = _with_same(scored, case, id_).withColumn("corroborated_by", _sources())
    rows = rows.withColumn("adjusted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("distance") - BONUS * F.size("corroborated_by"))))
    best = F.min("adjusted").over(Window.partitionBy(case))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("source")) - 1
    rows = rows.withColumn("_best", best).withColumn("_in", F.col("adjusted") - F.col("_best") <= min_gap + EPSILON)
    order = F.when(F.col("_in"), F.least(F.lit(1.0), F.col("adjusted") + F.when(place > 0, place * PENALTY).otherwise(0.0))).otherwise(F.col("adjusted"))
    released = F.col("year")
    if "original_year" in rows.columns:
        released = F.coalesce(F.nullif(F.col("original_year"), F.lit(0)), released)
    year = F.when(F.col("adjusted") <= F.col("_best") + YEAR_BAND, released)
    keys = [F.desc("_in"), order.asc()] + ([F.coalesce(year, F.lit(9999)).asc()] if earliest else []) + [F.asc(position)]
    reason = F.when(~F.col("related"), "insufficient identity signals").when(F.col("adjusted") >= REJECT, "candidate is not sufficiently related")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(*keys))).withColumn("rejection", reason).drop("_best", "_in")
    if not adjacency:
        return ranked.drop("_same")
    placed = F.struct(F.struct(F.col(id_).alias("id"), "source").alias("of"), (F.col("rank") - 1).alias("place"))
    ranked = ranked.withColumn("_places", F.collect_list(placed).over(Window.partitionBy(case)))
    beside = F.filter("_places", lambda x: F.array_contains("_same", x["of"]))
    return ranked.withColumn("is_duplicate_of", F.array_sort(F.transform(beside, lambda x: x["place"]))).drop("_same", "_places")


def page_of(ranked: DataFrame, case: str, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) of each case's ranked rows; places in ``is_duplicate_of`` count from the page's first row, others go.

    ``more`` tells whether the case has rows behind the page.
    """
    start = page * size
    last = F.max("rank").over(Window.partitionBy(case))
    inside = lambda x: (x >= start) & (x < start + size)
    rows = ranked.withColumn("more", last > start + size).filter((F.col("rank") > start) & (F.col("rank") <= start + size))
    return rows.withColumn("is_duplicate_of", F.transform(F.filter("is_duplicate_of", inside), lambda x: x - start))




def decide(ranked: DataFrame, case: str, strong: float = STRONG, min_gap: float = MIN_GAP) -> DataFrame:
    """(case, winner, adjusted, band): of each case's first candidate that is not rejected.

    A would-be strong one is ambiguous if the next is within the gap.
    """
    w = Window.partitionBy(case).orderBy(F.col("rejection").isNotNull(), "rank")
    rows = ranked.select(case, "source", "ref_id", "adjusted", "rejection", F.row_number().over(w).alias("r"), F.lead("adjusted").over(w).alias("next"), F.lead("rejection").over(w).alias("next_rejection"), F.lead("rank").over(w).alias("next_rank"))
    close = F.col("next_rank").isNotNull() & F.col("next_rejection").isNull() & (F.abs(F.col("next") - F.col("adjusted")) <= min_gap + EPSILON)
    band = F.when(F.col("rejection").isNotNull() | (F.col("adjusted") >= REJECT), "reject").when((F.col("adjusted") < strong) & ~F.coalesce(close, F.lit(False)), "strong").otherwise("ambiguous")
    return rows.filter("r = 1").select(case, F.concat_ws(":", "source", "ref_id").alias("winner"), "adjusted", band.alias("band"))


def top_candidates(ranked: DataFrame, case: str, most: int = 5) -> DataFrame:
    """(case, candidates): the first ``most`` of each case in order, for its explanation."""
    cells = [c for c in ("source", "ref_id", "album", "album_artist", "year", "distance", "adjusted", "rejection") if c in ranked.columns]
    first = ranked.filter(F.col("rank") <= most).groupBy(case).agg(F.array_sort(F.collect_list(F.struct("rank", *cells))).alias("candidates"))
    return first.select(case, F.transform("candidates", lambda x: x.dropFields("rank")).alias("candidates"))


def local_names(tracks: DataFrame, name: str) -> DataFrame:
    """``tracks`` whose title, and surely read artist, are filled from the file name where they lack them."""
    read = file_name_parts(F.col(name))
    sure = F.when(read["confidence"] >= 0.9, read["artist"])
    return tracks.withColumns({"title": F.coalesce("title", read["title"]), "artist": F.coalesce("artist", sure)})
