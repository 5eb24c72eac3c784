"""Batched alignment, by disc too, duplicates through the ranking and pages of candidates, against plain computations."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.operators import alignment as A
from marram.operators import matching as M

from .test_matching_plain import corroborates, plain_pair, plain_rank, track

TRACK = "struct<title:string,artist:string,duration_ms:bigint,isrc:string,track_id:string,disc:int>"


def plain_cost(a, b):
    """Cost of the best alignment of two short lists, by trying all."""
    size = max(len(a), len(b))
    if not size:
        return 0.0
    cost = [[min(plain_pair(a[i], b[j]) + 0.15 * abs(i - j) / size, 1.0) if i < len(a) and j < len(b) else 0.85 for j in range(size)] for i in range(size)]
    return min(sum(cost[i][p[i]] for i in range(size)) for p in itertools.permutations(range(size)))


def test_stacks_of_matrices_are_assigned_at_least_cost():
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 6):
        cost = r.random((40, n, n)).round(1)
        found = A.assign_all(cost)
        assert (np.sort(found, 1) == np.arange(n)).all()
        got = np.take_along_axis(cost, found[:, :, None], 2).sum((1, 2))
        assert got == pytest.approx([min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) for c in cost])
    big = r.random((2, 60, 60))
    columns = A.assign_all(big)
    assert (np.sort(columns, 1) == np.arange(60)).all()
    # No exchange of two or three rows is cheaper.
    for c, own in zip(big, columns, strict=True):
        for i, j, k in itertools.combinations(range(0, 60, 3), 3):
            now = c[i, own[i]] + c[j, own[j]] + c[k, own[k]]
            assert now <= c[i, own[j]] + c[j, own[k]] + c[k, own[i]] + 1e-9 and now <= c[i, own[j]] + c[j, own[i]] + c[k, own[k]] + 1e-9


@pytest.mark.parametrize("by_disc", [True, False])
def test_alignments_equal_trying_all(spark, by_disc):
    r = random.Random(8)
    cases = []
    for k in range(120):
        own = [track(r) | {"disc": r.choice((1, 2, 2, None if k % 4 == 0 else 3))} for _ in range(r.randint(0, 5))]
        other = [dict(t) for t in r.sample(own, r.randint(0, len(own)))] + [track(r) | {"disc": None} for _ in range(r.randint(0, 2))]
        cases.append((k, own if k != 7 else None, other if k != 9 else None))
    as_row = lambda ts: None if ts is None else [tuple(t.values()) for t in ts]
    df = spark.createDataFrame([(k, as_row(a), as_row(b), "x") for k, a, b in cases], f"case_id int, local_tracks array<{TRACK}>, tracks array<{TRACK}>, cost string").repartition(3)
    got = {x["case_id"]: x["alignment"] for x in A.aligned(df, by_disc=by_disc).collect()}
    split = 0
    for k, a, b in cases:
        a, b = a or [], b or []
        discs = list(dict.fromkeys(t["disc"] for t in a))
        parts = [a] if not by_disc or None in discs or len(discs) < 2 else [[t for t in a if t["disc"] == d] for d in discs]
        split += len(parts) > 1
        assert sum(x["cost"] for x in got[k]) == pytest.approx(sum(plain_cost(p, b) for p in parts))
        assert len(got[k]) == sum(max(len(p), len(b)) for p in parts)
        assert sorted(x["local"] for x in got[k] if x["local"] is not None) == list(range(len(a)))
        for x in got[k]:
            if x["local"] is None or x["candidate"] is None:
                assert x["cost"] == 0.85
            else:
                assert x["cost"] + 1e-12 >= plain_pair(a[x["local"]], b[x["candidate"]])
    assert (split > 20) == by_disc
    assert A.aligned(df.limit(0)).count() == 0


def test_tracks_without_discs_align_whole(spark):
    kind = M.TRACK
    df = spark.createDataFrame([(1, [("a", None, None, None, None), ("b", None, None, None, None)], [("b", None, None, None, None)])], f"case_id int, local_tracks array<{kind}>, tracks array<{kind}>")
    got = A.aligned(df).first()["alignment"]
    assert {(x["local"], x["candidate"]) for x in got} == {(0, None), (1, 0)}


def test_duplicates_follow_the_ranking_and_the_page(spark):
    r = random.Random(3)
    cases = {}
    for case in range(40):
        cases[case] = [
            {"source": r.choice(["musicbrainz", "discogs", "deezer"]), "ref_id": f"{case}-{p}", "position": p, "album": r.choice(["Kid A", "Kid A", "Amnesiac"]), "barcode": r.choice([None, "", "1", "2"]), "release_id": r.choice([None, "r"]), "year": r.choice([None, 2000, 2001, 2004]), "tracks": [None] * r.choice([0, 2, 2, 3]), "distance": r.choice([0.01, 0.02, 0.08, 0.3, 0.5]) + p / 1e6, "related": True}
            for p in range(r.randint(1, 6))
        ]
    rows = [(c, x["source"], x["ref_id"], x["position"], x["album"], x["barcode"], x["release_id"], x["year"], len(x["tracks"]), x["distance"]) for c, own in cases.items() for x in own]
    df = spark.createDataFrame(rows, "case_id int, source string, ref_id string, position int, album string, barcode string, release_id string, year int, n int, distance double")
    df = df.withColumn("related", F.lit(True)).withColumn("tracks", F.array_repeat(F.lit(None).cast(M.TRACK), F.col("n"))).drop("n")
    ranked = M.rank(df, "case_id", adjacency=True)
    got, found = {}, 0
    for x in ranked.orderBy("case_id", "rank").collect():
        got.setdefault(x["case_id"], []).append((x["ref_id"], x["is_duplicate_of"]))
    for case, own in cases.items():
        order, _, _ = plain_rank(own)
        by = {x["ref_id"]: x for x in own}
        want = [(i, [k for k, j in enumerate(order) if j != i and corroborates(by[i], by[j])]) for i in order]
        assert got[case] == want
        found += sum(len(d) for _, d in want)
    assert found > 40
    for page in (0, 1, 2):
        rows = M.page_of(ranked, "case_id", page, 2).orderBy("case_id", "rank").collect()
        shown = {}
        for x in rows:
            shown.setdefault(x["case_id"], []).append((x["ref_id"], x["is_duplicate_of"], x["more"]))
        lo, hi = 2 * page, 2 * page + 2
        assert shown == {c: [(i, [k - lo for k in d if lo <= k < hi], len(own) > hi) for i, d in own[lo:hi]] for c, own in got.items() if own[lo:hi]}


def test_the_original_year_settles_ties(spark):
    rows = [("a", 0, 2000, None), ("b", 1, 2015, 1970), ("c", 2, 1980, 0)]
    df = spark.createDataFrame([(1, "musicbrainz", i, p, y, o, 0.02) for i, p, y, o in rows], "case_id int, source string, ref_id string, position int, year int, original_year int, distance double")
    df = df.withColumns({"album": F.col("ref_id"), "barcode": F.lit(None).cast("string"), "release_id": F.lit(None).cast("string"), "related": F.lit(True), "tracks": F.array().cast(f"array<{M.TRACK}>")})
    assert [x["ref_id"] for x in M.rank(df, "case_id", earliest=True).orderBy("rank").collect()] == ["b", "c", "a"]
    assert [x["ref_id"] for x in M.rank(df.drop("original_year"), "case_id", earliest=True).orderBy("rank").collect()] == ["c", "a", "b"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_aligned_for_other_columns(spark):
    df = spark.createDataFrame([(1, [], [], "x")], f"case_id int, local_tracks array<{M.TRACK}>, tracks array<{M.TRACK}>, more string")
    rows = A.aligned(df)
    assert "Python" not in _plan(rows.select("case_id", "more")) and "Arrow" not in _plan(rows.select("case_id", "more"))
    assert "ArrowEvalPython" in _plan(rows.select("alignment")) and rows.first()["alignment"] == []


def _answers(spark, rows):
    df = spark.createDataFrame([(1, s, i, p, a, d) for p, (s, i, a, d) in enumerate(rows)], "case_id int, source string, ref_id string, position int, album string, distance double")
    return df.withColumns({"barcode": F.lit(None).cast("string"), "release_id": F.lit(None).cast("string"), "year": F.lit(2000), "related": F.lit(True), "n_tracks": F.lit(2)})


def test_candidates_are_ranked_in_one_reading(spark):
    df = _answers(spark, [("musicbrainz", "a", "Kid A", 0.1), ("discogs", "b", "Kid A", 0.2)])
    for got in (M.rank(df, "case_id"), M.rank(df, "case_id", adjacency=True), M.duplicates(df, "case_id"), M.corroborators(df, "case_id")):
        assert _plan(got).count("Join") == 0 and not got.inputFiles()
        assert got.count() == 2


def test_sources_may_give_the_same_id(spark):
    df = _answers(spark, [("musicbrainz", "1", "Kid A", 0.1), ("discogs", "1", "Kid A", 0.2), ("deezer", "2", "Amnesiac", 0.3), ("deezer", "3", None, 0.4)])
    got = {(x["source"], x["ref_id"]): (x["rank"], x["corroborated_by"], x["is_duplicate_of"]) for x in M.rank(df, "case_id", adjacency=True).collect()}
    assert got == {("musicbrainz", "1"): (1, ["discogs"], [1]), ("discogs", "1"): (2, ["musicbrainz"], [0]), ("deezer", "2"): (3, [], []), ("deezer", "3"): (4, [], [])}


def test_single_tracks_are_scored_within_their_row(spark):
    own = [("Other", "Band", 60_000, None, None), ("Song", "Band", 60_000, None, None), None, ("Song", "Band", 60_000, None, None)]
    df = spark.createDataFrame([(1, "a", own[:2]), (1, "b", None), (1, "c", own[1:]), (1, "d", own[1:2])], f"case_id int, ref_id string, tracks array<{M.TRACK}>")
    null = F.lit(None).cast("string")
    df = df.withColumns({"album": F.lit("Song"), "album_artist": F.lit("Band"), "local_title": F.lit("Song"), "local_artist": F.lit("Band"), "local_duration_ms": F.lit(61_000).cast("long"), "local_isrc": null, "local_acoustid": null, "acoustid": null})
    rows = M.score_singles(df, ["case_id", "ref_id"])
    assert "Exchange" not in _plan(rows) and "Generate" not in _plan(rows)
    # A missing track or list is scored by the album's own names.
    assert {x["ref_id"]: (round(x["distance"], 6), len(x["signals"])) for x in rows.collect()} == {"a": (round(0.25 / 8.5, 6), 3), "b": (0.0, 2), "c": (0.0, 2), "d": (round(0.25 / 8.5, 6), 3)}
