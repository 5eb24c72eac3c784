"""Searches by hand, inbox cursors, issues, staged runs, cascades, file classes, folds and single-track scores."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import catalog as C
from marram.operators import changes as X
from marram.operators import feeds as E
from marram.operators import grouping as G
from marram.operators import matching as M
from marram.operators.stages import Cancelled, StagedRun
from marram.streaming import live as L


def test_phrases_do_not_mind_marks(spark):
    df = spark.createDataFrame([(1, "Björk 東京"), (2, "björk"), (3, "BJORK"), (4, "bjark"), (5, None)], "id int, title string")
    for q in ("bjork", "BJÖRK", "björk"):
        assert {r["id"] for r in df.filter(C.phrase(q, ("title",))).collect()} == {1, 2, 3}
    assert {r["id"] for r in df.filter(C.phrase("björk 東京", ("title",))).collect()} == {1}


def test_facet_cursors():
    for value in ("a", "é 東", '"'):
        assert C.decode_facet_cursor(C.encode_facet_cursor(value)) == value
    assert C.decode_facet_cursor("%%%") is None and C.decode_facet_cursor(None) is None


def test_facets_in_one_pass_equal_facets_one_by_one(spark):
    from marram.operators.catalog import CatalogQuery

    rows = [(i, f"t{i}", f"a{i % 3}" if i % 5 else None, f"b{i % 4}", "x", [f"g{i % 2}", "g"], "MP3" if i % 3 else "FLAC", i % 7 == 0) for i in range(60)]
    t = spark.createDataFrame(rows, "id int, title string, artist string, album string, album_artist string, genre array<string>, format string, is_missing boolean")
    for query in (CatalogQuery(), CatalogQuery(artist="a1", format="MP3"), CatalogQuery(genre="g1", album="b2", q="t")):
        for options in ({}, {"needle": "1"}, {"cursor": "b1", "limit": 2}):
            one = {(c, r["value"], r["n"]) for c in ("artist", "album", "format", "genre") for r in C.facet(t, c, query, **options).collect()}
            assert {(r["facet"], r["value"], r["n"]) for r in C.facets(t, query, **options).collect()} == one


def test_searches_by_hand_are_put_in_order():
    found = C.ManualSearch(title="  a   b ", artist=" ", year=1999, providers=(" Discogs", "discogs", "", "Deezer")).checked()
    assert (found.title, found.artist, found.providers) == ("a b", None, ("discogs", "deezer"))
    for bad in ({"title": " "}, {"title": "a", "year": 999}, {"title": "a", "duration_ms": 0}, {"title": "a", "page": 10}, {"title": "a", "page_size": 21}, {"title": "a", "page": -1}):
        with pytest.raises(ValueError):
            C.ManualSearch(**bad).checked()


def test_inbox_refuses_bad_cursors_and_sessions(spark):
    assert E.decode_inbox_cursor("0:2:17") == (0, 2, 17)
    for bad in ("", "1:2", "a:b:c", "1:2:3:4"):
        with pytest.raises(ValueError):
            E.decode_inbox_cursor(bad)
    empty = spark.createDataFrame([], "id long, state string, import_session_id long")
    with pytest.raises(ValueError):
        E.inbox(empty, session="x1")


def test_first_issue_of_a_review(spark):
    kinds = "id int, error string, attempts array<struct<kind:string,state:string,error:string>>, operations array<struct<collision:boolean,collision_path:string,conflicting:array<int>,errors:array<string>>>"
    rows = [
        (1, None, [], []),
        (2, "bad", [("match", "permanent_failure", "bad")], []),
        (3, "bad", [("match", "permanent_failure", "other")], []),
        (4, None, [("match", "applied", "x"), ("match", "transient_failure", None)], []),
        (5, "", [], [(False, None, [], []), (False, None, [], ["e1", "e2"])]),
        (6, None, [], [(True, "lib/a", [3, 1], ["e"])]),
        (7, None, [], [(True, None, [], [])]),
    ]
    got = {r["id"]: r["i"] and tuple(r["i"]) for r in spark.createDataFrame(rows, kinds).select("id", E.first_issue().alias("i")).collect()}
    assert got == {1: None, 2: ("task", "bad"), 3: ("review", "bad"), 4: ("task", "match could not be completed"), 5: ("review", "e1; e2"), 6: ("collision", "Destination collision: 'lib/a' — conflicts with track(s) [1, 3] — e"), 7: ("collision", "Path collision")}


def test_staged_runs_go_on_where_they_stopped(spark, tmp_path):
    calls = []

    def stage(name, fail=False):
        def run(done):
            calls.append(name)
            if fail:
                raise RuntimeError(name)
            before = list(done.values())[-1] if done else spark.range(3)
            return before.withColumn(name, F.lit(len(done)))

        return name, run

    run = StagedRun(spark, f"file://{tmp_path}", "s1")
    with pytest.raises(RuntimeError):
        run.run([stage("scan"), stage("group", fail=True), stage("match")])
    assert run.states(["scan", "group", "match"]) == [("scan", "done"), ("group", "pending"), ("match", "pending")]
    answers = iter((False, False, True))
    with pytest.raises(Cancelled):
        run.run([stage("scan"), stage("group"), stage("match")], stop=lambda: next(answers))
    done = StagedRun(spark, f"file://{tmp_path}", "s1").run([stage("scan"), stage("group"), stage("match")])
    assert calls == ["scan", "group", "group", "match"]
    assert done["match"].columns == ["id", "scan", "group", "match"] and done["match"].count() == 3


def test_files_by_class(spark, tmp_path):
    names = {"lib/a.MP3": "supported", "lib/b/c.aif": "supported", "lib/.mp3": "unsupported", "lib/x.aac": "unsupported", "lib/Folder.JPG": "sidecar", "lib/f.jpg": "unsupported", "lib/.git/a.mp3": "excluded", "lib/@eaDir/x/a.mp3": "excluded", "lib/git": "unsupported"}
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r["path"]: r["c"] for r in df.select("path", X.file_class("lib").alias("c")).collect()} == names
    for n, data in (("a.mp3", b"x" * 70_000 + b"y" * 70_000), ("b.flac", b"z"), ("c.ogg", b"v" * 70_000), ("cover.jpg", b"1")):
        (tmp_path / n).write_bytes(data)
    files = X.audio_only(X.list_files(spark, f"file://{tmp_path}"))
    got = {r["path"].rpartition("/")[2]: r["partial_hash"] for r in X.partial_digest(files).collect()}
    whole = b"x" * 70_000 + b"y" * 70_000
    assert got == {"a.mp3": hashlib.sha256(whole[:65536] + whole[-65536:] + b"140000").hexdigest(), "b.flac": hashlib.sha256(b"z1").hexdigest(), "c.ogg": hashlib.sha256(b"v" * 70_000 + b"70000").hexdigest()}


def test_text_diffs():
    assert T.text_diff("abc", "abc") == [("equal", "abc")]
    assert T.text_diff("Song", "Song (live)") == [("equal", "Song"), ("insert", " (live)")]
    assert T.text_diff("a1z", "a22z") == [("equal", "a"), ("delete", "1"), ("insert", "22"), ("equal", "z")]
    assert T.text_diff("aa", "aaa") == [("equal", "aa"), ("insert", "a")] and T.text_diff(None, "") == []


TRACK = "id long, group_id long, path string, title string, artist string, album string, album_artist string, mb_release_id string, barcode string, catalog_number string, label string, track_total int, is_missing boolean"


def cascade_rows(spark, rows):
    cells = [(i, g, path, t, a, al, aa, rel, None, None, None, None, False) for i, g, path, t, a, al, aa, rel in rows]
    return spark.createDataFrame(cells, TRACK)


def test_cascade_stages_scope_and_stable_keys(spark):
    rows = [
        (1, None, "lib/a/1", "t1", "X", "Album One", None, "r1"), (2, None, "lib/a/2", "t2", "X", "Album One", None, "r1"),
        (3, None, "lib/b/3", "t3", "The Beatles", "Abbey Road", None, None), (4, None, "lib/b/4", "t4", "Beatles", "Abbey Road (Remastered)", "", None),
        (5, None, "lib/c/5", "t5", "Y", None, None, None), (6, 7, "lib/d/6", "t6", "Z", "Pinned", None, None), (7, 8, "lib/e/7", "t7", "M", "Mixed", None, None), (8, 8, "out/8", "t8", "M", "Mixed", None, None),
    ]
    matches = spark.createDataFrame([], "track_id long, mb_release_ids array<string>")
    pinned = spark.createDataFrame([(7,)], "group_id long")
    got = {r["id"]: (r["basis"], r["key"]) for r in G.cascade(cascade_rows(spark, rows), matches, pinned).collect()}
    assert {i: b for i, (b, _) in got.items()} == {1: "release_id", 2: "release_id", 3: "tags", 4: "tags", 5: "singleton", 7: "tags", 8: "tags"}
    assert got[3][1] == got[4][1] == hashlib.sha256(b"tags:beatles|abbey road").hexdigest()[:32]
    scoped = {r["id"]: r["basis"] for r in G.cascade(cascade_rows(spark, rows), matches, pinned, root="lib").collect()}
    assert scoped == {1: "release_id", 2: "release_id", 3: "tags", 4: "tags", 5: "singleton"}
    # Another first track of the same names leaves the key as it is.
    again = [(0, None, "lib/b/0", "t0", "BEATLES", "Abbey  Road", None, None), *rows]
    assert {r["id"]: r["key"] for r in G.cascade(cascade_rows(spark, again), matches, pinned).collect()}[3] == got[3][1]
    clusters = spark.createDataFrame([(1, 1, 0.0), (2, 1, 0.1), (3, 1, 0.2), (4, 4, 0.0)], "id long, leader_id long, distance double")
    assert [tuple(r) for r in G.cluster_confidence(clusters).collect()] == [(1, 3, round(0.85 - 0.15 * 0.35 / 0.25, 3))]


def test_token_bucket_waits(spark):
    rows = spark.createDataFrame([("k", float(t), 0.0) for t in (0, 0, 0, 0, 10)], "key string, at double, value double")
    got = [r["wait"] for r in L.fold(rows, lambda: L.TokenBucket(rate=0.5, burst=2.0)).collect()]
    assert sorted(got) == [0.0, 0.0, 0.0, 2.0, 4.0]


def test_single_tracks_score_by_the_nearest(spark):
    own = [("Other", None, 100_000, None, None), ("Song", None, 61_000, None, None), ("Song", None, 61_000, None, None)]
    pairs = spark.createDataFrame([(1, "a", own, "Album", "Band"), (1, "b", [], "Song", "Band")], f"case_id int, ref_id string, tracks array<{M.TRACK}>, album string, album_artist string")
    null = F.lit(None).cast("string")
    pairs = pairs.withColumns({"local_title": F.lit("Song"), "local_artist": F.lit("Band"), "local_duration_ms": F.lit(60_000).cast("long"), "local_isrc": null, "local_acoustid": null, "acoustid": null})
    got = {r["ref_id"]: r for r in M.score_singles(pairs, ["case_id", "ref_id"]).collect()}
    w = M.SINGLE_WEIGHTS
    assert got["a"]["distance"] == pytest.approx(w["length"] * 0.1 / (w["title"] + w["artist"] + w["length"])) and got["a"]["related"]
    assert got["b"]["distance"] == 0.0 and [s["field"] for s in got["b"]["signals"]] == ["title", "artist"]


def test_top_candidates_are_the_first_five(spark):
    ranked = spark.range(8).select(F.lit(1).alias("case"), F.col("id").cast("string").alias("ref_id"), F.lit("s").alias("source"), (8 - F.col("id")).alias("rank"))
    assert [x["ref_id"] for x in M.top_candidates(ranked, "case").first()["candidates"]] == ["7", "6", "5", "4", "3"]
