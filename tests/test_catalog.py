"""Catalogue operators: literal cases, page properties, templates, matching, folds and streams."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.functions import scalars as S
from marram.functions import template as P
from marram.functions.text import common_subsequence, match_key, name_distance
from marram.operators import catalog as C
from marram.operators import duplicates as D
from marram.operators import grouping as G
from marram.operators import matching as M
from marram.operators.catalog import CatalogQuery
from marram.streaming import live as L


@pytest.fixture(scope="module")
def songs(spark):
    names = ["AC-DC", 'The "Quoted"', "a:b", "OR", "Björk 東京", None, "plain text", "plain text", None]
    rows = [(i, t, "x", None if i % 4 == 0 else "al", "aa", ["g", "g"] if i == 1 else ["h"], "MP3", False, i % 2 == 0, None, i % 3) for i, t in enumerate(names)]
    return spark.createDataFrame(rows, "id long, title string, artist string, album string, album_artist string, genre array<string>, format string, is_missing boolean, has_art boolean, probe_error string, added int")


@pytest.mark.parametrize(("q", "ids"), [("AC-DC", {0}), ('The "Quoted"', {1}), ("a:b", {2}), ("OR", {3}), ("björk 東京", {4}), ("text plain", set()), ('"', set())])
def test_phrases_are_literal(songs, q, ids):
    assert {r["id"] for r in songs.filter(C.where(CatalogQuery(q=q))).collect()} == ids


def test_blank_phrase_is_no_filter(songs):
    assert songs.filter(C.where(CatalogQuery(q="  "))).count() == 9


@pytest.mark.parametrize(("column", "descending"), [("title", False), ("title", True), ("album", False), ("album", True)])
def test_pages_join_up_to_the_full_sort(songs, column, descending):
    cursor, seen = None, []
    while True:
        rows = C.page(songs, column, "id", cursor, descending, 2).collect()
        seen += [r["id"] for r in rows[:2]]
        if len(rows) < 3:
            break
        cursor = C.decode_cursor(C.encode_cursor(rows[1][column], rows[1]["id"]))
    order = [F.col(column).desc_nulls_last(), F.desc("id")] if descending else [F.col(column).asc_nulls_first(), F.asc("id")]
    assert seen == [r["id"] for r in songs.orderBy(*order).collect()]


def test_array_facet_counts_elements(songs):
    assert {(r["value"], r["n"]) for r in C.facet(songs, "genre", CatalogQuery(genre="g")).collect()} == {("g", 2), ("h", 8)}


def test_invalid_cursor_is_the_start():
    assert C.decode_cursor("%%%") is None and C.decode_cursor(None) is None


@pytest.mark.parametrize(
    ("text", "key"),
    [("The Wall", "wall"), ("Ágætis ß", "agætis ss"), ("Song (feat. X)", "song feat x"), ("Song ft. X", "song feat x"), ("Pt. II", "pt 2"), ("Part XIV", "part xiv"), ("Part IX", "part 9"), ("Mix Civic Live", "mix civic live"), ("B (Remastered 2009)", "b"), ("Live (Live at Budokan)", "live live at budokan"), (None, ""), ("", "")],
)
def test_match_keys(text, key):
    assert match_key(text) == key


def test_common_subsequence_equals_the_table():
    r = np.random.default_rng(0)
    for _ in range(100):
        a, b = ("".join(r.choice(list("abc"), r.integers(0, 12))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert common_subsequence(a, b) == t[-1, -1]
    assert name_distance("Twilight Twilight", "Twilight") > 0 and name_distance("x y", "y x") == 0


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(1)
    for _ in range(40):
        n = int(r.integers(1, 7))
        cost = r.random((n, n)).round(2)
        found = M.assign(cost)
        assert sorted(found.tolist()) == list(range(n))
        assert sum(cost[i, j] for i, j in enumerate(found)) == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_sources_that_hold_one_release_corroborate(spark):
    track = "struct<title:string,artist:string,duration_ms:bigint,isrc:string,track_id:string>"
    t = lambda title, ms: (title, None, ms, None, None)
    own = [t("Everything In Its Right Place", 251000), t("Kid A", 255000)]
    rows = [(1, "musicbrainz", "mb", 0, own, own), (1, "discogs", "dg", 1, own, [t("Wrong Track One Very Different", 300000), t("Wrong Track Two Very Different", 300000)])]
    names = "local_album string, local_album_artist string, local_year int, local_barcode string, album string, album_artist string, year int, barcode string"
    cells = ("Kid A", "Radiohead", 2000, "724358129921") * 2
    df = spark.createDataFrame([(*r, *cells) for r in rows], f"case_id int, source string, ref_id string, position int, local_tracks array<{track}>, tracks array<{track}>, {names}")
    for c in ("local_media", "local_country", "local_label", "local_catalog_number", "media", "country", "label", "catalog_number", "release_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    ranked = M.rank(M.score_albums(df), "case_id")
    first = ranked.orderBy("rank").first()
    assert (first["ref_id"], first["distance"], first["adjusted"], first["corroborated_by"]) == ("mb", 0.0, 0.0, ["discogs"])
    assert [s["field"] for s in first["signals"]] == ["tracks", "missing_tracks", "unmatched_tracks", "album", "album_artist", "year", "barcode"]
    assert M.decide(ranked, "case_id").first()["band"] == "strong"


@pytest.mark.parametrize("source", ["%upper{a", "a,b", "}", "%nope{a}", "%left{a}", "${1a}", "${", "%upper a", "%ifdef{$a}"])
def test_bad_templates_are_refused(spark, source):
    with pytest.raises(P.TemplateError):
        P.Template(source, spark.range(1))


def test_templates_render(spark):
    df = spark.createDataFrame([(1, "the o'neil stop-now", 7, None), (2, "x", -3, "2024-02")], "id int, title string, n int, date string")
    show = lambda s: [r[0] for r in df.orderBy("id").select(P.Template(s, df).value).collect()]
    assert show("%title{$title}") == ["The O'neil Stop-Now", "X"]
    assert show("%pad{$n,3}") == ["007", "-03"]
    assert show("%left{$title,-2}|%right{$title,2}") == ["the o'neil stop-n|ow", "|x"]
    assert show("%the{$title}%if{$date, on %time{$date,%%Y/%%m}}") == ["o'neil stop-now, the", "x on 2024/02"]
    assert [r["problem"] is None for r in P.render(df, "a//b").collect()] == [False, False]
    assert P.safe_component("con.txt") == "_con.txt" and P.safe_component("a<b>. ") == "a_b_" and len(P.clamp("é" * 200).encode()) <= 255


def test_scalars(spark):
    row = spark.range(1).select(
        S.clock_ms(F.lit("3:07")), S.clock_ms(F.lit("x")), S.year_of(F.lit("1999-12")), S.of_total(F.lit("3/12")), S.file_name_parts(F.lit("01 - A - B.mp3")), S.numeric_distance(F.lit(5), F.lit(None), 2.0), S.has_synced_lines(F.lit("[0:01]a\n\n[1:02.5]b"))
    ).first()
    assert (row[0], row[1], row[2], tuple(row[3]), tuple(row[4]), row[5], row[6]) == (187000, None, 1999, (3, 12), ("A", "B", 0.95), 1.0, True)


def test_fingerprint_claims_are_greedy(spark):
    votes = [(t, "a") for t in range(4)] + [(t, "b") for t in (3, 4, 5)] + [(t, "c") for t in (5, 6)] + [(9, "d")]
    got = {(r["release_id"], r["track_id"]) for r in G.fingerprint_groups(spark.createDataFrame(votes, "track_id long, release_id string")).collect()}
    assert got == {("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)}


def test_reconcile_twice_changes_nothing(spark):
    new = spark.createDataFrame([("r1",), ("r2",)], "mb_recording_id string")
    known = spark.createDataFrame([("r1", False), ("r2", True), ("r3", False)], "mb_recording_id string, dismissed boolean")
    assert {tuple(r) for r in D.reconcile(new, known).collect()} == {("r1", "updated"), ("r2", "dismissed_skipped"), ("r3", "removed")}


def test_throttle_anchors_on_the_last_emission(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.1, 2.0), (1, 0.2, 3.0), (1, 0.3, 4.0), (1, 0.4, 5.0), (2, 0.0, 9.0)], "key long, at double, value double")
    got = sorted(tuple(r) for r in L.fold(rows, L.Throttle).collect())
    assert got == [(1, 0.0, 1.0, False), (1, 0.3, 4.0, False), (1, 0.4, 5.0, True), (2, 0.0, 9.0, False)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.1, 2.0), (1, 0.3, 4.0), (2, 0.0, 9.0)], "key long, at double, value double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    L.fold_stream(stream, L.Throttle, L.Throttle).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 0.0, 1.0, False), (1, 0.3, 4.0, False), (2, 0.0, 9.0, False)]
    listing = spark.createDataFrame([("lib/a", 1, 1), ("lib/b", 2, 2)], "path string, size_bytes long, mtime long")
    listing.write.parquet(f"{tmp_path}/listing")
    catalog = spark.createDataFrame([("lib/a", 9, 9, None)], "path string, size_bytes long, mtime long, missing_since long")
    L.incremental_scan(spark.readStream.schema(listing.schema).parquet(f"{tmp_path}/listing"), catalog, f"{tmp_path}/cat", "lib", f"{tmp_path}/cp2").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/cat/v0").collect()} == {("lib/a", 1, 1, None), ("lib/b", 2, 2, None)}


def test_matching_takes_every_order(spark, tmp_path):
    from marram.plans import matching_queries as Q

    spark.createDataFrame([(k, 1, k % 3, 5.0) for k in range(1, 8)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"name {k}", "b") for k in range(3)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("e10_alignment_cost", "e11_album_scores", "e14_e16_rank", "e15_decisions", "e9_e12_single_scores"):
        got = Q.Q.queries[name](spark, str(tmp_path))
        assert {r["case_id"] for r in got.collect()} == set(range(1, 8)), name


def test_tag_clusters_equal_the_fold(spark, monkeypatch):
    from marram.functions.text import key_distance

    r = np.random.default_rng(7)
    rows = [(i, None, "".join(r.choice(list("ab c"), 6)) or None, "".join(r.choice(list("xyz "), 5))) for i in range(60)]
    leaders, expected = [], {}
    for i, _, a, b in rows:
        a, b = match_key(a), match_key(b)
        near = ((lead, (key_distance(a, la) + key_distance(b, lb)) / 2) for la, lb, lead in leaders)
        expected[i] = next((x for x in near if x[1] <= G.NEAR), None) or (i, 0.0)
        if expected[i][0] == i:
            leaders.append((a, b, i))
    monkeypatch.setattr(G, "PAIR_KEYS", 20)
    got = G.tag_clusters(spark.createDataFrame(rows, "id long, album_artist string, artist string, album string"), "id").collect()
    assert {x["id"]: (x["leader_id"], x["distance"]) for x in got} == expected and len(leaders) > 5


def test_long_chains_of_fingerprint_claims_settle(spark):
    votes = [(4 * k + i, f"r{k:03d}") for k in range(52) for i in range(5)]
    got = G.fingerprint_groups(spark.createDataFrame(votes, "track_id long, release_id string"))
    assert got.count() == 5 + 51 * 4


def _greedy_claims(votes, least=3, share=0.5):
    voters = {}
    for t, r in votes:
        voters.setdefault(r, set()).add(t)
    n = len({t for t, _ in votes})
    threshold = max(min(max(least, int(n * share)), n), least)
    taken, out = set(), set()
    for r in sorted(voters, key=lambda r: (-len(voters[r]), r)):
        free = voters[r] - taken
        if len(free) >= 2 and not (len(free) < threshold and len(free) < len(voters[r]) * share):
            taken |= free
            out |= {(r, t) for t in free}
    return out


@pytest.mark.parametrize("most", [10**6, 8])
def test_claims_by_component_and_by_rounds_are_greedy(spark, monkeypatch, most):
    r = np.random.default_rng(5)
    votes = sorted({(int(r.integers(0, 60)) + 100 * int(c), f"r{c}-{int(r.integers(0, 9))}") for c in range(4) for _ in range(45)})
    monkeypatch.setattr(G, "COMPONENT_VOTES", most)
    got = {(x["release_id"], x["track_id"]) for x in G.fingerprint_groups(spark.createDataFrame(votes, "track_id long, release_id string")).collect()}
    assert got == _greedy_claims(votes) and got


def test_a_chain_of_a_thousand_releases_takes_few_rounds(spark, monkeypatch):
    from marram.operators import components

    rounds = []
    hang = components._hang
    monkeypatch.setattr(components, "_hang", lambda edges: rounds.append(1) or hang(edges))
    votes = [(4 * k + i, f"r{(k * 619) % 1000:04d}") for k in range(1000) for i in range(5)]
    got = {(x["release_id"], x["track_id"]) for x in G.fingerprint_groups(spark.createDataFrame(votes, "track_id long, release_id string")).collect()}
    assert got == _greedy_claims(votes) and len(rounds) <= 20


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize(("letters", "size"), [("ab c", 8), ("abcdef ", 7), (LETTERS + " ", 14), ("".join(chr(200 + i) for i in range(100)) + " ", 8)])
def test_near_names_equal_comparing_all(letters, size):
    import random

    from marram.functions.text import key_distance
    from marram.operators.names import near_pairs

    r = random.Random(size)
    name = lambda: " ".join("".join(r.choice(letters) for _ in range(r.randint(0, size))).split())
    blur = lambda t: " ".join("".join(c if r.random() > 0.12 else r.choice(letters) for c in t).split())
    turn = lambda t: " ".join(r.sample(t.split(), len(t.split())))
    keys = [("x" * 80, "y" * 70), ("x" * 79, "y" * 70 + "z"), ("x" * 64, "y"), ("x" * 63, "y"), ("", ""), ("", "abcd"), ("", "bacd")]
    for _ in range(130):
        a, b = r.choice(keys)
        keys.append((r.choice((a, blur(a), turn(a))), r.choice((b, blur(b), turn(b)))) if r.random() < 0.6 else (name(), name()))
    keys = list(dict.fromkeys(keys))
    mean = lambda i, j: (key_distance(keys[i][0], keys[j][0]) + key_distance(keys[i][1], keys[j][1])) / 2
    want = {(i, j): mean(i, j) for i in range(len(keys)) for j in range(i) if mean(i, j) <= G.NEAR}
    i, j, d, _ = near_pairs(keys, keys, G.NEAR, True)
    assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), d.tolist(), strict=True)) == want and len(want) > 15
    half = len(keys) // 2
    i, j, d, _ = near_pairs(keys[:half], keys[half:], G.NEAR, False)
    assert {(b + half, a): c for a, b, c in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)} == {k: v for k, v in want.items() if k[0] >= half > k[1]}


def test_few_pairs_of_unlike_names_are_measured():
    import random

    from marram.operators.names import near_pairs

    r = random.Random(1)
    name = lambda: " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 3)))
    for n in (500, 2000):
        keys = [(name(), name()) for _ in range(n)]
        assert near_pairs(keys, keys, G.NEAR, True)[3] < n // 10
