"""Keyed tables, and the cascade from tracks to stored groups against a plain computation."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marram.functions.text import key_distance, match_key
from marram.operators import duplicates as D
from marram.operators import grouping as G
from marram.sources.versioned import KeyedTable

TRACK = "id long, path string, title string, artist string, album string, album_artist string, year int, label string, catalog_number string, barcode string, mb_release_id string, track_total int, is_missing boolean"
MATCH = "track_id long, mb_release_ids array<string>"


def table_of(spark, tmp_path, **more):
    return KeyedTable(spark, f"file://{tmp_path}/t", "a long, b string, v int", ["a", "b"], **more)


def rows_of(spark, rows, removed=False):
    return spark.createDataFrame(rows, "a long, b string, v int").withColumn("removed", F.lit(removed)).withColumn("bucket", F.lit("x"))


def test_merges_make_versions_of_touched_buckets_alone(spark, tmp_path):
    t = table_of(spark, tmp_path, buckets=8)
    assert t.read().count() == 0 and t.version() == 0
    first = [(i, "x" if i % 2 else None, i) for i in range(40)] + [(None, None, 7)]
    assert t.merge(rows_of(spark, first)) == {"created": 41, "updated": 0, "removed": 0, "unchanged": 0}
    assert t.merge(rows_of(spark, first)) == {"created": 0, "updated": 0, "removed": 0, "unchanged": 41} and t.version() == 1
    before = {r["bucket"]: r["path"] for r in t._manifest(1)}
    assert t.merge(rows_of(spark, [(3, "x", 99), (5, "x", 5), (None, None, 8)]).unionByName(rows_of(spark, [(4, None, 0), (77, "x", 0)], removed=True))) == {"created": 0, "updated": 2, "removed": 1, "unchanged": 1}
    now = {r["bucket"]: r["path"] for r in t._manifest(2)}
    assert 1 <= sum(now[b] != before[b] for b in now) <= 3 < len(now)
    want = {(a, b): v for a, b, v in first} | {(3, "x"): 99, (None, None): 8}
    del want[4, None]
    assert {(r["a"], r["b"]): r["v"] for r in t.read().collect()} == want
    assert {tuple(r) for r in t.read(1).collect()} == set(first)


def test_versions_expire_and_writers_do_not_overwrite(spark, tmp_path):
    t = table_of(spark, tmp_path, buckets=4)
    for k in range(5):
        t.merge(rows_of(spark, [(1, "x", k), (k + 10, "y", 0)]))
    assert t.expire(2) == 3 and t.versions() == [4, 5]
    assert {tuple(r) for r in t.read().collect()} == {(1, "x", 4), *((k + 10, "y", 0) for k in range(5))}
    assert t.read(4).count() == 5
    again = table_of(spark, tmp_path)
    assert again.buckets == 4
    again.version = lambda: 4
    with pytest.raises(Exception, match="(?i)exists"):
        again.merge(rows_of(spark, [(1, "x", -1)]))
    assert t.merge(rows_of(spark, [(k + 10, "y", 0) for k in range(5)] + [(1, "x", 0)], removed=True))["removed"] == 6
    assert t.read().count() == 0
    assert t.merge(rows_of(spark, [])) == {"created": 0, "updated": 0, "removed": 0, "unchanged": 0}
    assert t.merge(rows_of(spark, [(1, "z", 5), (1, "z", 6), (1, "z", 2)]))["created"] == 1 and t.read().first()["v"] == 6


def plain_key(basis, value):
    return hashlib.sha256(f"{basis}:{value}".encode()).hexdigest()[:32]


def plain_cascade(tracks, votes):
    """key -> group and its tracks, stage after stage, one track after the other."""
    used, out, alone = set(), {}, []
    first_fields = lambda t: {c: t[c] for c in G._COPIED}

    def add(key, basis, confidence, members, fields):
        totals = {t["track_total"] for t in members if t["track_total"]}
        partial = basis != "singleton" and len(members) > 1 and len(totals) == 1 and next(iter(totals)) > len(members)
        kind = "singleton" if basis == "singleton" else "partial_album" if partial else "album"
        out[key] = ({"kind": kind, "basis": basis, "confidence": confidence, "track_count": len(members), "expected_track_count": next(iter(totals)) if partial else None} | fields, {t["id"] for t in members})

    ids = (("release_id", lambda t: t["mb_release_id"]), ("barcode", lambda t: t["barcode"]), ("catalog_label", lambda t: t["catalog_number"] and t["label"] and f"{t['catalog_number']}|{t['label']}"))
    for basis, of in ids:
        buckets = {}
        for t in tracks:
            if t["id"] not in used and of(t):
                buckets.setdefault(of(t), []).append(t)
        for value, members in buckets.items():
            used |= {t["id"] for t in members}
            if len(members) > 1:
                add(plain_key(basis, value), basis, 1.0, members, first_fields(members[0]))
            else:
                alone += members
    rest = [t for t in tracks if t["id"] not in used] + sorted(alone, key=lambda t: t["id"])
    voters = {}
    for t in rest:
        for r in votes.get(t["id"], ()):
            voters.setdefault(r, set()).add(t["id"])
    n = len({i for v in voters.values() for i in v})
    threshold = max(min(max(3, int(n / 2)), n), 3)
    taken = set()
    for r in sorted(voters, key=lambda r: (-len(voters[r]), r)):
        free = voters[r] - taken
        if len(free) >= 2 and not (len(free) < threshold and len(free) < len(voters[r]) / 2):
            members = sorted((t for t in rest if t["id"] in free), key=lambda t: t["id"])
            add(plain_key("fingerprint", r), "fingerprint", 0.9, members, first_fields(members[0]) | {"mb_release_id": r})
            taken |= free
    rest = [t for t in rest if t["id"] not in taken]
    clusters, singles = [], []
    names = lambda t: (match_key(t["album_artist"] or t["artist"]), match_key(t["album"]))
    far = lambda a, b: (key_distance(names(a)[0], names(b)[0]) + key_distance(names(a)[1], names(b)[1])) / 2
    for t in rest:
        if not (t["album"] or "").strip() or match_key(t["album"]) == match_key(t["title"] or "") and t["title"] or t["track_total"] == 1:
            singles.append(t)
            continue
        home = next((c for c in clusters if far(t, c[0]) <= G.NEAR), None)
        if home is None:
            clusters.append([t])
        else:
            home.append(t)
    for c in clusters:
        if len(c) == 1:
            singles += c
            continue
        mean = sum(far(t, c[0]) for t in c[1:]) / (len(c) - 1)
        add(plain_key("tags", "|".join(names(c[0]))), "tags", max(0.5, min(0.85, round(0.85 - mean * 0.35 / 0.25, 3))), c, first_fields(c[0]))
    for t in singles:
        own = dict.fromkeys(G._COPIED) | {"album": t["album"], "album_artist": t["album_artist"] or t["artist"], "year": t["year"]}
        add(plain_key("singleton", f"track:{t['id']}"), "singleton", 1.0, [t], own)
    return out


def library(seed, n=90):
    r = random.Random(seed)
    albums = ["Abbey Road", "Abbey Rd", "Road Abbey", "Kind of Blue", "Blue Kind", "Kinda Blue", " ", None, "Thriller", "Thriler"]
    artists = ["The Beatles", "Beatles", "Miles Davis", "Mile Davis", None, ""]
    out = []
    for i in range(1, n + 1):
        cut = lambda p, c: c if r.random() < p else r.choice((None, ""))
        title = r.choice((f"song {i}", "Thriller", None))
        out.append((i, f"lib/{r.choice('ab')}/{i}", title, r.choice(artists), r.choice(albums), r.choice(artists), r.choice((None, 1990)), cut(0.4, "L"), cut(0.4, f"c{r.randint(0, 9)}"), cut(0.12, f"b{r.randint(0, 8)}"), cut(0.1, f"r{r.randint(0, 6)}"), r.choice((None, 0, 1, 12, 12, 2)), r.random() < 0.05))
    votes = {i: sorted({f"v{r.randint(0, 5)}" for _ in range(r.randint(0, 2))}) for i in range(1, n + 1) if r.random() < 0.4}
    return out, votes


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_groups_equal_the_stages_one_by_one(spark, tmp_path, seed):
    cells, votes = library(seed)
    names = [c.split()[0] for c in TRACK.split(", ")]
    tracks = [dict(zip(names, c, strict=True)) for c in cells]
    table, matches = spark.createDataFrame(cells, TRACK), spark.createDataFrame(list(votes.items()), MATCH)
    store = G.GroupStore(spark, f"file://{tmp_path}", buckets=8)
    live = [t for t in tracks if not t["is_missing"]]
    want = plain_cascade(live, votes)
    got = store.run(table, matches)
    assert got == {"created": len(want), "updated": 0, "tracks_grouped": len(live), "tracks_skipped_pinned": 0}

    def stored():
        return {r["key"]: {c: r[c] for c in r.asDict() if c not in ("key", "is_pinned")} for r in store.groups.read().collect()}

    assert stored() == {k: {**g, "confidence": pytest.approx(g["confidence"])} for k, (g, _) in want.items()}
    home = lambda: {r["id"]: r["key"] for r in store.members.read().collect()}
    assert home() == {i: k for k, (_, ids) in want.items() for i in ids}
    # The same once more changes nothing.
    assert store.run(table, matches) == {"created": 0, "updated": len(want), "tracks_grouped": 0, "tracks_skipped_pinned": 0}
    assert store.groups.version() == store.members.version() == 1
    # Pinned groups keep fields and tracks, whatever their tags become.
    big = max(want, key=lambda k: len(want[k][1]))
    store.pin(spark.createDataFrame([(big,)], "key string"))
    after = [t | {"album": "Other"} if t["id"] in want[big][1] else t | {"year": 2001} for t in tracks]
    changed = spark.createDataFrame([tuple(t[c] for c in names) for t in after], TRACK)
    counts = store.run(changed, matches)
    free = [t for t in after if not t["is_missing"] and t["id"] not in want[big][1]]
    then = plain_cascade(free, votes)
    then.pop(big, None)
    assert counts["tracks_skipped_pinned"] == len(want[big][1]) and counts["created"] == len(set(then) - set(want)) and counts["updated"] == len(set(then) & set(want))
    assert stored()[big]["album"] == want[big][0]["album"] and {i for i, k in home().items() if k == big} == want[big][1]
    assert {k: stored()[k]["year"] for k in then} == {k: g["year"] for k, (g, _) in then.items()}
    assert store.groups.read(1).count() == len(want)


def test_scoped_runs_leave_mixed_groups(spark, tmp_path):
    row = lambda i, path, album: (i, path, f"t{i}", "A", album, None, None, None, None, None, None, None, False)
    tracks = spark.createDataFrame([row(1, "lib/1", "One"), row(2, "out/2", "One"), row(3, "lib/3", "Two"), row(4, "lib/4", "Two")], TRACK)
    store = G.GroupStore(spark, f"file://{tmp_path}", buckets=4)
    none = spark.createDataFrame([], MATCH)
    assert store.run(tracks, none)["created"] == 2
    renamed = tracks.withColumn("album", F.when(F.col("id") < 3, F.col("album")).otherwise("Three"))
    assert store.run(renamed, none, root="lib") == {"created": 1, "updated": 0, "tracks_grouped": 2, "tracks_skipped_pinned": 0}
    home = {r["id"]: r["key"] for r in store.members.read().collect()}
    assert home[1] == home[2] != home[3] == home[4]


def test_stored_duplicates_follow_matches_and_dismissals(spark, tmp_path):
    tracks = spark.createDataFrame([(i, 1000 * i, "MP3", 5, i == 9) for i in range(1, 10)], "id long, duration_ms long, format string, size_bytes long, is_missing boolean")
    match = lambda rows: spark.createDataFrame([(k, t, r, s) for k, (t, r, s) in enumerate(rows)], "id long, track_id long, mb_recording_id string, score double")
    store = D.DuplicateStore(spark, f"file://{tmp_path}", buckets=4)
    first = [(1, "a", 0.9), (2, "a", 0.8), (3, "b", 0.9), (4, "b", 0.9), (5, "c", 0.5), (6, "c", 0.6), (9, "d", 1.0), (7, "d", 1.0)]
    assert store.run(match(first), tracks) == {"created": 3, "updated": 0, "removed": 0, "dismissed_skipped": 0}
    assert store.run(match(first), tracks) == {"created": 0, "updated": 3, "removed": 0, "dismissed_skipped": 0}
    assert store.groups.version() == store.members.version() == 1
    store.dismiss(spark.createDataFrame([("b",)], "mb_recording_id string"))
    # b has nothing left but is dismissed; c goes; a gains a member and loses one; e is new.
    then = [(1, "a", 0.9), (2, "e", 0.8), (3, "a", 0.9), (4, "e", 0.9), (5, "c", 0.5)]
    assert store.run(match(then), tracks) == {"created": 1, "updated": 1, "removed": 1, "dismissed_skipped": 1}
    assert {(r["mb_recording_id"], r["dismissed"], r["members"]) for r in store.groups.read().collect()} == {("a", False, 2), ("b", True, 2), ("e", False, 2)}
    assert {tuple(r) for r in store.members.read().collect()} == {("a", 1), ("a", 3), ("b", 3), ("b", 4), ("e", 2), ("e", 4)}
    store.dismiss(spark.createDataFrame([("b",)], "mb_recording_id string"), False)
    assert store.run(match(then), tracks)["removed"] == 1 and store.groups.read().count() == 2
