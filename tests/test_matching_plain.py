"""Scores, ranks and decisions against a plain computation over random cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marram.functions.text import name_distance
from marram.operators import matching as M

NAMES = ["Kid A", "Amnesiac", "Kid A (Remastered)", "The Bends", "Björk", "Bjork", "Part II", "Part 2", "Song feat. X", "", None]
CODES = ["1", "2", None, ""]
TEXTS = ("album", "album_artist", "label")
CELLS = ("media", "country", "catalog_number", "barcode")


def track(r):
    return {"title": r.choice(NAMES), "artist": r.choice(NAMES), "duration_ms": r.choice([None, 1000, 4000, 60_000]), "isrc": r.choice(CODES), "track_id": r.choice(CODES)}


def release(r):
    return {c: r.choice(NAMES) for c in TEXTS} | {c: r.choice(CODES) for c in CELLS} | {"year": r.choice([None, 1999, 2000, 2004]), "tracks": [track(r) for _ in range(r.randint(0, 3))]}


def mean(parts, weights):
    used = [(parts[k], w) for k, w in weights.items() if parts.get(k) is not None]
    return sum(d * w for d, w in used) / sum(w for _, w in used) if used else 1.0


def plain_pair(a, b):
    parts = {"index": 0.0}
    for k in ("title", "artist"):
        if a[k] and b[k]:
            parts[k] = name_distance(a[k], b[k])
    if a["duration_ms"] is not None and b["duration_ms"] is not None:
        parts["length"] = min(abs(a["duration_ms"] - b["duration_ms"]) / 10_000, 1.0)
    for k in ("track_id", "isrc"):
        if a[k] and b[k]:
            parts[k] = float(a[k] != b[k])
    return mean(parts, {"title": 3.0, "artist": 2.0, "length": 2.0, "index": 1.0, "track_id": 5.0, "isrc": 4.0})


def plain_score(own, other):
    a, b = own["tracks"], other["tracks"]
    size = max(len(a), len(b))
    cost = [[min(plain_pair(a[i], b[j]) + 0.15 * abs(i - j) / size, 1.0) if i < len(a) and j < len(b) else 0.85 for j in range(size)] for i in range(size)]
    options = [(sum(cost[i][p[i]] for i in range(size)), p) for p in itertools.permutations(range(size))]
    least = min(o[0] for o in options)
    found = []
    for total, p in options:
        if total <= least + 1e-12:
            matched = [cost[i][p[i]] for i in range(size) if i < len(a) and p[i] < len(b)]
            n = len(matched)
            parts = {"tracks": sum(matched) / n if n else 1.0, "missing_tracks": max(len(b) - n, 0) / max(len(b), 1), "unmatched_tracks": max(len(a) - n, 0) / max(len(a), 1)}
            parts |= {k: name_distance(own[k], other[k]) for k in TEXTS if own[k] and other[k]}
            parts |= {k: float(own[k] != other[k]) for k in CELLS if own[k] and other[k]}
            if own["year"] is not None and other["year"] is not None:
                parts["year"] = min(abs(own["year"] - other["year"]) / 5, 1.0)
            related = parts.get("album", 1.0) < 0.45 or any(c < 0.45 for c in matched)
            found.append((mean(parts, {"album": 3.0, "album_artist": 3.0, "tracks": 2.0, "missing_tracks": 0.9, "unmatched_tracks": 0.6, "year": 0.5, "media": 0.5, "country": 0.5, "label": 0.5, "catalog_number": 0.5, "barcode": 2.0}), related))
    return found


def corroborates(x, y):
    if x["source"] == y["source"]:
        return False
    if any(x[k] and x[k] == y[k] for k in ("barcode", "release_id")):
        return True
    n = len(x["tracks"])
    if not n or n != len(y["tracks"]) or (x["year"] is not None and y["year"] is not None and abs(x["year"] - y["year"]) > 1):
        return False
    return name_distance(x["album"], y["album"]) < 0.10


def plain_rank(scored):
    order = {"musicbrainz": 0, "discogs": 1, "deezer": 2}
    for x in scored:
        x["adjusted"] = max(0.0, min(1.0, x["distance"] - 0.05 * len({y["source"] for y in scored if corroborates(x, y)})))
    best = min(x["adjusted"] for x in scored)
    for x in scored:
        x["in"] = x["adjusted"] - best <= 0.03 + 1e-9
        x["order"] = min(1.0, x["adjusted"] + 0.02 * order[x["source"]]) if x["in"] else x["adjusted"]
        x["bad"] = not x["related"] or x["adjusted"] >= 0.45
    ranked = sorted(scored, key=lambda x: (not x["in"], x["order"], x["position"]))
    good = [x for x in ranked if not x["bad"]] or ranked
    first, rest = good[0], [x for x in good[1:] if not x["bad"]]
    band = "reject" if first["bad"] else "strong" if first["adjusted"] < 0.10 and not (rest and abs(rest[0]["adjusted"] - first["adjusted"]) <= 0.03 + 1e-9) else "ambiguous"
    return [x["ref_id"] for x in ranked], f"{first['source']}:{first['ref_id']}", band


def test_matching_equals_a_plain_computation(spark):
    r = random.Random(4)
    rows, cases = [], {}
    for case in range(60):
        own = release(r)
        scored = []
        for position in range(r.randint(1, 4)):
            other = dict(own) if r.random() < 0.4 else release(r)
            if r.random() < 0.5:
                other = other | {"year": r.choice([1999, 2000])}
            other |= {"source": r.choice(["musicbrainz", "discogs", "deezer"]), "ref_id": f"{case}-{position}", "release_id": r.choice(CODES), "position": position}
            options = plain_score(own, other)
            # Alignments of equal cost may differ in what they match; such cases say nothing.
            if max(d for d, _ in options) - min(d for d, _ in options) > 1e-9 or len({x for _, x in options}) > 1:
                continue
            scored.append(other | {"distance": options[0][0], "related": options[0][1]})
        if scored:
            cases[case] = scored
            rows += [{"case_id": case, "local_tracks": own["tracks"]} | {f"local_{k}": own[k] for k in (*TEXTS, *CELLS, "year")} | {k: v for k, v in x.items() if k not in ("distance", "related")} for x in scored]
    kinds = {"case_id": "int", "position": "int", "local_year": "int", "year": "int", "tracks": f"array<{M.TRACK}>", "local_tracks": f"array<{M.TRACK}>"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in rows[0])
    df = spark.createDataFrame([tuple(row[k] for k in rows[0]) for row in rows], schema).repartition(3)
    ranked = M.rank(M.score_albums(df), "case_id")
    got = {}
    for x in ranked.orderBy("case_id", "rank").select("case_id", "ref_id", "distance", "related").collect():
        got.setdefault(x["case_id"], []).append(x)
    picked = {x["case_id"]: (x["winner"], x["band"]) for x in M.decide(ranked, "case_id").collect()}
    bands = set()
    for case, scored in cases.items():
        own = {x["ref_id"]: x for x in scored}
        assert {x["ref_id"]: (pytest.approx(own[x["ref_id"]]["distance"]), own[x["ref_id"]]["related"]) for x in got[case]} == {x["ref_id"]: (x["distance"], x["related"]) for x in got[case]}
        order, winner, band = plain_rank(scored)
        assert [x["ref_id"] for x in got[case]] == order
        assert picked[case] == (winner, band)
        bands.add(band)
    assert len(cases) > 40 and bands == {"strong", "ambiguous", "reject"}


def test_earliest_release_goes_first_among_near_ones(spark):
    rows = [(1, "musicbrainz", f"m{y}", i, y, 0.02 + i / 1000) for i, y in enumerate((2010, 1999, 2004))]
    df = spark.createDataFrame(rows, "case_id int, source string, ref_id string, position int, year int, distance double")
    df = df.withColumns({"album": F.lit("x"), "barcode": F.lit(None).cast("string"), "release_id": F.lit(None).cast("string"), "related": F.lit(True), "tracks": F.array().cast(f"array<{M.TRACK}>")})
    assert [x["ref_id"] for x in M.rank(df, "case_id").orderBy("rank").collect()] == ["m2010", "m1999", "m2004"]
    # The year settles only equal distances.
    same = df.withColumn("distance", F.lit(0.02))
    assert [x["ref_id"] for x in M.rank(same, "case_id", earliest=True).orderBy("rank").collect()] == ["m1999", "m2004", "m2010"]
