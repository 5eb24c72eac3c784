"""Centroids, spelling variants and repeated passages against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.llm import centroids, variants, windows

from .test_operators import SCHEMA, docs_of, prose

VECTORS = "vec_id long, embedding array<double>, cluster string"


# op11
def plain_clusters(rows, k, rounds, seed, size):
    """Whole computation in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centre = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centre))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centre)):
            inside = [v for (_, v), c in zip(kept, own, strict=True) if c == n]
            if inside:
                centre[n] = [sum(x) // len(inside) for x in zip(*inside, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, n in last:
        total[n] += d
    fits = lambda v: v if v < 2**63 else None
    return sorted(((i, n, fits(d), fits(total[n]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()) for i, d, n in last), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e4, 3e5, 1e8, 1e17])
def test_clusters_equal_whole_numbers_at_every_magnitude(spark, scale):
    r = random.Random(5)
    rows = [(i, [scale * r.gauss(n, 0.3) for n in range(6)]) for i in range(120)]
    rows += [(200, [scale * 3.0] * 6), (200, [scale * 3.0] * 6), (None, [0.0] * 6), (201, None), (202, []), (203, [1.0] * 5), (204, [1.0] * 5 + [None]), (205, [float("nan")] * 6), (206, [float("-inf")] * 6)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).repartition(3)
    got = centroids.cluster(table, k=7, rounds=3, size=6).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_clusters(rows, 7, 3, centroids.SEED, 6)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [1.5, 2.0]), (2, [1.5, 2.0]), (3, [-0.001, 0.0])]
    got = centroids.cluster(spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS), size=2).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_clusters(rows, 40, 5, centroids.SEED, 2)
    empty = centroids.cluster(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_bound_decides_between_doubles_and_integers():
    near = centroids.Nearest([[2**26 + 1, 0], [2**26, 1]])
    values = np.array([[2**26, 0], [2**26 + 1, 1]])
    assert [list(x) for x in near(values)] == [[0, 0], [1, 1]]
    far = centroids.Nearest([[2**40, 3], [2**40, 2]])
    assert [list(x) for x in far(np.array([[0, 2]]))] == [[1], [2**80]]


# op12
def plain_variants(words, least, ratio):
    n = {w: c for w, c in Counter(words).items() if len(w) >= 6 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = (form[w], None, n[w], len(own), n[best] if form[w] else None)
    got = set()
    for w, (f, _, c, k, m) in out.items():
        root = w
        while form[root]:
            root = form[root]
        got.add((w, f, root, c, k, m))
    return got


def test_variants_equal_comparing_all_words(spark):
    r = random.Random(3)
    letters = "abcdeéÿ÷"
    bases = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(60)]
    words = []
    for b in bases:
        for _ in range(14):
            w, times = b, 1
            for _ in range(r.randint(0, 3)):
                at, c = r.randrange(len(w)), r.choice(letters)
                w = r.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :])) or c
            times = r.choice((1, 4, 5, 6, 30, 160))
            words += [w] * times
    table = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(x) for x in variants.group_variants(table).collect()}
    assert got == plain_variants(words, variants.LEAST, variants.RATIO)
    assert any(x[1] and x[1] != x[2] for x in got)


def test_runs_of_letters_and_planted_typos(spark):
    text = "Élan ÉLANÉ foobarbaz'FOOBARBAZ x foo\tbarbaz- Straße ÀÁÂÃÄÅ " * 40
    rows = [(i, text) for i in range(30)] + [(None, text), (5, None), (6, ""), (7, "ab cd")]
    low = str.maketrans(variants._UPPER, variants._LOWER)
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    got = variants.runs(docs_of(spark, rows), typo=7).groupBy("word").count().collect()
    assert {x["word"]: x["count"] for x in got} == dict(want)


def test_variants_of_ties_long_words_and_empty_tables(spark):
    long = "q" * 50_000
    rows = ["abcdef"] * 5 + ["abcdefg"] * 25 + ["abcdefh"] * 25 + [long] * 5 + [long + "q"] * 25 + ["qqqqqq"] * 5
    got = {x["word"]: tuple(x)[1:] for x in variants.group_variants(spark.createDataFrame([(w,) for w in rows], "word string")).collect()}
    assert got["abcdef"] == ("abcdefg", "abcdefg", 5, 2, 25)
    assert got["abcdefg"] == (None, "abcdefg", 25, 2, None)
    assert got[long] == (long + "q", long + "q", 5, 1, 25)
    assert got["qqqqqq"] == (None, "qqqqqq", 5, 0, None)
    assert variants.group_variants(variants.runs(docs_of(spark, []), typo=199)).count() == 0
    clash = docs_of(spark, [(1, "wonderful " * 6)]).withColumn("word", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3))
    assert [tuple(x) for x in variants.group_variants(variants.runs(clash)).collect()] == [("wonderful", None, "wonderful", 6, 0, None)]


# op13
def plain_cut(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        mark = [False] * len(words)
        for k in range(len(words) - width + 1):
            own = tuple(words[k : k + width])
            if own in seen:
                mark[k : k + width] = [True] * width
            seen.add(own)
        out[i] = (len(words), sum(mark), " ".join(w for w, m in zip(words, mark, strict=True) if not m))
    return out


@pytest.mark.parametrize(("chunk", "bucket"), [(2_000_000, 1_000_000), (900, 300), (1, 50)])
def test_cut_words_equal_brute_force(spark, chunk, bucket):
    r = random.Random(11)
    passage, hot = prose(r, 70), prose(r, 19)
    rows = []
    for i in range(90):
        parts = [prose(r, r.randint(0, 60)) for _ in range(2)]
        parts.insert(1, r.choice((passage, hot, passage[: len(passage) // 2], "a b " * 30, "")))
        rows.append((i * 7 - 100, r.choice(("\n", "  ", "\t\x0b", " \x1c  ")).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, rows[3][1]), (2**60 + 1, rows[3][1]), (1003, "é ü " * 40)]
    docs = docs_of(spark, rows).withColumn("chunk", F.lit("x")).withColumn("bucket", F.lit(0)).repartition(5)
    got = {x["id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in windows.cut_repeats(docs, chunk=chunk, bucket=bucket).collect()}
    assert got == plain_cut(rows, windows.WIDTH)
    assert sum(x[1] for x in got.values()) > 1000


def test_spans_are_maximal_and_rows_of_one_id_keep_one_copy(spark):
    text = prose(random.Random(2), 50)
    docs = docs_of(spark, [(4, text)] * 3 + [(4, "start " + text), (9, "one two " + text + " three " + text)]).repartition(4)
    got = windows.cut_repeats(docs, chunk=10, bucket=20).collect()
    assert sorted(x["n_removed"] for x in got) == [0, 50, 50, 50, 100]
    last = next(x for x in got if x["id"] == 9)
    assert [tuple(s) for s in last["spans"]] == [(2, 51), (53, 102)] and last["kept"] == "one two three"
    assert windows.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    r = random.Random(8)
    texts = [prose(r, 300), "", "w" * 5000, prose(r, 40)]
    whole = windows.word_hashes(texts)
    monkeypatch.setattr(windows, "PIECE", 100)
    parts = windows.word_hashes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
