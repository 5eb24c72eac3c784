"""Benchmark leaks whose shingles repeat, against comparing every window."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.llm import leaks

from .test_operators import docs_of, prose

VOCABULARY = [f"w{i}" for i in range(5000)]


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_fingerprints_count_occurrences_as_a_set():
    r = random.Random(4)
    for _ in range(60):
        grams = np.array([r.randrange(4) for _ in range(30)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n = r.randint(1, 30)
        got = leaks.simhash(grams, np.arange(len(grams) - n + 1), n)
        for start, own in enumerate(got):
            seen, total = Counter(), np.zeros(64, int)
            for g in grams[start : start + n]:
                seen[g] += 1
                total += leaks._numbered(np.array([g]), np.array([seen[g]]))[0]
            assert int(own) == sum(1 << b for b in range(64) if total[b] > 0)


@pytest.mark.parametrize(("plain", "again"), [(200, 15), (300, 25)])
def test_no_leak_with_a_repeated_word_is_missed(plain, again):
    r = random.Random(plain)
    for case in range(100):
        item = [r.choice(VOCABULARY) for _ in range(plain)] + ["again"] * (again + 4)
        copy, spots = item[:], list(range(10, plain - 10, 12))
        r.shuffle(spots)
        for at in spots:
            longer = [*copy[:at], f"other{at}", *copy[at + 1 :]]
            if similarity(bag(item), bag(longer)) < 0.8:
                break
            copy = longer
        assert similarity(bag(item), bag(copy)) < 0.84
        text = " ".join([f"a{case}b{i}" for i in range(40)] + copy + [f"c{i}" for i in range(40)])
        assert [x[1] for x in leaks.find([text], leaks.Items([7], [" ".join(item)]))] == [7]


def test_repeated_shingles_match_brute_force(spark):
    r = random.Random(9)
    refrain = prose(r, 6)
    items = {i: " ".join(r.choice((prose(r, 12), refrain, refrain, "so so so so so so so")) for _ in range(r.randint(3, 9))) for i in range(12)}
    docs = []
    for d in range(60):
        words = items[r.randrange(12)].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "changed"
        docs.append((d, " ".join([prose(r, r.randint(0, 15)), *words, prose(r, r.randint(0, 15))])))
    want = {}
    for d, text in docs:
        words = text.split()
        for i, item in items.items():
            own, n = bag(item.split()), len(item.split())
            wide = min(n, len(words))
            best = max(((similarity(own, bag(words[k : k + wide])), -k) for k in range(len(words) - wide + 1)), default=(0, 0))
            if best[0] >= 0.8:
                want[d, i] = (-best[1], pytest.approx(best[0]))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("similarity", F.lit(1))
    got = {(x["doc_id"], x["item_id"]): (x["first_word"], x["similarity"]) for x in leaks.contaminated(docs_of(spark, docs), bench).collect()}
    assert got == want and len(got) > 20


def test_long_items_are_taken_in_blocks_of_characters(spark, monkeypatch):
    r = random.Random(6)
    items = [(i, prose(r, 40)) for i in range(9)]
    docs = docs_of(spark, [(i, prose(r, 5) + " " + t) for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leaks, "ITEM_CHARS", 300)
    assert {(x["doc_id"], x["item_id"]) for x in leaks.contaminated(docs, bench).collect()} == {(i, i) for i, _ in items}
