"""The positional index against scanning every row, through changes and merges of segments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marram.operators import catalog as C
from marram.operators import search_index as I

ROW = "id long, title string, artist string, place string, at int"
WORDS = ["so", "what", "blue", "Bjork", "Björk", "AC-DC", "東京", "l'été", "x1", "so so"]


def text(r):
    return r.choice((None, "", " - ", *[" ".join(r.choice(WORDS) for _ in range(r.randint(1, 6))) for _ in range(8)]))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, a, b, "p", 3) for i, (a, b) in rows.items()], ROW)


PHRASES = ["so", "so so", "so so so", "so what", "blue bjork", "BJÖRK", '"AC-DC"', "dc ac", "東京 so", "l ete", "nothing", "so nothing", "--", "x1 x1"]


def check(spark, index, rows):
    table = rows_of(spark, rows)
    for q in PHRASES:
        want = {x["id"] for x in table.filter(C.phrase(q, ("title", "artist"))).collect()}
        assert {x["id"] for x in index.search(q).collect()} == want, q
    assert index.search("  ") is None


@pytest.mark.parametrize("most", [2, 8])
def test_searches_equal_scans_through_changes(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(I, "MAX_SEGMENTS", most)
    r = random.Random(most)
    index = I.PhraseIndex(spark, f"file://{tmp_path}/i", ("title", "artist"), buckets=8)
    assert index.search("so").count() == 0
    rows = {i: (text(r), text(r)) for i in range(60)}
    index.update(rows_of(spark, rows).repartition(4))
    check(spark, index, rows)
    for _ in range(2):
        changed = {i: (text(r), text(r)) for i in r.sample(range(80), 15)}
        gone = [i for i in r.sample(sorted(rows), 6) if i not in changed]
        index.update(rows_of(spark, changed), removed=spark.createDataFrame([(i,) for i in gone], "id long"))
        rows = {i: t for i, t in (rows | changed).items() if i not in gone}
    check(spark, index, rows)
    assert len(index.segments()) == (3 if most == 8 else 1) and index.version() == 3
    # Nothing to do makes no version.
    index.update(rows_of(spark, {}))
    assert index.version() == 3


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path):
    index = I.PhraseIndex(spark, f"file://{tmp_path}/i", ("title",), buckets=16)
    rows = spark.range(400).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("title"))
    index.update(rows)
    every = {f.split("/bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{index.segments()[0]}/postings").inputFiles()}
    assert len(every) == 16
    scanned = spark.range(1).select(*[index._bucket(F.lit(w)).alias(w) for w in ("all", "w7")]).first()
    got = index.postings(["all", "w7"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(x["f"].split("/bucket=")[1].split("/")[0]) for x in got} == set(scanned)
    plan = index.postings(["all", "w7"])._jdf.queryExecution().executedPlan()
    assert plan.toString().count("PartitionFilters: [bucket") == 1
    assert [x["id"] for x in index.search("all w7").collect()] == [7]
    assert index.search("all").count() == 400


def test_postings_are_sorted_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCKS_A_TASK", 16)
    index = I.PhraseIndex(spark, f"file://{tmp_path}/i", ("title",), buckets=4)
    rows = spark.range(0, 3000, 1, 2).select("id", F.concat_ws(" ", F.lit("all of all"), F.concat(F.lit("w"), (F.col("id") % 5).cast("string"))).alias("title"))
    index.update(rows)
    stored = spark.read.parquet(f"{index.segments()[0]}/postings")
    # 15,000 places of 7 words in blocks of I.BLOCK, and no file of more blocks than a task sorts.
    assert stored.count() < 200 and stored.agg(F.max(F.size("at"))).first()[0] <= I.BLOCK + 1
    assert stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 40
    assert index.search("all of all w3").count() == 600 and index.search("of all all").count() == 0
    got = {(x["token"], x["id"]): x["at"] for x in index.postings(["all", "w0"]).filter("id in (10, 11)").collect()}
    assert got == {("all", 10): [0, 2], ("all", 11): [0, 2], ("w0", 10): [3]}


def test_words_of_plain_and_marked_texts(spark):
    texts = ["AC-DC  Live!", "", " ", "Björk BJÖRK", "Á", "東京 so", "l'Été x1", "\tTab\x00nul", None, "İstanbul"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.trim(C.tokens(F.col("t"))).alias("w"))
    assert {x["t"]: x["w"] for x in df.collect()} == {t: None if t is None else " ".join(C.wanted_words(t) or []) for t in texts}
