"""Neighbours in one order, exact ranks, merged heads, white space, labels and digests."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from marram.functions import scalars as S
from marram.operators import feeds as E
from marram.operators import ordered as O
from marram.operators import reports as R

ENTRY = "id long, state string, issue_kind string, confidence_label string, candidate_source string, import_session_id int"


def plain_neighbours(rows):
    out = {}
    for k, r in enumerate(rows):
        later = [x["id"] for x in rows[k + 1 :] if x["state"] in E.UNREVIEWED]
        out[r["id"]] = (rows[k - 1]["id"] if k else None, rows[k + 1]["id"] if k + 1 < len(rows) else None, later[0] if later else None)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_neighbours_follow_the_inbox_across_ranges(spark, parts):
    r = random.Random(parts)
    rows = [(i * 3 - 50, r.choice([*E.STATE_RANK, "odd"]), r.choice((None, None, "task")), "High confidence", r.choice(("a", None)), None) for i in range(60)]
    table = spark.createDataFrame(rows, ENTRY)
    for filters in ({}, {"source": "a"}, {"states": ["applied"]}, {"states": ["ready", "failed", "odd"]}):
        inbox = E.selected(table, **filters).orderBy(*E.INBOX_ORDER).collect()
        want = plain_neighbours(inbox)
        got = O.neighbours_in_order(E.selected(table, **filters), E.INBOX_ORDER, "id", F.col("state").isin(*E.UNREVIEWED), parts)
        assert {x["id"]: tuple(x)[1:] for x in got.collect()} == want
        some = inbox[len(inbox) // 2]["id"]
        assert E.neighbours_of(table, some, **filters) == want[some]
    with pytest.raises(ValueError, match="not in the selected inbox"):
        E.neighbours_of(table, rows[0][0], source="nobody")
    assert E.inbox_neighbours(table.limit(0)).count() == 0


def test_long_orders_take_time_in_proportion(spark):
    rows = spark.range(64_000).select("id", F.lit("k").alias("key"), (F.col("id") % 1000 != 7).alias("reviewed")).withColumn("state", F.when(F.col("reviewed"), "applied").otherwise("ready"))
    began = time.perf_counter()
    got = O.neighbours(rows, "key", [F.asc("id")], "id", F.col("reviewed"))
    assert got.filter("next_open_id is null").count() == 64_000 - 63_007
    assert O.neighbours_in_order(rows, ["id"], "id", F.col("state") == "ready").filter("next_open_id is null").count() == 64_000 - 63_007
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize(("cells", "ranked"), [(4, 3), (64, 10), (64, 100_000)])
def test_ranks_are_exact_for_hot_keys_and_values(spark, monkeypatch, cells, ranked):
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "RANKED", ranked)
    r = random.Random(cells)
    values = {"hot": [r.gauss(0, 9) for _ in range(900)], "same": [5.0] * 300, "steps": [float(r.choice((1, 2, 2, 2, 9))) for _ in range(300)], "few": [3.0, 1.0], "one": [4.0], "nulls": [None] * 50 + [1.0], "mixed": [None] * 3 + [1.0, float("inf"), float("-inf"), float("nan"), float("nan")] * 2, None: [2.0, 8.0, 5.0]}
    rows = [(k, v) for k, own in values.items() for v in own]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "key string, value double").repartition(5)
    order = lambda v: (v is not None, v is not None and v != v, v if v is not None and v == v else 0.0)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {x["key"]: x["p"] for x in R.nearest_rank(table, "key", "value", share).collect()}
        want = {k: sorted(own, key=order)[min(int(len(own) * share), len(own) - 1)] for k, own in values.items()}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    assert R.nearest_rank(table.limit(0), "key", "value").count() == 0


@pytest.mark.parametrize("limit", [3, 10, 200])
def test_interleaving_reads_on_where_heads_repeat(spark, limit):
    r = random.Random(limit)
    # The first rows of all sources are the same few items.
    rows = [(s, p, r.randrange(3) if p < 40 else p) for s in ("a", "b", "c") for p in range(r.randint(50, 70))]
    table = spark.createDataFrame(rows, "source string, position int, item int")
    order, seen, want = {"a": 0, "b": 1, "c": 2}, set(), []
    lists = {s: [x for x in sorted(rows) if x[0] == s] for s in order}
    for turn in range(70):
        for s in order:
            if turn < len(lists[s]) and lists[s][turn][2] not in seen and len(want) < limit:
                seen.add(lists[s][turn][2])
                want.append((s, lists[s][turn][2]))
    got = O.interleave(table, "source", "position", order, ["item"], limit)
    assert [(x["source"], x["item"]) for x in got.collect()] == want


def test_white_space_of_any_kind_is_blank(spark):
    texts = [None, "", " ", "\t", "\n\r", " ", "  　", "\x1f", "\x85", " a ", "\ta\n", "​"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {x["id"]: (x["b"], x["s"]) for x in rows.select("id", R.blank(F.col("t")).alias("b"), S.stripped(F.col("t")).alias("s")).collect()}
    assert got == {i: (t is None or not t.strip(), None if t is None else t.strip()) for i, t in enumerate(texts)}
    table = spark.createDataFrame([(1, "\tA ", "b\n"), (2, "a", "B"), (3, "\t", "b"), (4, "x", "y")], "id long, artist string, title string")
    assert {tuple(x) for x in R.exact_duplicate_rows(table).collect()} == {("a", "b", 1), ("a", "b", 2)}


def test_digests_do_not_depend_on_the_order_of_maps(spark):
    rows = spark.range(1).select(F.expr("map('b', map('y', 1, 'x', 2), 'a', null)").alias("m"), F.expr("array(map('k', 1, 'j', 2))").alias("l"), F.expr("named_struct('q', map(2, 'two', 1, 'one'))").alias("s"))
    other = spark.range(1).select(F.expr("map('a', null, 'b', map('x', 2, 'y', 1))").alias("m"), F.expr("array(map('j', 2, 'k', 1))").alias("l"), F.expr("named_struct('q', map(1, 'one', 2, 'two'))").alias("s"))
    one, two = (df.select(S.digest(df, "m", "l", "s")).first()[0] for df in (rows, other))
    assert one == two != other.select(S.digest(other, "l", "m", "s")).first()[0]
    empty = spark.createDataFrame([(None, None)], "m map<string,int>, n int")
    assert empty.select(S.digest(empty, "m", "n")).first()[0] is not None


def test_labels_of_audio_files(spark):
    names = ["a.mp3", "a.FLAC", "a.ogg", "a.opus", "a.m4a", "a.wav", "a.aiff", "a.aif", "a.aac", "a.mp4", "a", ".mp3"]
    got = [x[0] for x in spark.createDataFrame([(n,) for n in names], "p string").select(S.format_label(F.col("p"))).collect()]
    assert got == ["MP3", "FLAC", "OGG", "Opus", "MP4", "WAV", "AIFF", "AIFF", None, None, None, None]
