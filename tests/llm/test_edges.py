"""Ids beside nulls, hot groups, several blocks, broken pages, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.llm import bpe, html, language, leaks, licences, quality, repeats, similar, urls, warc

from .test_operators import SCHEMA, WORDS, docs_of, plain_removal, prose

BIG = (2**60 + 1, 2**60 + 2, None)
PAGE = "page_id long, url string, html string"


def one_part(df):
    return df.coalesce(1)


# Ids over 2**53 beside a null, in one partition
def test_ids_beside_nulls_keep_their_values(spark, tmp_path):
    r = random.Random(1)
    texts = [prose(r, 60) for _ in BIG]
    docs = one_part(docs_of(spark, list(zip(BIG, texts, strict=True))))
    ids = lambda df, c="doc_id": sorted((x[c] for x in df.collect()), key=str)
    want = sorted(BIG, key=str)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert ids(licences.scan(docs)) == want
    assert ids(quality.verdicts(docs, labels)) == want
    assert ids(repeats.remove_repeats(docs)) == want
    assert ids(similar.classes(docs)) == want
    model = (["aa"], np.zeros((1, language.BUCKETS)))
    assert ids(language.identify(docs, model)) == want
    P = pytest.importorskip("public_tokenizers")
    assert ids(bpe.digest_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)) == want
    item = spark.createDataFrame([(2**60 + 7, texts[0]), (2**60 + 8, texts[1]), (3, texts[2])], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leaks.contaminated(docs, item).collect()} == {(BIG[0], 2**60 + 7), (BIG[1], 2**60 + 8), (None, 3)}
    pages = one_part(spark.createDataFrame([(i, "http://a/", "x" * 1200) for i in BIG], PAGE))
    assert ids(html.extract(pages), "page_id") == want
    got = {x["page_id"]: (x["record_type"], x["refers_to"]) for x in warc.read_members(warc.archive_pages(pages)).collect()}
    assert got == {BIG[0]: ("revisit", BIG[1]), BIG[1]: ("response", None), None: ("response", None)}
    # A repeat between the two large ids is a repeat.
    same = one_part(docs_of(spark, [(BIG[0], "k" * 75), (BIG[1], "k" * 75), (None, "k" * 75)]))
    assert {x["doc_id"]: x["n_removed"] for x in repeats.remove_repeats(same).collect()} == {BIG[0]: 0, BIG[1]: 75, None: 0}


# Empty tables
def test_empty_tables_give_empty_results(spark, tmp_path):
    docs, pages = docs_of(spark, []), spark.createDataFrame([], PAGE)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for table, name in ((labels, "labels"), (bench, "benchmark"), (docs, "documents")):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    P = pytest.importorskip("public_tokenizers")
    model = language.train(docs)
    assert model[0] == []
    for out in (
        licences.scan(docs), warc.read_members(warc.archive_pages(pages)), html.extract(pages), quality.verdicts(docs, labels), urls.judge(pages, urls.rule_table(spark)),
        repeats.remove_repeats(docs), leaks.contaminated(docs, bench), language.identify(docs, model), similar.classes(docs), bpe.digest_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    ):
        assert out.count() == 0
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # Rows, but no rules, labels, items or languages.
    some = docs_of(spark, [(1, "a b c")])
    assert [x["kept"] for x in quality.verdicts(some, labels).collect()] == [False]
    assert leaks.contaminated(some, bench).count() == 0
    assert [x["lang_pred"] for x in language.identify(some, model).collect()] == ["und"]
    bare = urls.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), urls.rule_table(spark).limit(0))
    assert [(x["rule"], x["verdict"]) for x in bare.collect()] == [(None, "allow")]


# op1
def test_every_pair_of_templates_keeps_both_labels(spark):
    texts = {}
    for label, text in licences.TEMPLATES:
        texts.setdefault(label, text.replace("|", " "))
    pairs = list(itertools.combinations(sorted(texts), 2))
    rows = [(i, f"{texts[a]}\n{texts[b]}") for i, (a, b) in enumerate(pairs)]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licences.scan(docs_of(spark, rows)).collect()}
    assert len(pairs) == 78 and all({a, b} <= got[i] for i, (a, b) in enumerate(pairs))


def test_license_scan_of_long_texts_and_clashing_columns(spark):
    rows = [(1, "word " * 60_000 + "mit license"), (1, "word " * 60_000 + "mit license")]
    docs = docs_of(spark, rows).withColumns({c: F.lit("x") for c in ("_hits", "_at", "_words", "_base", "_own", "_votes", "_places", "_good", "labels", "n_words")})
    got = [tuple(r) for r in licences.scan(docs).collect()]
    assert got == [(1, 60_002, 1, 60_000, 60_000, "mit", "mit", 1.0)] * 2


# op2
def test_archives_close_by_header_bytes(spark):
    pages = one_part(spark.range(60_000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.lit(None).cast("string").alias("html"), F.lit("x").alias("items")))
    archives = warc.archive_pages(pages)
    assert archives.count() > 1
    assert warc.read_members(archives).agg(F.countDistinct("page_id")).first()[0] == 60_000


def test_export_writes_members_and_index(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>one"), (2, "u", "<p>two")], PAGE)
    done = warc.export(warc.archive_pages(pages), f"file://{tmp_path}").collect()
    assert sum(r["records"] for r in done) == 2
    found = []
    for r in done:
        data = (tmp_path / f"{r['archive']}.warc.gz").read_bytes()
        for line in (tmp_path / f"{r['archive']}.idx").read_text().splitlines():
            _, offset, length = map(int, line.split("\t"))
            found.append(warc.split_record(zlib.decompress(data[offset : offset + length], 31))[1].split(b"\r\n\r\n")[1])
    assert sorted(found) == [b"<p>one", b"<p>two"]


# op3
ARTICLE = "<article><h1>A title</h1><p>First words of it, then some more of them. Another sentence follows here, and one more.</p><p>Second part of it, with as many words. It ends after this sentence, or the next one.</p></article>"
ARTICLE_TEXT = "A title\nFirst words of it, then some more of them. Another sentence follows here, and one more.\nSecond part of it, with as many words. It ends after this sentence, or the next one."


def text_of(page):
    field = html.train()
    return html.main_text(page, field, html.Paths(frozenset(field.names)), {})


@pytest.mark.parametrize("piece", ["<svg/>", "<math/>", "<iframe/>", "<iframe src=x>", "<select-menu>", "<title-bar>", "<style-guide></style-guide>", "<video src=x>", "<object data=x>", "<audio controls><p>", "<noscript>", "<canvas id=c>", "<script src=x />", "<!-->", "<br/>", "<div title='it>"])
def test_articles_survive_broken_markup(piece):
    assert text_of(f"<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav>{piece}{ARTICLE}<footer><p>&copy; 2020 x</p></footer></body></html>") == ARTICLE_TEXT
    assert text_of(f"<html><head><title>t</title>{piece}{ARTICLE}") == ARTICLE_TEXT


def test_pages_of_common_shapes():
    body = "<p>The river rose for three days, and on the fourth it reached the old mill. Nobody in the village had seen it so high.</p><p>By noon the bridge was closed, as the mayor had warned. People carried what they could to the church on the hill.</p>"
    plain = "The river rose for three days, and on the fourth it reached the old mill. Nobody in the village had seen it so high.\nBy noon the bridge was closed, as the mayor had warned. People carried what they could to the church on the hill."
    blog = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>x</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body class="home"><div class="site-header"><a href="/">My blog</a><ul class="menu"><li><a href="/a">About</a></li><li><a href="/b">Archive</a></li></ul></div><div id="content" class="post"><h1>Flood</h1>{body}</div><div class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div class="comments"><h3>2 comments</h3><div class="comment">Nice, thanks!</div></div><div class="footer">Copyright 2020 | <a href="/p">Privacy</a></div></body></html>'
    news = f'<html><body><header><nav><a href="/">Home</a> | <a href="/w">World</a></nav></header><div class="cookie-notice">We use cookies. <button>Accept</button></div><main><article><h1>Flood</h1>{body}</article><aside class="related"><h2>Related</h2><a href="/x">Storm</a></aside></main><form><label>Search</label><input name=q></form><footer>© News</footer></body></html>'
    wiki = f'<body><div id="top" class="header"><h2><a href="/">The village wiki</a></h2></div><ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/h">History</a></li></ul><main id=main><h1>Flood</h1>{body.replace("</p>", "")}</main><div class="ads">Buy one, get one</div><footer><ul><li><a href="/c">Contact</a></li></ul></footer>'
    for page in (blog, news, wiki):
        assert text_of(page) == "Flood\n" + plain


def test_reading_takes_time_in_proportion_to_length():
    deep = "".join(f"<div class='c{i}'>" for i in range(40_000))
    for page in ('<a "' * 250_000, "<div class='" * 90_000, deep, "<div>" * 100_000 + "</x></div>" * 50_000, "<script/>" * 100_000 + "</script>", "<iframe>" * 120_000, '<a x=">" ' * 100_000, "<video>" * 100_000 + "</video>"):
        began = time.perf_counter()
        html.leaf_blocks(page, html.Paths(frozenset()))
        assert time.perf_counter() - began < 5


def test_extraction_of_long_pages_and_clashing_columns(spark):
    page = "<article>" + "<p>Some words of a long page, which goes on. And on it goes, for very long.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page, "x", "y"), (1, "u", page, "x", "y")], PAGE + ", text string, _page string")
    got = html.extract(pages).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] == [20_000 * (len("Some words of a long page, which goes on. And on it goes, for very long.") + 1) - 1] * 2


# op4
def test_cutoffs_are_the_certified_ones_of_largest_gain():
    r = np.random.default_rng(3)
    import pandas as pd

    rows = []
    for stratum, n in (("a", 3000), ("b", 900), ("c", 100)):
        for statistic in ("x", "y"):
            for b in range(quality.GRID + 1):
                good = int(n * (0.5**b) / 2) + (1 if b in (10, 30) and n > 1000 else 0)
                rows.append((stratum, statistic, b, good, int(r.integers(0, 4))))
    bins = pd.DataFrame(rows, columns=["stratum", "statistic", "bin", "good", "bad"])
    alpha, delta, tests = 0.01, 0.05, 6

    def tail(k, n):
        return sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))

    expected = {}
    for (s, t), part in bins.groupby(["stratum", "statistic"]):
        n, options = int(part["good"].sum()), []
        for cutoff in range(quality.GRID, 0, -1):
            above = part[part["bin"] >= cutoff]
            if tail(int(above["good"].sum()), n) > delta / tests:
                break
            options.append((int(above["bad"].sum() - above["good"].sum()), cutoff))
        gain = max((g for g, _ in options), default=0)
        if gain > 0:
            expected[s, t] = max(c for g, c in options if g == gain)
    got = {(x.stratum, x.statistic): x.cutoff for x in quality.choose_cutoffs(bins, alpha, delta, tests).itertuples()}
    assert got == expected and len(got) >= 2 and not any(s == "c" for s, _ in got)


def test_certified_rules_reject_and_keep(spark):
    r = random.Random(7)
    good = [(i, prose(r, 80), "en", "s", 1) for i in range(1200)]
    bad = [(2000 + i, prose(r, 60).upper() + " " + prose(r, 20), "en", "s", 1) for i in range(200)]
    odd = [(None, prose(r, 80), None, "s", 1), (5, prose(r, 80), "en", "s", 1), (2001, bad[1][1], "en", "s", 1), (3000, prose(r, 70_000), "xx", "s", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)] + [(2000 + i, 0, 0) for i in range(200)] + [(2000, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.verdicts(spark.createDataFrame(good + bad + odd, SCHEMA), labels).collect()
    assert len(got) == 1404
    assert not any(x["kept"] for x in got if (x["doc_id"] or 0) in range(2000, 2200))
    lost = sum(not x["kept"] for x in got if x["doc_id"] is None or x["doc_id"] < 1200 or x["doc_id"] == 3000)
    assert lost == 0


# op5
def test_ties_between_rules(spark):
    rules = urls.rule_table(spark, stated=[("block", "b.net", "/a"), ("allow", "net", "/a"), ("allow", "b.net", "/a"), ("allow", "c.b.net", "/")], listed=[])
    pages = spark.createDataFrame([(1, "http://b.net/a"), (2, "http://c.b.net/a/b"), (3, "http://x.net/ab"), (1, "http://b.net/a")], "page_id long, url string").withColumns({c: F.lit("x") for c in ("digest", "prefix", "stated", "s", "p")})
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect())
    assert got == [(1, "b.net/a", "block"), (1, "b.net/a", "block"), (2, "c.b.net/", "allow"), (3, "net/a", "allow")]


# op6
def test_repeats_under_hot_anchors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_SPANS", 5)
    r = random.Random(13)
    line = "this line of some thirty bytes "
    rows = [(i, prose(r, 6) + " " + line + prose(r, 6)) for i in range(120)]
    rows += [(200 + 2 * i + k // 3, prose(r, 3) + rows[i][1][k:] + prose(r, 3)) for i in range(30) for k in (0, 3)]
    rows += [(400, line * 4), (401, line * 3), (402, (prose(r, 9) + " ") * 3)]
    docs = docs_of(spark, rows + rows[:3]).withColumns({c: F.lit("x") for c in ("tag", "home", "anchor", "span", "mark", "window")})
    got = {}
    for x in repeats.remove_repeats(docs.repartition(5)).collect():
        assert got.setdefault(x[0], tuple(x)[1:]) == tuple(x)[1:]
    assert got == plain_removal(rows)


def test_repeats_in_long_texts(spark):
    r = random.Random(14)
    long = prose(r, 250_000)
    rows = [(2, "a" + long[5_000:1_200_000]), (1, long), (None, long[:300]), (3, long[-60:]), (3, long[-70:])]
    got = repeats.remove_repeats(docs_of(spark, rows)).collect()
    size = {(x["doc_id"], x["n_bytes"]): (x["n_removed"], x["n_spans"]) for x in got}
    n = len(rows[0][1])
    assert size == {(2, n): (n - 1, 1), (1, len(long)): (0, 0), (None, 300): (0, 0), (3, 60): (60, 1), (3, 70): (70, 1)}


# op7
def test_leaks_over_several_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 3)
    r = random.Random(15)
    items = [(i, prose(r, 20 + i)) for i in range(8)] + [(0, prose(r, 3)), (1, None)]
    docs = [(10, items[3][1] + " " + prose(r, 2000) + " " + items[5][1]), (10, items[3][1]), (None, prose(r, 5) + " " + items[0][1]), (11, prose(r, 4) + " " + items[8][1] + " " + items[8][1]), (12, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = {(x["doc_id"], x["item_id"]): (x["first_word"], x["n_words"], x["similarity"]) for x in leaks.contaminated(docs_of(spark, docs).withColumn("item_id", F.lit("x")), bench).collect()}
    assert got == {(10, 3): (0, 23, 1.0), (10, 5): (2023, 25, 1.0), (None, 0): (5, 20, 1.0), (11, 0): (4, 3, 1.0)}


def test_index_of_many_items_is_small():
    r = np.random.default_rng(5)
    prints = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    index = leaks.HammingIndex(prints)
    assert sum(a.nbytes + b.nbytes for a, b in index.tables) < 30 << 20
    assert {0, 19_999} <= set(index.near(prints[[0, 19_999]])[1].tolist())


# op8
def test_held_out_is_the_crc_of_the_id(spark):
    ids = [0, 1, 17, -3, 2**60 + 1, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_mixture_matches_plain_expectation_maximisation():
    r = np.random.default_rng(9)
    logp = np.log(r.dirichlet(np.ones(language.BUCKETS) * 0.05, 3) + 1e-9)
    logp -= np.log(np.exp(logp).sum(1, keepdims=True))
    counts = np.stack([r.multinomial(n, np.exp(logp).T @ np.array(mix)) for n, mix in ((300, (1, 0, 0)), (400, (0.6, 0.4, 0)), (600, (0.3, 0.3, 0.4)), (0, (1, 0, 0)))])
    share, size = language.mixture(counts, logp)

    def fit(c, allowed):
        pi = np.array([1.0 / len(allowed) if k in allowed else 0.0 for k in range(3)])
        for _ in range(language.ROUNDS):
            total = np.zeros(3)
            for b in np.flatnonzero(c):
                w = np.exp(logp[:, b]) * pi
                total += c[b] * w / w.sum()
            pi = total / c.sum()
        return pi, sum(c[b] * math.log((np.exp(logp[:, b]) * pi).sum()) for b in np.flatnonzero(c))

    for d, c in enumerate(counts[:3]):
        alone = [(c * logp[k]).sum() for k in range(3)]
        cost = language.PENALTY * math.log(c.sum() + 1)
        best = (max(alone) - cost, np.eye(3)[int(np.argmax(alone))], 1)
        order = np.argsort(-fit(c, (0, 1, 2))[0], kind="stable")
        for k in (2, 3):
            pi, like = fit(c, order[:k].tolist())
            if like - k * cost <= best[0]:
                break
            best = (like - k * cost, pi, k)
        assert size[d] == best[2] and share[d] == pytest.approx(best[1], abs=1e-6)
    assert size.tolist() == [1, 2, 3, 0] and not share[3].any()


def test_language_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no sample table")
    docs = spark.read.parquet(path).withColumn("out", language.held_out())
    model = language.train(docs.filter("not out"))
    rows = language.identify(docs.filter("out and lang is not null and length(text) > 100"), model, keep=("lang",)).collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_language_of_ties_long_texts_and_clashing_columns(spark):
    same = (["aa", "bb"], np.full((2, language.BUCKETS), -math.log(language.BUCKETS)))
    docs = spark.createDataFrame([(1, "word " * 100_000, "x"), (1, "word", "x"), (None, "東京", "x")], "doc_id long, text string, langs string")
    assert [r["lang_pred"] for r in language.identify(docs, same).collect()] == ["aa"] * 3


# op9
def plain_sets(rows):
    key = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    words = {d: key(t) for d, t in rows}
    return {d: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for d, w in words.items()}


def check_links(spark, rows):
    sets = plain_sets(rows)
    keys = list(sets)
    near = {k: {k} for k in keys}
    for x, y in itertools.combinations(keys, 2):
        a, b = sets[x], sets[y]
        if 5 * len(a & b) >= 4 * len(a | b):
            near[x].add(y)
            near[y].add(x)
    links = {k: len({sets[n] for n in near[k]}) - 1 for k in keys}
    low = {}
    for k in sorted(keys):
        if k not in low:
            todo = [k]
            while todo:
                n = todo.pop()
                if n not in low:
                    low[n] = k
                    todo += near[n]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(docs_of(spark, rows)).collect()}
    assert got == {k: (low[k], links[k]) for k in keys}
    return got


def test_a_group_of_over_a_thousand_near_copies(spark):
    base = [prose(random.Random(16), 40).split() for _ in range(1)][0]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(1100)]
    sets = plain_sets(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(docs_of(spark, rows)).collect()}
    assert len(set(sets.values())) == 1100 and got == {i: (0, 1099) for i in range(1100)}


def test_groups_over_several_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 7)
    monkeypatch.setattr(similar, "BLOCK_BYTES", 3_000)
    r = random.Random(17)
    rows = []
    for g in range(3):
        words = prose(r, 70).split()
        for _ in range(60):
            # A chain: each text differs from the one before, so not all pairs are near.
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    rows += [(500, prose(r, 60_000)), (501, "x y")]
    assert len({c for c, _ in check_links(spark, [x for x in rows if x[0] != 501]).values()}) > 2


# op10
def test_tokens_and_their_bytes_go_round(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, None), (2, ""), (3, "naïve 東京 \x00 'll"), (3, "a b"), (4, "long text, " * 30_000)]
    docs = docs_of(spark, rows).withColumns({c: F.lit("x") for c in ("n_tokens", "ids_sha256")})
    got = bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in got) == sorted((i, (t or "").encode()) for i, t in rows)
    own = {r["ids_sha256"]: r["ids"] for r in bpe.encode_stage(spark, docs.drop("n_tokens", "ids_sha256"), "").collect()}
    assert all(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() == k for k, ids in own.items()) and len(own) == 4


def test_another_pattern_is_followed():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"b1": 257}
    e = bpe.Encoder(ranks, r"[a-z]+|\d+")
    assert e.split("ab1 ab") == ["ab", "1", "ab"] and e.encode("ab1") == [256, ord("1")]
    assert bpe.Encoder(ranks, bpe._FAST_OF).split("ab1 ab") == ["ab", "1", " ab"]


# Pipeline
def test_pipeline_takes_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(18)
    good = [prose(random.Random(200 + k), 120) for k in range(5)]
    rows = [(1, good[0]), (1, good[1]), (None, good[2]), (None, good[3]), (2**60 + 1, good[4]), (2**60 + 2, good[4] + " more"), (None, None), (3, "")]
    one_part(docs_of(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(r, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x["doc_id"]) for x in got)) == sorted(["1", "1", "None", "None", str(2**60 + 1)])
    assert all(x["n_tokens"] == len(x["ids"]) > 0 for x in got)
