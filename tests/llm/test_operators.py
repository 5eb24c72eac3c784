"""The operators against brute force on small tables, with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marram.llm import bpe, html, induced, language, leaks, licences, quality, repeats, similar, urls, warc
from marram.llm.labelled import labelled_pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


WORDS = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(2 + i % 7)) for i in range(400)]


# op1
def test_license_scan_counts_phrases_and_takes_nulls(spark):
    rows = [(1, None), (2, ""), (3, "The MIT License, and mit-license again"), (4, "licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"), (5, "mit apache"), (5, "mit apache")]
    got = {(r["doc_id"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licences.scan(docs_of(spark, rows)).collect()}
    assert got == {(1, 0, None, None, ""), (2, 0, None, None, ""), (3, 2, 1, 4, "mit"), (4, 1, 3, 3, "apache"), (5, 0, None, None, "")}
    assert licences.scan(docs_of(spark, []).select("doc_id", "text")).count() == 0


def test_license_scan_finds_every_template_of_a_file(spark):
    texts = {label: text.replace("|", " ") for label, text in reversed(licences.TEMPLATES)}
    rows = [(0, "\n".join((texts["epl"], texts["bsd"], texts["isc"])))] + [(i, texts["bsd"] + "\n" + texts["isc"]) for i in range(1, 6)]
    rows += [(10, "\n".join(texts.values()))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(docs_of(spark, rows)).collect()}
    assert got == {0: ("bsd,epl,isc", 1.0)} | {i: ("bsd,isc", 1.0) for i in range(1, 6)} | {10: (",".join(sorted(texts)), 1.0)}
    for _, words, first, size in licences.TEMPLATE_WORDS:
        assert sum(w in licences.POSTINGS for w in words[first : first + size]) >= licences.AGREE


# op2
def test_warc_round_trip_and_revisits(spark):
    big = "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "é\r\n", "é" * 600), (7, "u", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_members(warc.archive_pages(pages)).collect()}
    size = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    refers = {1: 2, 6: 7}
    assert got == {i: (*size(t), "revisit" if i in refers else "response", refers.get(i)) for i, _, t in rows}


def test_warc_normaliser_rewrites_members():
    records = [warc.response_record(i, "http://x/", bytes([i]) * i * 100) for i in range(5)]
    sink = io.BytesIO()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    index = warc.normalise(io.BytesIO(z.compress(b"".join(records)) + z.flush()), {}, sink)
    data = sink.getvalue()
    assert [zlib.decompress(data[o : o + n], 31) for _, o, n in index] == records


# op3
def test_page_model_on_held_out_pages():
    field, paths, wrong, total = html.train(), html.Paths(), 0, 0
    for page, labels in labelled_pages(80, seed=5):
        blocks = html.leaf_blocks(page, paths)
        wrong += sum(a != b for a, b in zip(field.decode(field.scores(blocks, paths, {})), labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for _ in range(20):
        n = int(r.integers(1, 7))
        field = html.Field({}, np.zeros((0, 2)), r.normal(size=(2, 2)), r.normal(size=2))
        scores = r.normal(size=(n, 2))
        value = lambda p, s=scores, f=field: f.first[p[0]] + sum(s[t, p[t]] for t in range(len(p))) + sum(f.links[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max((tuple((k >> t) & 1 for t in range(n)) for k in range(1 << n)), key=value)
        assert tuple(field.decode(scores)) == best


def test_extraction_handles_odd_pages(spark):
    page = '<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  two,\n three words follow here.<p><b>Four five six, seven.<br></article><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<script>x"), (1, "u", page)]
    got = [tuple(r) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    text = "A & B\nOne two, three words follow here.\nFour five six, seven."
    assert sorted(got, key=repr) == sorted([(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (4, "u", "", 0)], key=repr)


def test_unclosed_and_self_closed_elements_lose_no_text():
    blocks = lambda page: [b[0] for b in html.leaf_blocks(page, html.Paths())]
    assert blocks("<html><head><title>t</title><meta charset=x><link href=y><p>One.<p>Two.") == ["One.", "Two."]
    assert blocks("<head><title>t</title>plain text<div>One.</div>") == ["plain text", "One."]
    assert blocks("<head><meta a=b>\n</head><body><p>One.") == ["One."]
    for tag in ("object", "audio", "video"):
        assert blocks(f"<div><{tag} data=x>no</div><p>One.") == ["One."]
        assert blocks(f"<div>a <{tag} data=x>no</{tag}> b</div><p>One.") == ["a b", "One."]
        assert blocks(f"<div>a <{tag} data=x><p>no</p></{tag}> b</div>") == ["a", "b"]
        assert blocks(f"<div><{tag}><{tag}>no</{tag}>no</{tag}></{tag}>One.</div>") == ["One."]
    for tag in ("svg", "math"):
        assert blocks(f"<div><{tag} viewBox='0 > 1' a=b/><p>One.</p><{tag}><path/>no</{tag}><p>Two.") == ["One.", "Two."]


# op4
def plain_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_match_brute_force(spark):
    r = random.Random(2)
    rows = [(0, None), (1, ""), (2, "a\n\na\na b a b a b"), (3, "é # <x>\vq")] + [(i, "\n".join(prose(r, r.randint(0, 9)) for _ in range(r.randint(1, 20))) * r.randint(1, 2)) for i in range(4, 40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.verdicts(docs_of(spark, rows), labels).collect()}
    for i, t in rows:
        n = plain_counts(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_binomial_tail_is_exact():
    from fractions import Fraction
    from math import comb

    for k, n in ((0, 10), (3, 40), (12, 700)):
        p = Fraction(1, 100)
        exact = float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        assert quality.binomial_tail(k, n, 0.01) == pytest.approx(exact, rel=1e-9)


def test_every_language_is_a_stratum(spark):
    rows = [(i, "a", f"l{i % 70}", "s", 1) for i in range(139)]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.verdicts(spark.createDataFrame(rows, SCHEMA), labels).select("stratum").distinct().collect()
    assert {r["stratum"] for r in got} == {f"l{k}" for k in range(70)}


def test_binomial_tail_of_large_strata():
    assert quality.binomial_tail(10**7, 10**9, 0.01) == pytest.approx(0.5, abs=1e-3)
    assert quality.binomial_tail(10**7 + 3 * 3146, 10**9, 0.01) == pytest.approx(0.99865, abs=1e-4)


# op5
def test_url_rules(spark):
    rows = [(1, "https://A.Example.NET/en/x?q"), (2, "http://x.net"), (3, "http://x.net/y"), (4, None), (5, "no"), (6, "ftp://example.com/de/"), (7, "http://notexample.com/de/"), (8, "http://a.org/fr/z#x"), (8, "http://a.org/fr/z#x")]
    got = sorted(tuple(r) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark)).select("page_id", "host", "path", F_coalesce("rule"), "verdict").collect())
    assert got == sorted([(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "x.net", "", "", "allow"), (3, "x.net", "/y", "net/", "block"), (4, "", "", "", "allow"), (5, "", "", "", "allow"), (6, "example.com", "/de/", "example.com/de/", "block"), (7, "notexample.com", "/de/", "", "allow"), (8, "a.org", "/fr/z", "org/fr/", "allow"), (8, "a.org", "/fr/z", "org/fr/", "allow")])


def F_coalesce(name):
    from pyspark.sql import functions as F

    return F.coalesce(name, F.lit("")).alias(name)


# op6
def plain_removal(rows, width=50):
    first, out = {}, {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(i, first.get(b[k : k + width], i))
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(rest).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    r = random.Random(1)
    common = "".join(r.choice("ab") for _ in range(300))
    rows = [(i, common[r.randint(0, 100) : r.randint(100, 300)] + "x" * r.randint(0, 150) + r.choice(["", "é" * 60, "ab" * 80])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 49), (103, "a" * 50), (104, "a" * 51), (105, prose(r, 80)), (106, "z " + prose(random.Random(9), 5))]
    r.shuffle(rows)
    got = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(docs_of(spark, rows).repartition(3)).collect()}
    assert got == plain_removal(rows)
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_cut_stage_keeps_columns_and_rows(spark):
    text = "A sentence that is long enough to be a repeat of sixty bytes or so."
    rows = [(1, text), (2, "new words " + text), (3, None), (4, "short")]
    got = {r["doc_id"]: r for r in repeats.cut_stage(spark, docs_of(spark, rows), "").collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"], got[4]["text"]) == (text, "new words ", None, "short")
    assert got[2]["n_chars"] == 10 and set(got[1].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


@pytest.mark.parametrize("seed", range(12))
def test_induced_sorting(seed):
    r = random.Random(seed)
    letters = r.choice([b"ab", b"a", b"abc", bytes(range(256))])
    parts = [bytes(r.choice(letters) for _ in range(r.randint(0, 150))) for _ in range(r.randint(1, 5))]
    text, width = induced.joined(parts + parts[:1]), r.choice([5, 50])
    blocks = list(induced.suffixes(text, induced.ALPHABET, width, **({} if seed % 2 else {"memory": 200, "base": 4})))
    at, shared = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
    keys = [tuple(text[i : i + width].tolist()) for i in at]
    assert sorted(at.tolist()) == list(range(len(text))) and keys == sorted(keys)
    for a, b, s in zip(keys, keys[1:], shared[1:].tolist(), strict=False):
        assert s == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# op7
def test_leaks_match_brute_force(spark):
    r = random.Random(4)
    items = [(i, prose(r, n)) for i, n in enumerate((14, 14, 20, 33, 59, 3))] + [(90, None), (91, ""), (92, "!?")]
    docs = [(i, prose(r, r.randint(0, 60))) for i in range(40)]
    for k in range(30):
        words = items[k % 6][1].split()
        if k % 3 and len(words) > 5:
            words[r.choice([0, 1, -1, len(words) // 2])] = "changed"
        docs.append((100 + k, prose(r, r.randint(0, 30)) + " " + " ".join(words).upper() + ", " + prose(r, r.randint(0, 30))))
    docs += [(200, None), (201, "")]
    key = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    expected = {}
    for i, t in items:
        own = key(t)
        for d, text in docs:
            words = key(text)
            for s in range(len(words) - len(own) + 1 if own else 0):
                window = words[s : s + len(own)]
                a, b = (Counter(grams(w)) if len(own) >= 5 else Counter([tuple(w)]) for w in (own, window))
                score = sum((a & b).values()) / sum((a | b).values())
                if score >= 0.8 and score > expected.get((d, i), (0, 0))[1]:
                    expected[d, i] = (s, score)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], pytest.approx(r["similarity"])) for r in leaks.contaminated(docs_of(spark, docs), bench).collect()}
    assert got == expected and len(got) > 10
    assert leaks.contaminated(docs_of(spark, docs), bench.limit(0)).count() == 0


def test_documents_shorter_than_an_item_are_one_window(spark):
    r = random.Random(12)
    items = [(i, prose(r, n)) for i, n in enumerate((5, 6, 9, 16, 30, 56, 56))]
    docs = []
    for _, t in items:
        own = t.split()
        for head in range(8):
            docs += [(len(docs) + k, " ".join(own[head : len(own) - tail])) for k, tail in enumerate(range(8))]
    grams = lambda t: Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    expected = {}
    for i, t in items:
        for d, text in docs:
            a, b = grams(t), grams(text)
            if len(text.split()) <= len(t.split()) and 5 * (a & b).total() >= 4 * (a | b).total():
                expected[d, i] = (0, len(text.split()), pytest.approx((a & b).total() / (a | b).total()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in leaks.contaminated(docs_of(spark, docs), bench).collect()}
    assert got == expected and len(got) > 100


def test_hamming_index_finds_all_within_radius():
    r = np.random.default_rng(1)
    prints = r.integers(0, 1 << 63, 50, dtype=np.uint64)
    queries = prints[:20].copy()
    for k in range(20):
        for b in r.choice(64, int(r.integers(0, leaks.RADIUS + 4)), replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(b)
    q, p = leaks.HammingIndex(prints).near(queries)
    every = {(i, j) for i in range(20) for j in range(50) if bin(int(queries[i] ^ prints[j])).count("1") <= leaks.RADIUS}
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == every


# op8
def test_language_mixture(spark):
    r = random.Random(3)
    sounds = {"aa": "the ing and of er", "bb": "der ung sch und ein", "cc": "les eau que ment ou"}
    make = lambda lang, n: " ".join("".join(r.choice(sounds[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = [(i, make(lang, 60), lang) for i, lang in enumerate(list(sounds) * 10)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.train(docs)
    test = [(1, make("aa", 40)), (2, make("bb", 40)), (3, make("cc", 60) + " " + make("aa", 30)), (4, None), (5, "12 !"), (6, "")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["aa", "bb", "cc", "und", "und", "und"]
    assert got[3]["langs"] == ["cc", "aa"] and got[4]["score"] == 0


# op9
def test_similar_classes_match_brute_force(spark):
    r = random.Random(5)
    base = [prose(r, n) for n in (12, 30, 80, 80, 200)]
    rows, i = [], 0
    for text in base:
        for _ in range(8):
            words = text.split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One, two!"), (904, "?!"), (905, rows[0][1])]
    key = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    sets = {}
    for d, t in rows:
        w = key(t)
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    text_of = dict(rows)
    for a in sets:
        for b in sets:
            same = sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or not sets[a] and not sets[b] and (text_of[a] or "") == (text_of[b] or "")
            if a < b and same:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in similar.classes(docs_of(spark, rows)).collect()}
    assert got == {d: find(d) for d in sets}
    kept = {r["doc_id"] for r in similar.distinct_stage(spark, docs_of(spark, rows), "").collect()}
    assert kept == {find(d) for d in sets}


# op10
def test_bpe_equals_the_library(spark):
    import tiktoken

    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    rows = [(0, None), (1, ""), (2, "a" * 3000), (3, "naïve 東京 🙂 x  \n\n y"), (4, "\x00\xff ' 's 'S")] + [(i, "".join(r.choice("ab é東 \n'st1.") for _ in range(r.randint(1, 200)))) for i in range(5, 60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digest_documents(docs_of(spark, rows), path, P.PATTERN).collect()}
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    from pyspark.sql import functions as F

    r = random.Random(11)
    rows = [(i, prose(r, 80)) for i in range(4)]
    names = ("gone", "_id", "_tag", "_left", "_text", "tag", "kept", "n_words", "rep", "item_id", "stratum", "quality", "root", "block", "node", "a.b", "_left")
    docs = docs_of(spark, rows)
    for n in names:
        docs = docs.withColumn(n, F.lit("x"))
    spark.createDataFrame([(0, prose(r, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (quality.filter_stage, similar.distinct_stage, repeats.cut_stage, leaks.clean_stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 4, stage


def test_stages_keep_clean_rows_of_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(21)
    clean, item = [prose(random.Random(300 + k), 90) for k in range(6)], prose(r, 30)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda df: sorted(x["text"] or "" for x in df.collect())
    whole = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3])]
    for stage, bad in ((quality.filter_stage, "too short"), (leaks.clean_stage, prose(r, 20) + " " + item)):
        got = stage(spark, docs_of(spark, whole + [(None, bad), (7, bad)]), str(tmp_path))
        assert texts(got) == sorted(clean[:4]), stage
    # A copy of a numbered document without an id, one of another class under the same id, copies without any id.
    rows = whole + [(1, clean[4]), (None, clean[4]), (7, clean[4]), (None, clean[1]), (None, clean[5] + " more"), (None, clean[5]), (None, None), (None, "")]
    got = texts(similar.distinct_stage(spark, docs_of(spark, rows), str(tmp_path)))
    assert len(got) == 7 and set(got) > {"", *clean[:5]} and got.count(clean[1]) == 1
    found = similar.classes(docs_of(spark, rows))
    assert found.columns == ["doc_id", "class_id", "n_links", "n_copies"] and found.count() == len(rows)
    assert sum(x["n_links"] for x in found.collect()) == 2


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    # With the source's own columns; one pair of near copies, one leak, one short text.
    good = [prose(random.Random(100 + k), 120) for k in range(6)]
    leak = prose(r, 30)
    rows = list(enumerate(good)) + [(10, good[0] + " more"), (11, good[1][:200] + " " + leak + " " + good[2][-200:] + prose(r, 60)), (12, "too short"), (13, None)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 1, 2, 3, 4, 5}
