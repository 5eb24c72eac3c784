"""What all rules of a stratum reject together is certified."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from marram.llm import quality

from .test_operators import SCHEMA, prose


def test_paths_lower_one_cutoff_a_step_where_it_gains():
    r = random.Random(5)
    rows = [(s, b, r.randint(0, 60 - b), r.randint(0, b)) for s in quality.STATISTICS[:3] for b in range(quality.GRID + 1)]
    steps = quality.path_of(pd.DataFrame(rows, columns=["statistic", "bin", "good", "bad"]))
    now = dict.fromkeys(quality.STATISTICS, quality.GRID + 1)
    for s, cutoff in steps:
        inside = [(g, x) for t, b, g, x in rows if t == s and cutoff <= b < now[s]]
        assert 1 <= cutoff < now[s] and sum(x for _, x in inside) > sum(g for g, _ in inside)
        now[s] = cutoff
    assert len({s for s, _ in steps}) == 3
    firsts = quality._first_steps(steps)
    for k, s in enumerate(quality.STATISTICS):
        for b in range(quality.GRID + 1):
            assert firsts[k][b] == next((n for n, (t, c) in enumerate(steps, 1) if t == s and b >= c), 0)


def test_rules_together_reject_few_good_documents(spark):
    r = random.Random(7)
    # Each rule alone rejects under ALPHA of the good documents, all six together far more.
    odd = {"upper": lambda t: t.upper(), "marks": lambda t: t.replace(" ", " !?{}[]~ "), "short": lambda t: " ".join(t.replace(" ", ""))}
    good, bad = [], []
    for i in range(3000):
        kind = ("upper", "marks", "short")[i % 3] if i % 100 < 3 else None
        good.append((i, odd[kind](prose(r, 70)) if kind else prose(r, 70), "en", "s", 1))
    for i in range(3000, 3300):
        bad.append((i, odd[("upper", "marks", "short")[i % 3]](prose(r, 70)), "en", "s", 1))
    labels = spark.createDataFrame([(x[0], 1, 0) for x in good] + [(x[0], 0, 0) for x in bad], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(good + bad, SCHEMA)
    # Those that the base rules reject are no part of the certificate.
    got = {x["doc_id"]: x["kept"] for x in quality.verdicts(docs, labels).collect() if not x["base_failed"]}
    own = [k for i, k in got.items() if i < 3000]
    assert len(own) > 2900 and own.count(False) / len(own) <= quality.ALPHA
    assert sum(not k for i, k in got.items() if i >= 3000) <= 100
    # Where the good documents are clean, all three kinds are caught.
    clean = spark.createDataFrame([(i, prose(r, 70), "en", "s", 1) for i in range(3000)] + bad, SCHEMA)
    kept = {x["doc_id"]: x["kept"] for x in quality.verdicts(clean, labels).collect()}
    assert all(kept[i] for i in range(3000)) and not any(kept[i] for i in range(3000, 3300))


def test_counts_of_the_union_equal_a_plain_pass(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(50, 90)) if i % 9 else prose(r, 30).upper() + " ! ! ! " * r.randint(0, 20), r.choice(("EN", "en", "fr")), "s", 1) for i in range(2400)]
    marks = {i: int(i % 9 > 0) for i in range(2400) if i % 7}
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
    stats = quality.with_statistics(quality.document_counts(docs.withColumn("_stratum", quality.stratum()), keep=("doc_id", "_stratum")).withColumnRenamed("_stratum", "stratum"))
    half = {x["doc_id"]: x["h"] for x in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("h")).collect()}
    cells = {x["doc_id"]: (x["stratum"], {s: int(x[s] * quality.GRID) for s in quality.STATISTICS}) for x in stats.filter(~quality.base_failed()).collect() if x["doc_id"] in marks}
    want, tests = {}, len({s for s, _ in cells.values()})
    for stratum in ("en", "fr"):
        own = {i: c for i, (s, c) in cells.items() if s == stratum}
        bins = [(s, c[s], int(marks[i] and half[i]), int(not marks[i])) for i, c in own.items() for s in c]
        steps = quality.path_of(pd.DataFrame(bins, columns=["statistic", "bin", "good", "bad"]))
        proof = [c for i, c in own.items() if marks[i] and not half[i]]
        best, cut = (0, None), {}
        for s, cutoff in steps:
            cut = cut | {s: cutoff}
            out = lambda c, cut=cut: any(c[t] >= v for t, v in cut.items())
            lost = sum(map(out, proof))
            if quality.binomial_tail(lost, len(proof), quality.ALPHA) > quality.DELTA / tests:
                break
            gain = sum(out(c) for i, c in own.items() if not marks[i]) - lost
            if gain > best[0]:
                best = (gain, cut)
        want |= {(stratum, s): c for s, c in (best[1] or {}).items()}
    got = {(x.stratum, x.statistic): x.cutoff for x in quality.calibrate(stats, labels).itertuples()}
    assert got == want and got
