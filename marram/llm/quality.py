"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a statistic of its text lies above a cutoff; a document goes if
any rule rejects it.  Cutoffs are chosen per stratum (language) from labelled documents, so that
all rules together reject at most ``ALPHA`` of the stratum's good documents:

1. One half of the good documents and the bad ones give a path: starting from no rule, each
   step lowers one statistic's cutoff where that catches the most bad for the fewest good.
   Along the path the rules reject more and more.
2. On the other half of the good documents, which had no part in the path, an exact binomial
   test certifies what the rules of a step reject in union.  Steps are tested in order and
   testing stops at the first that fails (fixed-sequence testing), so no correction for their
   number is due; the confidence is corrected for the number of strata.
3. Of the certified steps the one with the largest surplus of rejected bad over rejected good
   documents is used; of equal ones, the most lenient.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, chunks, discard, map_texts, materialise, mix

#: Largest certified share of good documents that all rules together may reject in one stratum.
ALPHA = 0.01
#: Chance that any certificate is wrong, over all strata.
DELTA = 0.05
#: Statistics that rules look at, each between 0 and 1.
STATISTICS = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "short_share")
#: Cutoffs are multiples of 1/GRID.
GRID = 50

_SPACE = " \t\n\v\f\r"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?#*$%&|<>{}[]=_~^\\@+")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ALPHA = _UPPER.copy()
_ALPHA[ord("a") : ord("z") + 1] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_marks", "n_short")


def text_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """Exact counts for each text, computed over the whole text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in COUNTS}
    for first, last in chunks(texts):
        part = texts[first:last]
        w = Words(part, NOT_SPACE)
        size = last - first
        per = lambda mask: np.add.reduceat(mask.astype(np.int64), w.offsets[:-1])
        inside = NOT_SPACE[w.raw] & ((w.raw & 0xC0) != 0x80)
        chars = np.concatenate(([0], np.cumsum(inside)))
        width = chars[w.end] - chars[w.start]
        grams, at = w.grams(3)
        own = mix(grams + w.doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = np.zeros(len(ranked), bool)
        if len(ranked) > 1:
            eq = ranked[1:] == ranked[:-1]
            same[1:] |= eq
            same[:-1] |= eq
        starts = at[order[same]]
        covered = np.zeros(len(w.hash) + 2, bool)
        for k in range(3):
            covered[starts + k] = True
        lines = np.zeros(size, np.int64)
        for i, t in enumerate(part):
            full = [x for x in t.split("\n") if x.strip(_SPACE)]
            lines[i] = len(full) - len(set(full))
        got = {
            "n_words": w.count,
            "word_chars": per(inside),
            "n_symbols": per(_SYMBOLS[w.raw]),
            "n_dup_lines": lines,
            "n_repeat_words": np.bincount(w.doc[covered[: len(w.hash)]], minlength=size),
            "n_upper": per(_UPPER[w.raw]),
            "n_alpha": per(_ALPHA[w.raw]),
            "n_marks": per(_MARKS[w.raw]),
            "n_short": np.bincount(w.doc[width <= 1], minlength=size),
        }
        for k, v in got.items():
            out[k][first:last] = v
    return out


def document_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and COUNTS for every row of ``docs``; a null text counts as empty."""

    return map_texts(docs.select(*keep, F.col(text).cast("string").alias("_text")), lambda: text_counts, dict.fromkeys(COUNTS, "long"))


def with_statistics(counts: DataFrame) -> DataFrame:
    """The statistics that rules test, from the counts; 0 where a text has no words."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.withColumns(
        {
            "symbol_share": F.least(F.col("n_symbols") / words / 3, F.lit(1.0)),
            "dup_line_share": F.least(F.col("n_dup_lines") * 20 / words, F.lit(1.0)),
            "repeat_share": F.col("n_repeat_words") / words,
            "upper_share": F.col("n_upper") / F.greatest("n_alpha", F.lit(1)),
            "mark_share": F.least(F.col("n_marks") / chars, F.lit(1.0)),
            "short_share": F.col("n_short") / words,
        }
    )


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), up to rounding: terms from the largest down until they are negligible."""
    if k >= n:
        return 1.0
    peak = min(k, int((n + 1) * p))
    top = math.lgamma(n + 1) - math.lgamma(peak + 1) - math.lgamma(n - peak + 1) + peak * math.log(p) + (n - peak) * math.log1p(-p)
    odds, total = p / (1 - p), 1.0
    term, i = 1.0, peak
    while i > 0 and term > 1e-18 * total:
        term *= i / ((n - i + 1) * odds)
        total, i = total + term, i - 1
    term, i = 1.0, peak
    while i < k and term > 1e-18 * total:
        term *= (n - i) * odds / (i + 1)
        total, i = total + term, i + 1
    return min(1.0, math.exp(top + math.log(total)))


def choose_cutoffs(bins: pd.DataFrame, alpha: float = ALPHA, delta: float = DELTA, tests: int | None = None, grid: int = GRID) -> pd.DataFrame:
    """Certified cutoffs from histograms (stratum, statistic, bin, good, bad).

    A row (stratum, statistic, cutoff, good_rejected, good, bad_rejected, bad, p_value)
    means: reject where the bin is at least cutoff; bins go from 0 to ``grid``.  Sequences
    without a useful certified cutoff have no row.  ``tests`` counts sequences, also those left
    out of ``bins``; by default, every statistic in each stratum of it.
    """
    out = []
    tests = tests or max(1, bins["stratum"].nunique() * len(STATISTICS))
    for (stratum, statistic), part in bins.groupby(["stratum", "statistic"], sort=True):
        good, bad = (np.zeros(grid + 1, np.int64) for _ in range(2))
        np.add.at(good, part["bin"].to_numpy(int), part["good"].to_numpy(int))
        np.add.at(bad, part["bin"].to_numpy(int), part["bad"].to_numpy(int))
        n, above_good, above_bad = int(good.sum()), np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
        best = None
        for cutoff in range(grid, 0, -1):
            p = binomial_tail(int(above_good[cutoff]), n, alpha) if n else 1.0
            if p > delta / tests:
                break
            gain = int(above_bad[cutoff] - above_good[cutoff])
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, cutoff, p)
        if best:
            _, cutoff, p = best
            out.append((stratum, statistic, cutoff, int(above_good[cutoff]), n, int(above_bad[cutoff]), int(bad.sum()), p))
    return pd.DataFrame(out, columns=["stratum", "statistic", "cutoff", "good_rejected", "good", "bad_rejected", "bad", "p_value"])


def stratum(lang: str = "lang") -> F.Column:
    return F.coalesce(F.lower(F.col(lang).cast("string")), F.lit("none"))


#: Steps of a path at most: each lowers one of the cutoffs.
STEPS = len(STATISTICS) * GRID


def path_of(bins: pd.DataFrame) -> list[tuple[str, int]]:
    """The steps (statistic, cutoff) of one stratum, from histograms (statistic, bin, good, bad).

    Each step lowers the cutoff of the statistic that gains most: the most bad documents for a
    good one, of those not yet above its cutoff.  It ends where no cutoff gains more bad than good.
    """
    count = {s: np.zeros((2, GRID + 1), np.int64) for s in STATISTICS}
    for r in bins.itertuples():
        count[r.statistic][:, r.bin] += (r.good, r.bad)
    now, steps = dict.fromkeys(STATISTICS, GRID + 1), []
    while True:
        best = None
        for s in STATISTICS:
            good, bad = (np.cumsum(c[now[s] - 1 : 0 : -1]) for c in count[s])
            gain = np.where(bad > good, bad / (good + 1), 0.0)
            if len(gain) and gain.max() > 0 and (best is None or gain.max() > best[0]):
                best = (gain.max(), s, now[s] - 1 - int(gain.argmax()))
        if best is None:
            return steps
        _, s, now[s] = best
        steps.append((s, now[s]))


def _first_steps(steps: list[tuple[str, int]]) -> list[list[int]]:
    """For each statistic and bin the first step (from 1) that rejects it, 0 if none does."""
    out = [[0] * (GRID + 1) for _ in STATISTICS]
    for k in range(len(steps), 0, -1):
        s, cutoff = steps[k - 1]
        out[STATISTICS.index(s)][cutoff:] = [k] * (GRID + 1 - cutoff)
    return out


def calibrate(stats: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """(stratum, statistic, cutoff) of the certified rules, from histograms made in Spark.

    Every language is a stratum.  Only strata with enough good documents to certify a step that
    rejects none of them reach the driver, each as len(STATISTICS) * (GRID + 1) rows and then
    STEPS + 1 rows at most; all count as tests.  Documents that fail the base rules are no part
    of the holdout: they are rejected already.  A document with several labels counts once, as
    bad if any label says so; good ones are halved by a hash of their doc_id.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    level = lambda s: F.floor(F.col(s) * GRID).cast("int")
    held = stats.filter(~base_failed()).join(marks, "doc_id")
    held = materialise(held.select("stratum", (F.col("quality") > 0).alias("ok"), (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("fit"), F.array(*[level(s) for s in STATISTICS]).alias("bins")), "quality-held")
    proof = F.col("ok") & ~F.col("fit")
    strata = held.groupBy("stratum").agg(F.count_if(proof).alias("n"))
    tests = max(1, strata.count())
    able = strata.filter(F.col("n") >= math.floor(math.log(DELTA / tests) / math.log1p(-ALPHA))).select("stratum")
    used = held.join(able, "stratum", "left_semi")
    names = F.array(*map(F.lit, STATISTICS))
    cells = used.select("stratum", "ok", "fit", F.explode(F.arrays_zip(names.alias("statistic"), F.col("bins").alias("bin"))).alias("p")).select("stratum", "ok", "fit", "p.*")
    bins = cells.groupBy("stratum", "statistic", "bin").agg(F.count_if(F.col("ok") & F.col("fit")).alias("good"), F.count_if(~F.col("ok")).alias("bad")).toPandas()
    paths = {s: path_of(part) for s, part in bins.groupby("stratum")}
    rows = [(s, _first_steps(p)) for s, p in paths.items() if p]
    none = pd.DataFrame([], columns=["stratum", "statistic", "cutoff"])
    if rows:
        firsts = held.sparkSession.createDataFrame(rows, "stratum string, firsts array<array<int>>")
        step = F.array_min(F.filter(F.zip_with("firsts", "bins", lambda f, b: F.get(f, b)), lambda k: k > 0))
        # The earlier a step rejects a document, the higher its bin in the sequence of tests.
        seen = used.join(firsts, "stratum").select("stratum", F.coalesce(F.lit(STEPS + 1) - step, F.lit(0)).alias("bin"), proof.alias("good"), (~F.col("ok")).alias("bad"))
        hist = seen.groupBy("stratum", "bin").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad")).toPandas().assign(statistic="path")
        chosen = choose_cutoffs(hist, tests=tests, grid=STEPS)
        cutoffs = {(r.stratum, s): c for r in chosen.itertuples() for s, c in paths[r.stratum][: STEPS + 1 - r.cutoff]}
        none = pd.DataFrame([(*k, c) for k, c in cutoffs.items()], columns=none.columns)
    discard(held)
    return none


def verdicts(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base verdict and final verdict for every row of ``docs``.

    Nulls: a null text counts as empty (and so fails the base rules), a null language is a
    stratum of its own, a null doc_id has no label.  Repeated rows are judged alike.
    Without labels nothing is certified and only the base rules reject; no documents give no
    rows.  A text of any length is counted whole; names of other columns do not matter.
    """
    langs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    wanted = tuple(dict.fromkeys((*keep, "doc_id")))
    counts = document_counts(langs.withColumn("_stratum", stratum()), keep=(*wanted, "_stratum"))
    stats = with_statistics(materialise(counts, "quality-counts").withColumnRenamed("_stratum", "stratum"))
    rules = calibrate(stats, labels)
    rejected = F.lit(False)
    for statistic, part in rules.groupby("statistic"):
        cutoffs = F.create_map(*[F.lit(x) for r in part.itertuples() for x in (r.stratum, int(r.cutoff))])
        rejected = rejected | F.coalesce(F.floor(F.col(statistic) * GRID) >= F.try_element_at(cutoffs, F.col("stratum")), F.lit(False))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; the columns of ``docs`` are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    # Rows are judged by text and language; a doc_id may be null or repeated.
    row = lambda text, lang: F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.coalesce(F.lower(lang.cast("string")), F.lit("none")))
    rows = docs.select(docs["doc_id"], docs["text"], lang.alias("lang"), row(docs["text"], lang).alias("_row"))
    judged = verdicts(rows, labels, keep=("doc_id", "_row")).filter("not kept").select("doc_id", "_row").distinct()
    # Sorted and merged at every size: whether the rejected ids could be sent to all depends on chance.
    return docs.join(judged.hint("merge"), docs["doc_id"].eqNullSafe(judged["doc_id"]) & (row(docs["text"], lang) == judged["_row"]), "left_anti")
