"""Language identification as a mixture of languages.

Each language is a distribution over hashed character trigrams, counted over every training
document.  A document is a mixture of languages; expectation-maximisation estimates their
proportions from its trigrams.  Sets of languages, from the likeliest alone to more in the
order of their proportions, are compared by penalised likelihood, and the largest share of
the chosen set is the prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_texts

#: Trigrams are hashed into this many classes.
BUCKETS = 8192
#: Added to each count of a trigram class in a language.
PRIOR = 0.5
ROUNDS = 12
#: A further language must raise the log-likelihood by this many times log(trigrams).
PENALTY = 2.0
#: Languages that a model may have (32 KB each); more are an error, none is dropped.
MOST = 1000
#: A batch holds this many documents at most, so that counts per batch stay under 10 MB.
BATCH = 128

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts (texts x BUCKETS) of trigrams of letters and word borders, lower-cased."""
    joined = "\n".join(texts).lower() if all(len(t.lower()) == len(t) for t in texts) else "\n".join(t.lower() for t in texts)
    sizes = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letter_table()[codes]
    codes = np.where(is_letter, codes, 0).astype(np.uint32)
    padded = np.concatenate(([np.uint32(0)], codes, [np.uint32(0)]))
    mixed = padded[:-2] * np.uint32(2654435761) ^ padded[1:-1] * np.uint32(2246822519) ^ padded[2:] * np.uint32(3266489917)
    bucket = (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(codes)]
    key = owner[is_letter] * BUCKETS + bucket[is_letter]
    return np.bincount(key, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def _batches(texts: list[str]):
    for first, last in chunks(texts):
        for at in range(first, last, BATCH):
            yield at, min(at + BATCH, last)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (languages x BUCKETS) from all of ``docs``.

    Tasks add up their documents and pass on one count a language and trigram class; the
    sums that reach the driver have BUCKETS rows a language, and more than MOST languages are
    an error.  Rows with a null text or language teach nothing; without rows there are no
    languages.
    """

    def run(frames):
        total: dict[str, np.ndarray] = {}
        for pdf in frames:
            texts = list(pdf["_text"])
            for first, last in _batches(texts):
                counts = trigram_counts(texts[first:last])
                names = pdf["_lang"].iloc[first:last].to_numpy()
                for name in set(names):
                    total[name] = total.get(name, 0) + counts[names == name].sum(0)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": counts[at]})

    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")).filter("_text is not null and _lang is not null")
    found = rows.select("_lang").distinct().limit(MOST + 1).count()
    if found > MOST:
        raise ValueError(f"more than {MOST} languages: the model would outgrow a broadcast")
    sums = rows.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"]
    counts += PRIOR
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if len(langs) else counts


def mixture(counts: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: proportions (documents x languages) of the chosen set, and its size.

    A document without letters has proportions 0 and size 0.
    """
    docs, langs = len(counts), len(logp)
    share, size = np.zeros((docs, langs)), np.zeros(docs, int)
    owner, bucket = np.nonzero(counts)
    if not len(owner) or not langs:
        return share, size
    c = counts[owner, bucket].astype(float)
    has, first = np.unique(owner, return_index=True)
    row = np.searchsorted(has, owner)
    n = np.add.reduceat(c, first)
    lp = logp[:, bucket].T
    alone = np.add.reduceat(c[:, None] * lp, first)
    p = np.exp(lp - lp.max(1, keepdims=True))
    base = np.add.reduceat(c * lp.max(1), first)

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            w = p * pi[row]
            pi = np.add.reduceat(w * (c / w.sum(1))[:, None], first) / n[:, None]
        return pi, base + np.add.reduceat(c * np.log((p * pi[row]).sum(1)), first)

    best = np.zeros((len(has), langs))
    top = alone.argmax(1)
    best[np.arange(len(has)), top] = 1
    score, chosen = alone.max(1) - PENALTY * np.log(n + 1), np.ones(len(has), int)
    if langs > 1:
        full, _ = fit(np.ones((len(has), langs)))
        order = np.argsort(-full, axis=1, kind="stable")
        for k in range(2, langs + 1):
            allowed = np.zeros((len(has), langs))
            np.put_along_axis(allowed, order[:, :k], 1, 1)
            pi, like = fit(allowed)
            like = like - k * PENALTY * np.log(n + 1)
            better = like > score
            if not better.any():
                break
            best[better], score[better], chosen[better] = pi[better], like[better], k
    share[has], size[has] = best, chosen
    return share, size


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, langs (the chosen set) and shares for every row.

    A null text, a text without letters, or a model without languages gives ``und`` with
    score 0.  Of languages with equal shares the first by name is predicted.  Rows are
    independent: repeated ones and null doc_ids are answered alike, a text of any length is
    counted whole.  The model has BUCKETS numbers a language and MOST languages, so its
    broadcast is bounded.
    """
    langs, logp = model
    sent = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))

    def make():
        table = sent.value.astype(float)

        def run(texts: list[str]) -> dict:
            pred, score, names, shares = [], [], [], []
            for first, last in _batches(texts):
                share, _ = mixture(trigram_counts(texts[first:last]), table)
                for row in share:
                    own = np.flatnonzero(row > 0)
                    own = own[np.argsort(-row[own], kind="stable")]
                    pred.append(langs[own[0]] if len(own) else "und")
                    score.append(min(1.0, float(row[own[0]])) if len(own) else 0.0)
                    names.append([langs[i] for i in own])
                    shares.append([float(row[i]) for i in own])
            return {"lang_pred": pred, "score": score, "langs": names, "shares": shares}

        return run

    fields = {"lang_pred": "string", "score": "double", "langs": "array<string>", "shares": "array<double>"}
    return map_texts(docs.select(*keep, F.col(text).cast("string").alias("_text")), make, fields)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = train(docs.filter("not held_out"))
    return identify(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
