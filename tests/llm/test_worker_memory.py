"""What a task holds of its texts, and what it leaves in its Python worker."""

from __future__ import annotations

import gc
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marram.llm import bpe, common

from .test_operators import docs_of


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def encoder():
    path, pattern = vocabulary()
    with open(path, "rb") as f:
        return bpe.Encoder(bpe.load_ranks(f.read()), pattern)


def test_no_encoder_outlives_its_task(spark):
    path, pattern = vocabulary()
    docs = docs_of(spark, [(k, "some words") for k in range(40)]).repartition(4)
    bpe.digest_documents(docs, path, pattern).collect()
    bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern).collect()

    def left(frames):
        gc.collect()
        for _ in frames:
            yield pd.DataFrame({"n": [sum(type(x) is bpe.Encoder for x in gc.get_objects())]})

    assert spark.range(0, 40, 1, 4).mapInPandas(left, "n long").agg(F.sum("n")).first()[0] == 0


def test_a_remembered_piece_is_small():
    e, count = encoder(), 20_000
    e.encode("warm up")
    pieces = [f"q{k:05d}xyz" for k in range(count)]
    tracemalloc.start()
    try:
        for p in pieces:
            e._piece(p)
        assert tracemalloc.get_traced_memory()[0] / count < 220
    finally:
        tracemalloc.stop()


def test_a_full_memo_changes_no_id(monkeypatch):
    text = " ".join(f"w{k % 700}x" for k in range(2000)) + " naïve 東京"
    want = encoder().digest(text)
    monkeypatch.setattr(bpe, "PIECES", 100)
    e = encoder()
    assert e.digest(text) == want and len(e.pieces) <= 100
    assert e.decode(want[0]).decode() == text


def test_an_arrow_batch_is_taken_in_slices(spark):
    limit = common.SLICE_BYTES
    rows = [(k, "é" * (limit // 100)) for k in range(300)] + [(300, "x" * (3 * limit)), (301, None), (302, "")]
    docs = docs_of(spark, rows).coalesce(1).select("doc_id", F.col("text").alias("_text"))

    def make():
        return lambda texts: {"n": [len(t) for t in texts], "held": [sum(len(t.encode()) for t in texts)] * len(texts)}

    got = common.map_texts(docs, make, {"n": "long", "held": "long"}).collect()
    assert sorted((r["doc_id"], r["n"]) for r in got) == [(k, len(t or "")) for k, t in rows]
    assert max(r["held"] for r in got if r["doc_id"] != 300) <= limit
    assert next(r["held"] for r in got if r["doc_id"] == 300) == 3 * limit
