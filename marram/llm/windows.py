r"""Repeated word passages: Rabin-Karp hashes of every window of words, counted in Spark.

1. Documents are packed into chunks (compressed, one row each), which is all that is sent of
   the texts afterwards.
2. Every window of ``WIDTH`` words gets two 64-bit Rabin-Karp hashes from running sums.  Of
   equal windows a chunk sends the first alone, so a passage that a third of all documents
   hold costs one hash a chunk.  The second hash deals windows into buckets of about
   ``BUCKET`` windows; the number of buckets grows with the input, a bucket does not.
3. A bucket counts its hashes and finds the first occurrence of those that repeat, by doc_id
   and start; each chunk is told, a bit a window, which of its own are not the first.
4. Chunks meet their answers, hash again, and merge windows that repeat into maximal intervals
   of words.

Windows are told apart by 72 bits and the bucket's number: two of 10**13 different windows
share them with a chance of about 0.01.
"""

from __future__ import annotations

import hashlib
import os
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, materialise, mix, powers

#: Words of a window.
WIDTH = 20
#: Characters of a chunk and of a piece of a long text; windows of a bucket.
CHUNK, PIECE, BUCKET = 2_000_000, 1_000_000, 1_000_000
_LAST = 2**63 - 1
_OTHER = np.uint64(0xA24BAED4963EE407)
_SPACE = " \t\n\v\f\r"


def _pieces(text: str):
    """A long text in pieces of about PIECE characters, cut beside white space."""
    at = 0
    while len(text) - at > PIECE:
        to = at + PIECE
        while to < len(text) and text[to] not in _SPACE:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text."""
    hashes, count = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    held, owner, size = [], [], 0

    def settle():
        w = Words(held, NOT_SPACE)
        hashes.append(w.hash)
        np.add.at(count, np.array(owner), w.count)
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= PIECE:
                settle()
                size = 0
    if held:
        settle()
    return np.concatenate(hashes), count


def window_hashes(words: np.ndarray, count: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the first word of each window of ``width`` words that lies within a text."""
    m = len(words) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.flatnonzero(owner[:m] == owner[width - 1 :])
    up, down = powers(len(words) + 1)
    out = []
    for own in (words, mix(words ^ _OTHER)):
        # sum of own[i + k] * base ** k, from differences of one running sum
        total = np.concatenate(([np.uint64(0)], np.cumsum(own * up[: len(own)], dtype=np.uint64)))
        out.append(mix((total[width:] - total[:m]) * down[:m])[first])
    return out[0], out[1], first


def pack(docs: DataFrame, doc_id: str, text: str, width: int, chunk: int) -> DataFrame:
    """(chunk, windows, body): documents in order of id, nulls last, compressed; ``windows`` bounds their number."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        ids, texts, size = [], [], 0

        def body():
            order = sorted(range(len(ids)), key=lambda i: _LAST if ids[i] is None else ids[i])
            sink = pa.BufferOutputStream()
            table = pa.record_batch([pa.array([ids[i] for i in order], pa.int64()), pa.array([texts[i] for i in order], pa.large_string())], ["id", "text"])
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_batch(table)
            data = zstandard.ZstdCompressor(level=6).compress(sink.getvalue())
            windows = sum(max(len(t.split()) - width + 1, 0) for t in texts)
            name = int.from_bytes(os.urandom(8), "little", signed=True)
            return pa.record_batch([pa.array([name], pa.int64()), pa.array([windows], pa.int64()), pa.array([data], pa.binary())], ["chunk", "windows", "body"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= chunk:
                    yield body()
                    ids, texts, size = [], [], 0
        if ids:
            yield body()

    return rows.mapInArrow(run, "chunk long, windows long, body binary")


class Chunk:
    """The documents of a chunk, their windows, and those that go to the buckets, in their order."""

    def __init__(self, body: bytes, width: int, buckets: int):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()
        self.ids, self.texts = table.column(0).to_pylist(), table.column(1).to_pylist()
        words, self.count = word_hashes(self.texts)
        h1, h2, self.first = window_hashes(words, self.count, width)
        order = np.argsort(h1, kind="stable")
        again = np.zeros(len(order), bool)
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        #: Windows that repeat an earlier one of the same chunk.
        self.again = again
        sent = np.flatnonzero(~again)
        bucket = (h2[sent] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        self.sent, self.bucket = sent[by], bucket[by]
        self.h1, self.h2 = h1[self.sent], ((h2[self.sent] // np.uint64(buckets)) & np.uint64(255)).astype(np.uint8)
        self.starts = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def rows(self):
        """(bucket, ids, hashes) of every bucket that gets windows."""
        ids = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        ends = np.cumsum(self.count)
        doc = np.searchsorted(ends, self.first[self.sent], "right")
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in np.unique(self.bucket):
            a, z = self.starts[b], self.starts[b + 1]
            own, n = np.unique(doc[a:z], return_counts=True)
            held = ids[own]
            head = np.concatenate((np.diff(held, prepend=np.int64(0)), n))
            yield int(b), squeeze.compress(head.tobytes()), self.h1[a:z].tobytes() + self.h2[a:z].tobytes()


def _first_of(table: pa.Table) -> pa.Table:
    """What one bucket answers: for each chunk a bit a window, set where an equal window starts earlier."""
    table = table.sort_by("chunk")
    chunk, heads, blobs = (table.column(c) for c in ("chunk", "ids", "hashes"))
    ids, h1, h2, sizes = [], [], [], []
    for head, blob in zip(heads, blobs, strict=True):
        data = blob.as_py()
        n = len(data) // 9
        both = np.frombuffer(zstandard.ZstdDecompressor().decompress(head.as_py()), np.int64)
        ids.append(np.repeat(np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]))
        h1.append(np.frombuffer(data, np.uint64, n))
        h2.append(np.frombuffer(data, np.uint8, n, 8 * n))
        sizes.append(n)
    ids, h1, h2 = np.concatenate(ids), np.concatenate(h1), np.concatenate(h2)
    order = np.argsort(h1, kind="stable")
    equal = np.concatenate((h1[order[1:]] == h1[order[:-1]], [False]))
    some = order[equal | np.concatenate(([False], equal[:-1]))]
    # Within equal hashes by id, then by chunk and place.
    some = some[np.lexsort((some, ids[some], h2[some], h1[some]))]
    later = np.zeros(len(h1), bool)
    later[some[1:]] = (h1[some[1:]] == h1[some[:-1]]) & (h2[some[1:]] == h2[some[:-1]])
    ends = np.cumsum(sizes)
    out = [(c.as_py(), np.packbits(later[e - n : e]).tobytes()) for c, e, n in zip(chunk, ends, sizes, strict=True) if later[e - n : e].any()]
    bucket = table.column("bucket")[0].as_py()
    return pa.table([pa.array([c for c, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([f for _, f in out], pa.binary())], ["chunk", "bucket", "flags"])


def _merged(mark: np.ndarray) -> np.ndarray:
    """Maximal runs of True as (first, last) rows."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
    return np.column_stack((edges[0::2], edges[1::2] - 1))


_FIELDS = "id long, n_words long, n_removed long, spans array<struct<first: long, last: long>>, kept {kind}"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _cut(chunk: Chunk, answers: dict[int, bytes], width: int, digest: bool) -> pa.Table:
    """Documents of a chunk without the words that repeated windows cover."""
    repeat = chunk.again
    for b, flags in answers.items():
        a, z = chunk.starts[b], chunk.starts[b + 1]
        repeat[chunk.sent[a:z]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=z - a).astype(bool)
    total = int(chunk.count.sum())
    edge = np.zeros(total + 1, np.int64)
    at = chunk.first[repeat]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    ends = np.cumsum(chunk.count)
    removed, spans, kept = [], [], []
    for text, n, end in zip(chunk.texts, chunk.count, ends, strict=True):
        mark = covered[end - n : end]
        words = text.encode("utf-8", "replace").split()
        own = b" ".join(compress(words, ~mark) if mark.any() else words)
        removed.append(int(mark.sum()))
        spans.append([{"first": a, "last": z} for a, z in _merged(mark).tolist()])
        kept.append(hashlib.sha256(own).hexdigest() if digest else own.decode("utf-8"))
    return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "spans", "kept"])


def cut_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, digest: bool = False, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    r"""(id, n_words, n_removed, spans, kept) of every document.

    Words are ``[^\x20\x09-\x0D]+`` of the whole text.  A word goes if a window of ``width``
    words that covers it equals one that starts earlier: in a document with a smaller id, or
    earlier in the same one.  Windows are judged on the input and never cross documents.
    ``spans`` are the maximal intervals of removed words (first and last, from 0); ``kept``
    joins the others by one space, or is the SHA-256 of that with ``digest``.

    Null and empty texts have no words.  A null id comes after all others.  Rows of one id are
    documents of their own in some fixed order, so a passage stays in one of them.  An empty
    table gives no rows; other columns are not read, so their names may clash.
    """
    packed = materialise(pack(docs, doc_id, text, width, chunk), "window-chunks", codec="uncompressed")
    total = packed.agg(F.sum("windows").alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // bucket))

    def hashed(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = Chunk(body.as_py(), width, buckets)
                for b, head, blob in made.rows():
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([name], pa.int64()), pa.array([head], pa.binary()), pa.array([blob], pa.binary())], ["bucket", "chunk", "ids", "hashes"])

    sent = packed.select("chunk", "body").mapInArrow(hashed, "bucket int, chunk long, ids binary, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_first_of, "chunk long, bucket int, flags binary")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Chunk(left.column("body")[0].as_py(), width, buckets)
        return _cut(own, dict(zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist(), strict=True)), width, digest)

    out = packed.select("chunk", "body").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, _FIELDS.format(kind="string"))
    return out


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
