"""Removal of long repeated byte strings across documents, exact to the byte.

Sorting every suffix of the corpus carries several times its size in tuples and takes about
a microsecond of one core a byte, more than one gets here (README).  So the shards that
external induced sorting works on hold only what cheaper steps leave open:

1. Each document's windows of 50 bytes fall into runs that share their least anchor hash
   (``anchors``); equal windows have equal anchors.  Tasks send runs, as packed arrays, to
   the bucket of their anchor.  Of runs with equal spans that one task holds only the
   smallest document's goes there; the others are covered and go straight to their homes.
2. A bucket sorts its runs by anchor, by hash of the run's whole span, and by document.  A
   run whose span stands in a smaller document is covered.  Where an anchor has several
   spans, the first document of each span is asked for the bytes.  Answers go back packed by
   home, a group of documents.
3. The spans asked for are the shards, dealt by anchor.  The suffixes of a shard are sorted
   with their shared prefixes (``induced``); neighbours that share 50 bytes or more are one
   string, which is covered wherever its document is not the smallest.
4. An anchor with over HOT_SPANS open spans (a line that a great many documents hold in
   different contexts) is no shard: its windows are grouped by 128-bit hashes as rows, with
   partial minima before the shuffle, so no task holds all of them.
5. Each document joins its answers and drops the bytes under covered windows.

A bucket holds the runs of about BUCKET_CHARS characters, a home the documents of about
HOME_CHARS, and a shard at most OPEN_SPANS + HOT_SPANS spans, so memory is bounded however
large the input: a span held by a third of all documents costs its bucket 15 bytes for every
SEND_CHARS characters of input.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import anchors, induced
from .common import chunks, materialise, mix

#: Characters of text whose runs make a bucket.
BUCKET_CHARS = 8_000_000
#: Characters of text of the documents that share a home.
HOME_CHARS = 8_000_000
#: Characters hashed at once in a task, and those whose runs are held before they are sent.
PART_CHARS, SEND_CHARS = 1_000_000, 16_000_000
#: Spans that are opened at once, and spans from which an anchor's windows are grouped as rows.
OPEN_SPANS, HOT_SPANS = 10_000, 20_000

_RUNS = "bucket int, owners binary, packed binary"


def _keyed(docs: DataFrame, text: str, homes: int) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    return rows.withColumn("home", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(homes)).cast("int"))


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(keyed: DataFrame) -> DataFrame:
    """The rows with their UTF-8 bytes compressed, which halves what a shuffle carries."""

    def run(frames):
        for pdf in frames:
            yield pdf.drop(columns="text").assign(body=[_pack(t.encode("utf-8", "replace")) for t in pdf["text"]])

    return keyed.mapInPandas(run, "doc_id long, tag long, home int, body binary")


def _joined(texts) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _narrow(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _planes(values: np.ndarray) -> bytes:
    """The four bytes of each number, as four planes: the upper ones of small numbers are zeros."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _widen(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.reshape(-1).view("<u8")


def send_runs(keyed: DataFrame, buckets: int) -> DataFrame:
    """Packed runs of every document, by bucket of their anchor, and the answers known already.

    A row holds the runs of one bucket from about SEND_CHARS characters, and names only the
    documents that they come from, so what is sent grows with the runs and not with the
    number of buckets.  An answer has no owners and begins with its home.
    """

    def rows(held: list) -> pd.DataFrame:
        low, span, owner, number, doc, tag, home = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        known = _known_before(low, span, doc[owner])
        order, done = np.flatnonzero(~known), np.flatnonzero(known)
        order = order[np.argsort(bucket[order].astype(np.int16 if buckets < 1 << 15 else np.int64), kind="stable")]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full, owners, packed = [], [], []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            r = order[bounds[b] : bounds[b + 1]]
            edge = np.flatnonzero(np.concatenate(([True], owner[r][1:] != owner[r][:-1])))
            own = owner[r[edge]]
            full.append(b)
            owners.append(zlib.compress(np.concatenate((doc[own], tag[own], home[own], np.diff(np.append(edge, len(r))))).astype(np.int64).tobytes(), 1))
            packed.append(_narrow(low[r] // np.uint64(buckets), 5) + _narrow(span[r], 6) + _planes(number[r]))
        for at, data in _by_home(home[owner[done]], doc[owner[done]], tag[owner[done]], number[done], np.ones(len(done), bool)):
            full.append(at % buckets)
            owners.append(b"")
            packed.append(at.to_bytes(4, "little") + data)
        return pd.DataFrame({"bucket": full, "owners": owners, "packed": packed})

    def run(frames):
        held: list = []
        size = docs = 0
        for pdf in frames:
            texts = list(pdf["text"])
            for first, last in chunks(texts, PART_CHARS):
                raw, offsets = _joined(texts[first:last])
                low, start, n, doc = anchors.runs(raw, offsets)
                if len(low):
                    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                    part = pdf.iloc[first:last]
                    span = anchors.span_hashes(raw, start, n + (anchors.WIDTH - 1))
                    held.append((low, span, (doc + docs).astype(np.int32), number.astype(np.uint32), part["doc_id"].to_numpy(np.int64), part["tag"].to_numpy(np.int64), part["home"].to_numpy(np.int64)))
                    docs, size = docs + last - first, size + len(raw)
                if size >= SEND_CHARS:
                    yield rows(held)
                    size = docs = 0
        if held:
            yield rows(held)

    return keyed.mapInPandas(run, _RUNS)


def _known_before(low: np.ndarray, span: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Runs whose anchor and span a smaller document of the same task has."""
    out = np.zeros(len(low), bool)
    key = mix(low) + span
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    begin = np.flatnonzero(new)
    many = np.repeat(np.diff(np.append(begin, len(order))) > 1, np.diff(np.append(begin, len(order))))
    order = order[many]
    if len(order):
        order = order[np.lexsort((doc[order], span[order], low[order]))]
        a, b = low[order], span[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        out[order] = doc[order] > doc[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    return out


def _by_home(home, doc, tag, number, covered) -> list[tuple[int, bytes]]:
    """Answers packed by home."""
    if not len(home):
        return []
    order = np.lexsort((number, tag, doc, home))
    home, doc, tag, number, covered = home[order], doc[order], tag[order], number[order], covered[order]
    edge = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))).tolist()
    return [(int(home[i]), zlib.compress(doc[i:j].tobytes() + tag[i:j].tobytes() + number[i:j].tobytes() + covered[i:j].tobytes(), 1)) for i, j in zip(edge, [*edge[1:], len(home)], strict=True)]


def settle_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Covered and open runs of one bucket: a packed row for each home."""
    low, span, doc, tag, home, number, known = [], [], [], [], [], [], []
    for owners, packed in zip(pdf["owners"], pdf["packed"], strict=True):
        if not owners:
            known.append((int.from_bytes(packed[:4], "little"), packed[4:]))
            continue
        table = np.frombuffer(zlib.decompress(owners), np.int64).reshape(4, -1)
        data = np.frombuffer(packed, np.uint8)
        m = len(data) // 15
        own = np.repeat(np.arange(table.shape[1]), table[3])
        low.append(_widen(data[: 5 * m], 5))
        span.append(_widen(data[5 * m : 11 * m], 6))
        doc.append(table[0][own])
        tag.append(table[1][own])
        home.append(table[2][own].astype(np.int32))
        number.append(np.ascontiguousarray(data[11 * m :].reshape(4, m).T).view("<u4").ravel())
    answers = lambda own: pd.DataFrame({"home": [h for h, _ in own], "found": [x for _, x in own]})
    if not low:
        return answers(known)
    low, span, doc, tag, home, number = map(np.concatenate, (low, span, doc, tag, home, number))
    order = np.argsort(low, kind="stable")
    new = np.concatenate(([True], low[order][1:] != low[order][:-1]))
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    d = doc[order]
    keep = (np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin))[group]
    order = order[keep]
    low, span, doc, tag, home, number = low[order], span[order], doc[order], tag[order], home[order], number[order]
    if not len(low):
        return answers(known)
    order = np.lexsort((doc, span, low))
    low, span, doc, tag, home, number = low[order], span[order], doc[order], tag[order], home[order], number[order]
    a = np.concatenate(([True], low[1:] != low[:-1]))
    s = a | np.concatenate(([True], span[1:] != span[:-1]))
    first = doc[np.flatnonzero(s)][np.cumsum(s) - 1]
    kinds = np.add.reduceat(s.astype(np.int64), np.flatnonzero(a))[np.cumsum(a) - 1]
    covered, asked = doc > first, (doc == first) & (kinds > 1)
    some = np.flatnonzero(covered | asked)
    return answers(known + _by_home(home[some], doc[some], tag[some], number[some], covered[some]))


def _answers(found) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Covered and open run numbers of each (doc_id, tag) of a home."""
    doc, tag, number, covered = [], [], [], []
    for data in found:
        raw = zlib.decompress(data)
        m = len(raw) // 21
        doc.append(np.frombuffer(raw, np.int64, m))
        tag.append(np.frombuffer(raw, np.int64, m, 8 * m))
        number.append(np.frombuffer(raw, np.uint32, m, 16 * m))
        covered.append(np.frombuffer(raw, np.bool_, m, 20 * m))
    if not doc:
        return {}
    doc, tag, number, covered = map(np.concatenate, (doc, tag, number, covered))
    order = np.lexsort((number, tag, doc))
    doc, tag, number, covered = doc[order], tag[order], number[order].astype(np.int64), covered[order]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True]))).tolist()
    out = {}
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        c = covered[i:j]
        # Rows that repeat a document report the same runs.
        out[int(doc[i]), int(tag[i])] = np.unique(number[i:j][c]), np.unique(number[i:j][~c])
    return out


def _kept(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the windows that start in [start, stop) ranges."""
    step = np.zeros(len(raw) + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, stop + (anchors.WIDTH - 1), -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return raw[~gone].tobytes(), int(gone.sum()), spans


_FINAL = "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
COLUMNS = ["doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _final(doc_id, tag, raw: np.ndarray, start, stop, with_bytes: bool) -> tuple:
    rest, removed, spans = _kept(raw, np.asarray(start, np.int64), np.asarray(stop, np.int64))
    return doc_id, tag, len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), _pack(rest) if with_bytes and removed else None


def answer(texts: pd.DataFrame, found: pd.DataFrame, with_bytes: bool) -> pd.DataFrame:
    """Finish a home's documents without open runs; hand on the bytes and open spans of the others."""
    known, out, none = _answers(found["found"]), [], np.zeros(0, np.int64)
    for doc_id, tag, body in zip(texts["doc_id"], texts["tag"], texts["body"], strict=True):
        raw = np.frombuffer(_unpack(body), np.uint8)
        own = int(doc_id)
        done, still = known.get((own, int(tag)), (none, none))
        if not len(done) and not len(still):
            out.append((*_final(own, tag, raw, [], [], with_bytes), None, None, None))
            continue
        low, start, n, _ = anchors.runs(raw, np.array([0, len(raw)]))
        if not len(still):
            out.append((*_final(own, tag, raw, start[done], start[done] + n[done], with_bytes), None, None, None))
            continue
        ranges = np.stack((start[done], start[done] + n[done])).astype("<i8").tobytes()
        spans = [{"anchor": int(low[k].view(np.int64)), "start": int(start[k]), "span": raw[start[k] : start[k] + n[k] + anchors.WIDTH - 1].tobytes()} for k in still]
        out.append((own, tag, len(raw), 0, 0, None, None, body, ranges, spans))
    return pd.DataFrame(out, columns=[*COLUMNS, "body", "ranges", "spans"])


_STATE = _FINAL + ", body binary, ranges binary, spans array<struct<anchor:long,start:long,span:binary>>"


def open_spans(frames):
    """Covered windows of open spans; rows come sorted by anchor."""

    def settle(g: pd.DataFrame):
        sizes = np.array([len(x) for x in g["span"]], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))
        docs, starts = g["doc_id"].to_numpy(), g["start"].to_numpy()
        hits, carry = [], None
        for at, shared in induced.suffixes(induced.joined(list(g["span"])), induced.ALPHABET, anchors.WIDTH):
            # Strings of WIDTH bytes that stand in no span whole agree with no whole one.
            new = shared < anchors.WIDTH
            if carry is not None and not new[0]:
                at, new = np.concatenate((carry, at)), np.concatenate(([True], np.zeros(len(carry) - 1, bool), new))
            elif carry is not None:
                hits.append(covered(carry, np.arange(len(carry)) == 0, first, docs))
            new[0] = True
            last = int(np.flatnonzero(new)[-1])
            if last:
                hits.append(covered(at[:last], new[:last], first, docs))
            carry = at[last:]
        if carry is not None:
            hits.append(covered(carry, np.arange(len(carry)) == 0, first, docs))
        hit = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        if not len(hit):
            return None
        r = np.searchsorted(first, hit, "right") - 1
        o = hit - first[r]
        # Neighbouring windows of a span make one range.
        edge = np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)))
        i = np.flatnonzero(edge)
        j = np.append(i[1:], len(hit)) - 1
        return pd.DataFrame({"doc_id": docs[r[i]], "tag": g["tag"].to_numpy()[r[i]], "start": starts[r[i]] + o[i], "stop": starts[r[i]] + o[j] + 1})

    def covered(at: np.ndarray, new: np.ndarray, first: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Those of sorted suffixes whose string also stands in a smaller document."""
        r = np.searchsorted(first, at, "right") - 1
        whole = r < len(docs)
        whole[whole] = at[whole] + anchors.WIDTH < first[r[whole] + 1]
        group = (np.cumsum(new) - 1)[whole]
        at, own = at[whole], docs[r[whole]]
        if not len(at):
            return at
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(at))))
        return at[own > least]

    held, count = [], 0
    for pdf in frames:
        if not len(pdf):
            continue
        held.append(pdf)
        count += len(pdf)
        if count >= OPEN_SPANS:
            g = pd.concat(held, ignore_index=True)
            cut = int((g["anchor"].to_numpy() != g["anchor"].iloc[-1]).sum())
            if cut:
                if (out := settle(g.iloc[:cut].reset_index(drop=True))) is not None:
                    yield out
            held, count = [g.iloc[cut:].reset_index(drop=True)], len(g) - cut
    if held and (out := settle(pd.concat(held, ignore_index=True))) is not None:
        yield out


def hot_windows(spans: DataFrame) -> DataFrame:
    """Covered windows of spans (doc_id, tag, start, span), found by two 64-bit hashes of each window.

    The grouping is combined before the shuffle, and the table of least documents is written
    before it is joined, so a window that very many documents hold is split over tasks.
    """
    width = anchors.WIDTH
    opened = spans.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("span") - width)))
    window = F.expr(f"substring(span, at + 1, {width})")
    marked = opened.select("doc_id", "tag", (F.col("start") + F.col("at")).alias("start"), F.xxhash64(window).alias("m1"), F.xxhash64(window, F.lit(1)).alias("m2"))
    least = marked.groupBy("m1", "m2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    found = marked.join(materialise(least, "repeats-windows").hint("merge"), ["m1", "m2"]).filter("doc_id > least")
    return found.select("doc_id", "tag", "start", (F.col("start") + 1).alias("stop"))


def finish(pending: DataFrame, with_bytes: bool) -> DataFrame:
    def run(frames):
        for pdf in frames:
            out = []
            for doc_id, tag, body, ranges, more in zip(pdf["doc_id"], pdf["tag"], pdf["body"], pdf["ranges"], pdf["more"], strict=True):
                raw = np.frombuffer(_unpack(body), np.uint8)
                start, stop = np.frombuffer(ranges, "<i8").reshape(2, -1)
                if more is not None and len(more):
                    start = np.concatenate((start, [x["start"] for x in more]))
                    stop = np.concatenate((stop, [x["stop"] for x in more]))
                out.append(_final(int(doc_id), tag, raw, start, stop, with_bytes))
            yield pd.DataFrame(out, columns=COLUMNS)

    return pending.mapInPandas(run, _FINAL)


def remove_repeats(docs: DataFrame, text: str = "text", with_bytes: bool = False) -> DataFrame:
    """For every row of ``docs``: sizes, removed bytes and spans, and the digest of the rest.

    ``with_bytes`` adds ``tag`` (xxhash64 of the text) and ``kept``, the rest (zstd) where
    something was removed, else null.

    Null and empty texts have no bytes.  A row without a doc_id is neither smaller nor larger
    than another: nothing is removed from it or because of it.  Rows that share a doc_id are
    one document: none of them is removed on account of another, each is answered.  A text of
    any length is cut by its own runs; an empty table gives no rows; other columns of ``docs``
    are not read.
    """
    total = int(docs.agg(F.sum(F.length(F.col(text).cast("string")))).first()[0] or 0)
    buckets, homes = max(4, -(-total // BUCKET_CHARS)), max(16, -(-total // HOME_CHARS))
    every = _keyed(docs, text, homes)
    keyed = every.filter("doc_id is not null")
    settled = send_runs(keyed, buckets).groupBy("bucket").applyInPandas(settle_bucket, "home int, found binary")
    finished = _packed(keyed).groupBy("home").cogroup(settled.groupBy("home")).applyInPandas(lambda texts, found: answer(texts, found, with_bytes), _STATE)
    state = materialise(finished, "repeats-state")
    spans = state.filter("spans is not null").select("doc_id", "tag", F.explode("spans").alias("s")).select("doc_id", "tag", "s.*")
    hot = materialise(spans.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SPANS).select("anchor"), "repeats-hot")
    some = not hot.isEmpty()
    cold = spans.join(hot.hint("merge"), "anchor", "left_anti").select(*spans.columns) if some else spans
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(open_spans, "doc_id long, tag long, start long, stop long")
    if some:
        found = found.unionByName(hot_windows(spans.join(hot.hint("merge"), "anchor")))
    more = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    pending = state.filter("spans is not null").select("doc_id", "tag", "body", "ranges").join(more, ["doc_id", "tag"], "left")
    bare = every.filter("doc_id is null").select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    out = state.filter("spans is null").select(COLUMNS).unionByName(finish(pending.select("doc_id", "tag", "body", "ranges", "more"), with_bytes)).unionByName(bare)
    return out if with_bytes else out.drop("tag", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def cut_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the repeated bytes; the columns of ``docs`` are kept.

    A character that is cut in two goes; ``n_chars``, where there is such a column, follows
    the text.  A document of nothing but repeats stays, with an empty text.
    """
    left = remove_repeats(docs, with_bytes=True).filter("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("kept").alias("_left")).dropDuplicates(["_id", "_tag"])

    @F.pandas_udf(StringType())
    def unpacked(kept: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else _unpack(k).decode("utf-8", "ignore") for k, t in zip(kept, text, strict=True)])

    own = (docs["doc_id"].cast("long") == left["_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == left["_tag"])
    made = {"text": unpacked(left["_left"], docs["text"].cast("string"))}
    out = docs.join(left.hint("merge"), own, "left").select(*[made.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns], left["_left"].isNotNull().alias("_cut"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(out["_cut"], F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(out["n_chars"]))
    return out.drop("_cut")
