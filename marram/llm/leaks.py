"""Benchmark decontamination by SimHash of item-sized windows.

1. Items and documents become bags of five-word shingles (one shingle of all words where an
   item has fewer than five).
2. A window has as many words as an item; a document that is shorter is one window.  At a
   similarity of 4/5 or more, at least 4/9 of the shingles of item and window together are
   shared, so windows that hold fewer shingles of any item are passed over; that is exact.
3. Every other window gets a SimHash of its bag, occurrences numbered.  The fingerprints of the items of that size
   are indexed by BLOCKS blocks of BLOCK_BITS bits, each with all values within
   RADIUS // BLOCKS flipped bits, so every item within RADIUS bits of a window agrees in one
   block; the full distance confirms it.
4. Candidates are verified exactly: weighted Jaccard similarity (sum of least over sum of
   largest multiplicities) of at least THRESHOLD.

RADIUS lies over four standard deviations above the distance expected at the threshold.
Items are taken in blocks of about ITEM_BLOCK items and ITEM_CHARS characters, each passed over
all documents, so what is sent to the executors is bounded however large the benchmark.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, chunks, mix, text_tag

WORDS = 5
#: The threshold as a fraction: 4/5.
PART, WHOLE = 4, 5
BLOCKS, BLOCK_BITS = 8, 8
RADIUS = 23
#: Items and characters in a block: some 10 MB of shingles and 25 MB of index.
ITEM_BLOCK, ITEM_CHARS = 20_000, 8_000_000

#: Windows that are looked up at once.
QUERIES = 256

_BITS = np.arange(64, dtype=np.uint64)
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def shingle_bags(texts: list[str], words: int = WORDS) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the lower-cased texts, hashes of their shingles, and each shingle's first word."""
    w = Words([t.lower() for t in texts], ALNUM)
    grams, first = w.grams(words)
    return w, grams, first


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_POPCOUNT[((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64) for k in range(4))


def _numbered(grams: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Bits, as +1 and -1, of the k-th occurrences (from 1) of shingles: a bag becomes a set."""
    h = np.where(k == 1, grams, mix(grams ^ mix(k.astype(np.uint64))))
    return ((h[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def simhash(grams: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of ``n`` shingles at ``starts``: the sign of each bit's sum.

    A shingle's k-th occurrence in a window counts as (shingle, k), so two bags are as near as
    their weighted Jaccard similarity says, however often a shingle repeats.  A window that
    moves on loses its first shingle's last occurrence and gains one of the shingle after it.
    """
    m, at = len(grams), np.arange(len(grams))
    _, kind = np.unique(grams, return_inverse=True)
    key = kind.astype(np.int64) * (m + n + 1) + at
    order = np.sort(key)
    rank = np.searchsorted(order, key)
    # Occurrences in the window that begins, and in the window that ends, with each shingle.
    ahead = np.searchsorted(order, key + n) - rank
    behind = rank + 1 - np.searchsorted(order, kind.astype(np.int64) * (m + n + 1) + np.maximum(at - n + 1, 0))
    begin = _numbered(grams[:n], behind[:n]).sum(0, dtype=np.int32)
    step = _numbered(grams[n:], behind[n:]) - _numbered(grams[: m - n], ahead[: m - n])
    total = np.concatenate((begin[None], begin + np.cumsum(step, 0, dtype=np.int32)))
    return ((total[starts] > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def _flips() -> np.ndarray:
    """All BLOCK_BITS-bit masks of at most RADIUS // BLOCKS bits."""
    most = RADIUS // BLOCKS
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(BLOCK_BITS), k)], np.int16)


class HammingIndex:
    """Fingerprints by block value; every one within RADIUS of a query is found."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        flips, size = _flips(), 1 << BLOCK_BITS
        for k in range(BLOCKS):
            own = ((prints >> np.uint64(BLOCK_BITS * k)) & np.uint64(size - 1)).astype(np.int16)
            near = (own[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            self.tables.append((np.concatenate(([0], np.cumsum(np.bincount(near, minlength=size)))).astype(np.int32), (order // len(flips)).astype(np.int32)))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) numbers of all pairs within RADIUS bits, each once."""
        if len(queries) > QUERIES:
            parts = [self.near(queries[i : i + QUERIES]) for i in range(0, len(queries), QUERIES)]
            return np.concatenate([q + i * QUERIES for i, (q, _) in enumerate(parts)]), np.concatenate([p for _, p in parts])
        found = []
        for k, (bounds, items) in enumerate(self.tables):
            own = ((queries >> np.uint64(BLOCK_BITS * k)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            size = (bounds[own + 1] - bounds[own]).astype(np.int64)
            q = np.repeat(np.arange(len(queries)), size)
            at = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[own], size)
            p = items[at]
            close = distance(queries[q], self.prints[p]) <= RADIUS
            found.append(q[close] * len(self.prints) + p[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


def weighted_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of the least multiplicities of two bags."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[i], cb[j]).sum())


class Items:
    """A block of benchmark items: bags and indexes by number of words."""

    def __init__(self, ids: list[int], texts: list[str]):
        w, grams, first = shingle_bags(texts)
        owner = w.doc[first]
        begin = np.concatenate(([0], np.cumsum(w.count)))
        self.bags: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, item in enumerate(ids):
            n = int(w.count[i])
            if n >= WORDS:
                self.bags.setdefault(n, []).append((item, grams[owner == i]))
            elif n:
                short = _short(w.hash[begin[i] : begin[i + 1]], n)
                self.bags.setdefault(n, []).append((item, short))
        # Items under WORDS words: distinct hashes in order, and the items of each.
        self.short = {}
        for n, x in self.bags.items():
            if n < WORDS:
                own, numbers = np.array([b[0] for _, b in x]), np.array([item for item, _ in x], np.int64)
                order = np.argsort(own, kind="stable")
                known, first_of = np.unique(own[order], return_index=True)
                self.short[n] = (known, numbers[order], np.append(first_of, len(own)))
        # Distinct (shingle, item size) pairs, in order of the shingle.
        sizes = {n: np.unique(np.concatenate([b for _, b in x])) for n, x in self.bags.items() if n >= WORDS}
        shingle = np.concatenate(list(sizes.values()) or [np.zeros(0, np.uint64)])
        order = np.argsort(shingle, kind="stable")
        self.size_of = np.repeat(list(sizes) or [0], [len(x) for x in sizes.values()] or [0])[order]
        self.known, self.begin = np.unique(shingle[order], return_index=True)
        self.begin = np.append(self.begin, len(shingle))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.index = {n: HammingIndex(np.concatenate([simhash(b, np.zeros(1, np.int64), len(b)) for _, b in x])) for n, x in self.bags.items() if n >= WORDS}


_built: dict[str, Items] = {}


def _worker_items(name: str, ids: list[int], texts: list[str]) -> Items:
    """The worker's block of items: built once a Python process, one block at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(ids, texts)
    return _built[name]


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` < WORDS words."""
    m = len(hashes) - n + 1
    total = np.zeros(max(0, m), np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
    return mix(total + np.uint64(n))


def needed(a: int, b: int) -> int:
    """Shared shingles that bags of ``a`` and ``b`` shingles need for the threshold."""
    return -(-PART * (a + b) // (PART + WHOLE))


def find(texts: list[str], items: Items) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity) of the best window of each pair."""
    out = []
    w, grams, first = shingle_bags(texts)
    begin = np.concatenate(([0], np.cumsum(w.count)))
    hit = np.flatnonzero(items.seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if len(items.known) and len(hit):
        at = np.minimum(np.searchsorted(items.known, grams[hit]), len(items.known) - 1)
        same = items.known[at] == grams[hit]
        hit, at = hit[same], at[same]
    else:
        hit = at = hit[:0]
    short = [n for n in items.bags if n < WORDS]
    if len(hit):
        # Hits by document and item size; a pair with too few hits has no window.
        many = items.begin[at + 1] - items.begin[at]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size, spot = items.size_of[np.repeat(items.begin[at], many) + place], np.repeat(hit, many)
        order = np.lexsort((spot, size, w.doc[first[spot]]))
        size, spot = size[order], spot[order]
        key = w.doc[first[spot]] * (int(size.max()) + 1) + size
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        gram_begin = np.searchsorted(first, begin)
        if len(spot):
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                n, d = int(size[lo]), int(w.doc[first[spot[lo]]])
                s = n - WORDS + 1
                a, b = gram_begin[d], gram_begin[d + 1]
                t = min(s, int(b - a))
                least = needed(s, t)
                if hi - lo < least:
                    continue
                own = grams[a:b]
                mark = np.zeros(b - a + 1, np.int32)
                mark[spot[lo:hi] - a + 1] = 1
                count = np.cumsum(mark)
                starts = np.flatnonzero(count[t:] - count[:-t] >= least)
                if not len(starts):
                    continue
                best: dict[int, tuple[float, int]] = {}
                # Neighbouring windows share their bits' sums: take them by stretches.
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > t) + 1):
                    base = part[0]
                    prints = simhash(own[base : part[-1] + t], part - base, t)
                    for q, p in zip(*items.index[n].near(prints), strict=True):
                        item, bag = items.bags[n][p]
                        start = int(part[q])
                        common = weighted_overlap(own[start : start + t], bag)
                        if common >= least:
                            score = common / (s + t - common)
                            if item not in best or (-score, start) < (-best[item][0], best[item][1]):
                                best[item] = (score, start)
                out += [(d, item, start, t + WORDS - 1, score) for item, (score, start) in best.items()]
    for n in short:
        runs = _short(w.hash, n)
        known, numbers, bounds = items.short[n]
        at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        hit = np.flatnonzero((known[at] == runs) & (w.doc[: len(runs)] == w.doc[n - 1 :]))
        # The first place of each document and text of an item.
        _, place = np.unique(w.doc[hit] * len(known) + at[hit], return_index=True)
        for k, a in zip(hit[place].tolist(), at[hit[place]].tolist(), strict=True):
            d = int(w.doc[k])
            out += [(d, int(item), int(k - begin[d]), n, 1.0) for item in numbers[bounds[a] : bounds[a + 1]]]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of the best window of every pair.

    Only pairs at the threshold have a row.  Null, empty and wordless texts and items match
    nothing; a null item_id is left out, a null doc_id is answered as such.  Rows that repeat
    a doc_id or an item_id are one document or item: its best window counts (of equal ones,
    that with the smallest first word).  Long texts are read whole; an empty table of documents
    or items gives no rows; other columns are not read.
    """
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n_words")).alias("b")
    found = _windows(docs, benchmark, text).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def _windows(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tag, item_id, first_word, n_words, similarity) of the best window of every row and item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(F.col(text)).alias("tag"), F.col(text).cast("string").alias("_text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["chars"] // ITEM_CHARS))
    schema = "doc_id long, tag long, item_id long, first_word long, n_words long, similarity double"
    names = [c.split()[0] for c in schema.split(", ")]
    found = []
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [r["item_id"] for r in block], [r["text"] for r in block]))

        def run(batches, sent=sent):
            own = _worker_items(*sent.value)
            for batch in batches:
                doc_id, tag, texts = batch.columns
                texts = [t or "" for t in texts.to_pylist()]
                for lo, hi in chunks(texts):
                    got = find(texts[lo:hi], own)
                    if got:
                        t, *rest = zip(*got, strict=True)
                        rows = pa.array([lo + i for i in t])
                        yield pa.RecordBatch.from_arrays([doc_id.take(rows), tag.take(rows), *(pa.array(x, pa.float64() if i == 3 else pa.int64()) for i, x in enumerate(rest))], names)

        found.append(rows.mapInArrow(run, schema))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; the columns of ``docs`` are kept.

    A row goes by its doc_id and text, so a doc_id may be null or repeated.
    """
    found = _windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("gone"), F.col("tag").alias("gone_tag")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone"]) & (text_tag(docs["text"]) == gone["gone_tag"]), "left_anti")
