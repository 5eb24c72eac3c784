"""Jaccard join on word shingles with Bayesian pruning of candidates.

1. Every text becomes its set of five-word shingles (one shingle of all words if there are
   fewer); texts with equal sets are one node, so exact copies are never compared.
2. Nodes whose MinHash values (16 bits each) agree in a band of ROWS are candidates.  BANDS
   bands find a pair at the threshold but for a chance of (1 - 0.8**4)**32 < 1e-7.
3. Candidates of a band are compared by MinHash alone, CHUNK values at a time, in the first
   band that they share; a pair is dropped when the posterior probability that its
   similarity reaches the threshold falls below TOLERANCE (uniform prior).  A band with many
   nodes is cut into blocks of about BLOCK nodes, and a pair of blocks is a task's share.
4. Pairs that stay join their nodes into groups.  Texts are fetched for groups only, and
   inside a group, again in pairs of blocks, all that pruning leaves is verified exactly on
   the shingles.  Neither pairs nor large groups become rows.
5. Verified links make classes: connected components, named by their smallest doc_id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, Words, chunks, discard, map_texts, materialise, mix, text_tag
from .graph import components

WORDS = 5
#: The threshold as a fraction: 4/5.
PART, WHOLE = 4, 5
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
CHUNK = 16
TOLERANCE = 1e-6
#: Nodes and bytes of text in a block; pairs that are compared at once.
BLOCK, BLOCK_BYTES, PAIRS = 512, 4 << 20, 1 << 17

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, flat and sorted in each, and offsets by text.

    A text without words has none.
    """
    w = Words([t.lower() for t in texts], ALNUM)
    grams, first = w.grams(WORDS)
    doc = w.doc[first]
    short = np.flatnonzero((w.count > 0) & (w.count < WORDS))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(w.count)))
        own = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            for h in w.hash[begin[d] : begin[d + 1]]:
                own[k] = mix(np.array([(int(own[k]) * 0x9E3779B97F4A7C15 + int(h) + 1) & (2**64 - 1)], np.uint64))[0]
        grams, doc = np.concatenate((grams, own)), np.concatenate((doc, short))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])))
        grams, doc = grams[new], doc[new]
    return grams, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))


def minhash(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima of each non-empty set, 16 bits of each; zeros for empty ones."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for k, seed in enumerate(_SEEDS):
            out[full, k] = np.minimum.reduceat(((grams * seed) >> np.uint64(32)).astype(np.uint32), starts).astype(np.uint16)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """The ROWS values of each band as one number."""
    return signature.view(np.int64).reshape(len(signature), BANDS)


def set_keys(grams: np.ndarray, offsets: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; a text without words is keyed by its bytes."""
    out = []
    for salt in (np.uint64(0x51ED270B), np.uint64(0xD6E8FEB86659FD93)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(grams ^ salt), dtype=np.uint64)))
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    for i in np.flatnonzero(np.diff(offsets) == 0):
        raw = np.frombuffer(texts[i].encode("utf-8", "replace") + b"\x01", np.uint8).astype(np.uint64)
        for k in (0, 1):
            place = mix(np.arange(1, len(raw) + 1, dtype=np.uint64) * np.uint64(2 * k + 3))
            out[k][i] = mix(np.array([int(((raw + np.uint64(7)) * place).sum(dtype=np.uint64))], np.uint64))[0]
    return out[0].view(np.int64), out[1].view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tag, size, k1, k2, n, bands) for every row: tag and bytes of its text, keys and size of its set, its bands."""

    def run(texts: list[str]) -> dict:
        out: dict = {"k1": [], "k2": [], "n": [], "bands": []}
        for first, last in chunks(texts):
            part = texts[first:last]
            grams, offsets = shingles(part)
            n = np.diff(offsets)
            for name, own in zip(("k1", "k2"), set_keys(grams, offsets, part), strict=True):
                out[name].append(own)
            out["n"].append(n)
            out["bands"] += [row if m else row[:0] for row, m in zip(bands(minhash(grams, offsets)), n, strict=True)]
        return out | {k: np.concatenate(out[k] or [np.zeros(0, np.int64)]) for k in ("k1", "k2", "n")}

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(F.col(text)).alias("tag"), F.octet_length(body).cast("long").alias("size"), body.alias("_text"))
    return map_texts(rows, lambda: run, {"k1": "long", "k2": "long", "n": "long", "bands": "array<long>"})


def posterior(matches: int, of: int) -> float:
    """P(similarity >= threshold) given ``matches`` equal values of ``of``: a binomial tail."""
    t, n = PART / WHOLE, of + 1
    return sum(math.comb(n, i) * t**i * (1 - t) ** (n - i) for i in range(matches + 1))


#: Matches needed after each chunk for a pair to stay.
NEEDED = [next(m for m in range(h + 1) if posterior(m, h) >= TOLERANCE) for h in range(CHUNK, HASHES + 1, CHUNK)]


def prune(a: np.ndarray, b: np.ndarray, signature: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (a, b) of sets that may reach the threshold: by size, then by MinHash."""
    near = (np.minimum(n[a], n[b]) * WHOLE >= np.maximum(n[a], n[b]) * PART) & (n[a] > 0)
    a, b = a[near], b[near]
    same = np.zeros(len(a), np.int32)
    for k, needed in enumerate(NEEDED):
        if not len(a):
            break
        part = signature[:, k * CHUNK : (k + 1) * CHUNK]
        same += (part[a] == part[b]).sum(1, dtype=np.int32)
        stay = same >= needed
        a, b, same = a[stay], b[stay], same[stay]
    return a, b


def similar_pairs(grams: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of sets at the threshold: inside ``left``, or across ``left`` and ``right``."""
    signature, n = minhash(grams, offsets), np.diff(offsets)
    if right is None:
        i, j = np.triu_indices(len(left), 1)
        a, b = left[i], left[j]
    else:
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    parts = [prune(a[k : k + PAIRS], b[k : k + PAIRS], signature, n) for k in range(0, len(a), PAIRS)]
    a, b = (np.concatenate([p[side] for p in parts] or [np.zeros(0, np.int64)]) for side in (0, 1))
    if not len(a):
        return a, b
    if len(a) <= 64:
        sets = {x: grams[offsets[x] : offsets[x + 1]] for x in {*a.tolist(), *b.tolist()}}
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        common = _common(grams, offsets, a, b)
    true = (PART + WHOLE) * common >= PART * (n[a] + n[b])
    return a[true], b[true]


def _common(grams: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of many pairs, by products of 0/1 matrices."""
    rows, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.full(len(offsets) - 1, -1)
    place[rows] = np.arange(len(rows))
    keep = place[owner] >= 0
    values, column, times = np.unique(grams[keep], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    number = np.full(len(values), -1)
    number[shared] = np.arange(len(shared))
    r, c = place[owner[keep]], number[column]
    r, c = r[c >= 0], c[c >= 0]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for first in range(0, len(shared), 2048):
        lo, hi = np.searchsorted(c, (first, first + 2048))
        m = np.zeros((len(rows), 2048), np.float32)
        m[r[lo:hi], c[lo:hi] - first] = 1
        total += m @ m.T
    return total[at[: len(a)], at[len(a) :]].astype(np.int64)


def lowest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group, under the links (a, b)."""
    root = np.arange(count)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def sift(batches):
    """Links (a, b) that join the nodes of pairs which pruning leaves, at most one a row.

    Rows come sorted by band and pair of blocks; all groups of a batch are compared at once.
    """

    def pairs(group: np.ndarray):
        """All pairs inside groups, by distance, in portions."""
        at, d, a, b, held = np.arange(len(group)), 1, [], [], 0
        while len(at := at[at + d < len(group)]) and len(at := at[group[at] == group[at + d]]):
            a.append(at)
            b.append(at + d)
            held, d = held + len(at), d + 1
            if held >= PAIRS:
                yield np.concatenate(a), np.concatenate(b)
                a, b, held = [], [], 0
        if held:
            yield np.concatenate(a), np.concatenate(b)

    def settle(pos, group, i, j, block, node, n, keys):
        names, own = np.unique(node, return_inverse=True)
        signature, left, right = keys.view(np.uint16), [], []
        for a, b in pairs(group):
            # A pair belongs to its two blocks, and to the first band that it shares.
            stay = (i[a] == j[a]) | (block[a] != block[b])
            a, b = a[stay], b[stay]
            for p in range(BANDS):
                if not len(a) or p >= pos[a].max():
                    break
                stay = (pos[a] <= p) | (keys[a, p] != keys[b, p])
                a, b = a[stay], b[stay]
            a, b = prune(a, b, signature, n)
            left.append(own[a])
            right.append(own[b])
        left, right = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (left, right))
        root = lowest(len(names), left, right)
        joined = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[joined]), pa.array(names[root[joined]])], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = {c: batch.column(c) for c in batch.schema.names}
        cols = [own[c].to_numpy() for c in ("pos", "value", "i", "j", "block", "node", "n")]
        cols.append(own["bands"].flatten().to_numpy().reshape(-1, BANDS))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)))
        last = int(np.flatnonzero(new)[-1])
        held = [c[last:] for c in cols]
        if last:
            pos, _, *rest = (c[:last] for c in cols)
            yield settle(pos, np.cumsum(new[:last]), *rest)
    if held is not None:
        pos, _, *rest = held
        yield settle(pos, np.zeros(len(pos), np.int64), *rest)


def compare(frames, key: tuple[str, ...]):
    """Compare the groups of a stream of rows sorted by ``key``; one group in memory at a time."""
    held: list[pd.DataFrame] = []

    def settle():
        g = pd.concat(held) if len(held) > 1 else held[0]
        texts = list(g["text"])
        grams, offsets = shingles(texts)
        k1, _ = set_keys(grams, offsets, texts)
        # Rows that repeat a doc_id and a text bring one node several times; once counts.
        fit = np.flatnonzero(k1 == g["node"].to_numpy())
        node, at = np.unique(k1[fit], return_index=True)
        rows = fit[at]
        block, (i, j) = g["block"].to_numpy()[rows], (int(g["i"].iloc[0]), int(g["j"].iloc[0]))
        a, b = similar_pairs(grams, offsets, rows[block == i], None if i == j else rows[block == j])
        if not len(a):
            return None
        index = np.full(len(texts), -1)
        index[rows] = np.arange(len(rows))
        a, b = index[a], index[b]
        links = np.bincount(np.concatenate((a, b)), minlength=len(rows))
        have = links > 0
        return pd.DataFrame({"node": node[have], "links": links[have], "root": node[lowest(len(rows), a, b)[have]]})

    last = None
    for pdf in frames:
        if not len(pdf):
            continue
        cols = [pdf[k].to_numpy() for k in key]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        bounds = [0, *edge.tolist(), len(pdf)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            now = tuple(c[lo] for c in cols)
            if held and now != last:
                if (out := settle()) is not None:
                    yield out
                held.clear()
            last = now
            held.append(pdf.iloc[lo:hi])
    if held and (out := settle()) is not None:
        yield out


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Rows (node, blocks, ...) with ``block``, once for each pair (i, j) of blocks that theirs is in."""
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for every row of ``docs``.

    ``class_id`` is the smallest doc_id of the class; ``n_links`` counts the different sets at
    a similarity of 0.8 or more; ``n_copies`` the rows with the same set.  A text without
    words (null, empty, punctuation) links to nothing and is a copy only of equal texts.
    Rows with a null doc_id take part; a class of such rows only has a null class_id.  Rows
    that repeat a doc_id are answered each; a text of any length counts whole; an empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    return _classes(docs, text)[0].select("doc_id", "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """:func:`classes` with the tags of the row's text (tag) and of the first document's (class_tag); and the tables that it reads."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag", "size"))
    prints = materialise(fingerprints(docs, text), "similar-prints")
    reps = prints.groupBy("k1", "k2").agg(first.alias("rep"), F.count("*").alias("n_copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    reps = materialise(reps.withColumnRenamed("k1", "node"), "similar-reps")
    banded = reps.select("node", F.posexplode("bands").alias("pos", "value"))
    shared = banded.groupBy("pos", "value").agg(F.count("*").alias("m")).filter("m > 1").select("pos", "value", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    shared = materialise(shared, "similar-bands")
    met = materialise(_block_pairs(banded.join(shared.hint("merge"), ["pos", "value"])), "similar-met")
    key = ("pos", "value", "i", "j")
    asked = met.join(reps.select("node", "n", "bands").hint("merge"), "node").repartition(*key).sortWithinPartitions(*key)
    loose = components(asked.mapInArrow(sift, "a long, b long"))
    sized = loose.join(reps.select("node", "rep").hint("merge"), "node").select("root", "node", "rep")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("rep.size") / BLOCK_BYTES, F.lit(1))).cast("int")
    sizes = materialise(sized.groupBy("root").agg(blocks.alias("blocks")), "similar-sizes")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(F.col(text)).alias("tag"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Sorted and merged at every size: whether the members could be sent to all depends on chance.
    named = sized.join(sizes, "root")
    given = named.join(body.hint("merge"), F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.tag") == F.col("tag"))).select("root", "node", "blocks", "text")
    key = ("root", "i", "j")
    found = materialise(
        _block_pairs(given).repartition(*key).sortWithinPartitions(*key).mapInPandas(lambda frames: compare(frames, key), "node long, links long, root long"),
        "similar-links",
    )
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = reps.select("node", "k2", F.struct("rep.unnamed", "rep.doc_id", "rep.tag").alias("rep"), "n_copies").join(label, "node", "left").join(links, "node", "left")
    nodes = materialise(nodes, "similar-nodes")
    named = materialise(nodes.filter("root is not null").groupBy("root").agg(F.min("rep").alias("named")), "similar-names")
    full = nodes.join(named, "root", "left").select(F.col("node").alias("k1"), "k2", F.coalesce("named", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    full = materialise(full, "similar-classes")
    discard(reps, shared, met, loose, sizes, found, label, nodes, named)
    rows = prints.select("doc_id", "tag", "k1", "k2").join(full, ["k1", "k2"])
    return rows.select("doc_id", "tag", F.col("class.doc_id").alias("class_id"), F.col("class.tag").alias("class_tag"), "n_links", "n_copies"), (prints, full)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def distinct_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest doc_id.

    doc_id and text name a document; rows that repeat both are one, of which the row stays
    whose other columns, as JSON, come first.  Rows without a doc_id stay only if their class
    has no document with one, and then one does.
    """
    rows, tables = _classes(docs)
    found = materialise(rows, "similar-result")
    discard(*tables)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tag") == F.col("class_tag"))
    gone = found.filter(~stays).select(F.col("doc_id").alias("gone"), F.col("tag").alias("gone_tag")).distinct()
    kept = docs.join(gone.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(gone["gone"]) & (text_tag(docs["text"]) == gone["gone_tag"]), "left_anti")
    repeated = found.groupBy("doc_id", "tag").count().filter("count > 1").limit(1).count()
    if not repeated:
        return kept
    name = "_tag" + "_" * max(map(len, docs.columns))
    rest = F.to_json(F.struct(*[kept[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]))
    place = F.row_number().over(Window.partitionBy(kept["doc_id"], text_tag(kept["text"])).orderBy(rest))
    return kept.withColumn(name, place).filter(F.col(name) == 1).drop(name)
