"""Phrase search by a positional inverted index that is kept up to date.

A segment holds the postings of some rows: for each word and column of a row, where the word
stands.  Postings of one word and column lie in blocks of some rows, blocks in buckets by word, and
within a bucket in order of the word, so a search reads the buckets of its words and of these the
row groups that hold them; a word of very many rows spans several files.  A change adds a segment for the rows it touches, whose older postings
no longer count; segments are merged once there are many.  What a search sees is a version: the
list of its segments.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import tokens, wanted_words

BUCKETS = 64
#: Segments beyond which a change merges them all into one.
MAX_SEGMENTS = 8

_POSTINGS = "token string, place int, id long, at array<int>, bucket int"
#: Postings of some rows in a row of a file: ids, where each one's places end, the places.
_BLOCKS = "token string, place int, ids array<long>, ends array<int>, at array<int>"

#: Places in a block, besides those of its last id; blocks that a task sorts; bytes of text that are parted at once.
BLOCK, BLOCKS_A_TASK, TEXT = 128, 50_000, 1 << 22


def _blocks(words: pa.Array, place: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Blocks of occurrences (word, column, id, where); those of one posting stand together, in order."""
    words = words.dictionary_encode()
    n = max(len(words.dictionary), 1)
    key = place.astype(np.int64) * n + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, ids, at = key[order], ids[order], at[order]
    new = np.diff(key, prepend=-1) != 0
    first = np.flatnonzero(new | (np.diff(ids, prepend=0) != 0))
    inside = first - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))[first]
    heads = np.flatnonzero(new[first] | (np.diff(inside // BLOCK, prepend=0) != 0))
    start = first[heads]
    many = np.diff(np.append(heads, len(first)))
    ends = np.append(first[1:], len(key))[: len(first)] - np.repeat(start, many)
    lists = lambda cut, size, x, kind: pa.ListArray.from_arrays(pa.array(np.append(cut, size), pa.int32()), pa.array(x, kind))
    return pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(key[start] % n)),
            pa.array(key[start] // n, pa.int32()),
            lists(heads, len(first), ids[first], pa.int64()),
            lists(heads, len(first), ends, pa.int32()),
            lists(start, len(key), at, pa.int32()),
        ],
        ["token", "place", "ids", "ends", "at"],
    )


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of rows (id, words of each column joined by spaces) in blocks."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for place, texts in enumerate(batch.columns[1:]):
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            cuts = np.flatnonzero(np.diff(size // TEXT)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                parted = pc.split_pattern(texts.slice(lo, hi - lo), " ")
                many = pc.fill_null(pc.list_value_length(parted), 0).to_numpy()
                words = parted.flatten()
                at = np.arange(len(words)) - np.repeat(np.cumsum(many) - many, many)
                real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
                if real.any():
                    yield _blocks(words.filter(pa.array(real)), np.full(int(real.sum()), place), np.repeat(ids[lo:hi], many)[real], at[real])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (token, place, id, at) in blocks."""
    for batch in batches:
        token, place, ids, at = batch.columns
        of = np.repeat(np.arange(len(ids)), pc.list_value_length(at).to_numpy())
        if len(of):
            yield _blocks(token.take(pa.array(of)), place.to_numpy()[of], ids.to_numpy()[of], at.flatten().to_numpy())


def _opened(blocks: DataFrame) -> DataFrame:
    """A row a posting."""
    before = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    rows = F.transform("ids", lambda i, k: F.struct(i.alias("id"), F.slice("at", before(k) + 1, F.get("ends", k) - before(k)).alias("at")))
    return blocks.select("token", "place", F.inline(rows), *(["bucket"] if "bucket" in blocks.columns else []))


class PhraseIndex:
    """The index of ``columns`` of rows with a long ``id``, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.root, self.columns, self.buckets = spark, root.rstrip("/"), tuple(columns), buckets

    def _children(self, folder: str) -> list[str]:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(target) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(target) else []

    def version(self) -> int:
        return max((int(n[1:]) for n in self._children(f"{self.root}/versions")), default=0)

    def segments(self) -> list[str]:
        """Folders of the latest version's segments, the oldest first."""
        v = self.version()
        return [r["folder"] for r in self.spark.read.schema("n int, folder string").parquet(f"{self.root}/versions/v{v}").orderBy("n").collect()] if v else []

    def _commit(self, version: int, segments: list[str]) -> None:
        # The folder of a version is written once: of two writers one fails.
        self.spark.createDataFrame(list(enumerate(segments)), "n int, folder string").coalesce(1).write.parquet(f"{self.root}/versions/v{version + 1}")

    def _bucket(self, token):
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _write(self, blocks: DataFrame, touched: DataFrame) -> str:
        folder = f"{self.root}/segments/{uuid.uuid4().hex}"
        # Written as they come first: dealing by ranges reads its rows twice.
        blocks.write.parquet(f"{folder}/raw")
        raw = self.spark.read.schema(_BLOCKS).parquet(f"{folder}/raw").withColumn("bucket", self._bucket(F.col("token")))
        # Blocks are small, so a task's share is too, however many there are.
        tasks = -(-raw.count() // BLOCKS_A_TASK) or 1
        order = ("bucket", "token", F.get("ids", F.lit(0)))
        raw.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{folder}/postings")
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/raw")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        touched.write.parquet(f"{folder}/touched")
        return folder

    def _blocks_of(self, rows: DataFrame, id_: str) -> DataFrame:
        texts = rows.select(F.col(id_).cast("long").alias("id"), *[F.trim(tokens(F.col(c).cast("string"))).alias(f"c{k}") for k, c in enumerate(self.columns)])
        return texts.mapInArrow(_posted, _BLOCKS)

    def postings_of(self, rows: DataFrame, id_: str = "id") -> DataFrame:
        """(token, place, id, at): where the words of each column stand; null and wordless texts have none.

        Local to a row: nothing is shuffled for it.
        """
        return _opened(self._blocks_of(rows, id_))

    def update(self, rows: DataFrame, removed: DataFrame | None = None, id_: str = "id") -> None:
        """Index ``rows`` (new or changed ones, ids unique) and forget the ids of ``removed``."""
        version, before = self.version(), self.segments()
        ids = rows.select(F.col(id_).cast("long").alias("id"))
        if removed is not None:
            ids = ids.unionByName(removed.select(F.col(id_).cast("long").alias("id"))).distinct()
        if before and ids.isEmpty():
            return
        now = [*before, self._write(self._blocks_of(rows, id_), ids)]
        if len(now) > MAX_SEGMENTS:
            live = self._live(now)
            now = [self._write(live.drop("bucket").mapInArrow(_packed, _BLOCKS), live.select("id").distinct())]
        self._commit(version, now)

    def _live(self, segments: list[str], words: list[str] | None = None) -> DataFrame:
        """Postings that count, of some words: of each id those of the last segment that touched it."""
        parts, later = [], None
        for folder in reversed(segments):
            own = self.spark.read.schema(f"{_BLOCKS}, bucket int").parquet(f"{folder}/postings")
            if words is not None:
                # Hashes of literals are folded, so only the folders of these buckets are listed and read.
                own = own.filter(F.col("bucket").isin([self._bucket(F.lit(w)) for w in words]) & F.col("token").isin(words))
            own = _opened(own)
            parts.append(own if later is None else own.join(later, "id", "left_anti").select(own.columns))
            touched = self.spark.read.schema("id long").parquet(f"{folder}/touched")
            later = touched if later is None else later.unionByName(touched)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _POSTINGS)

    def postings(self, words: list[str]) -> DataFrame:
        """The postings of some words, from the buckets that hold them."""
        return self._live(self.segments(), words)

    def search(self, text: str) -> DataFrame | None:
        """(id) of the rows in one of whose columns the words of ``text`` stand together; None for a blank text.

        The rarest word comes first: what the others add is met with its rows only.
        """
        wanted = wanted_words(text)
        if wanted is None:
            return None
        none = self.spark.createDataFrame([], "id long")
        if not wanted:
            return none
        places: dict[str, list[int]] = {}
        for k, word in enumerate(wanted):
            places.setdefault(word, []).append(k)
        rows = self.postings(list(places))
        size = {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count("*").alias("n")).collect()} if len(places) > 1 else {}
        if size and len(size) < len(places):
            return none

        def starts(word: str):
            """Where a phrase would begin whose words ``word`` stand right."""
            back = lambda k: lambda p: p - k
            return reduce(F.array_intersect, [F.transform("at", back(k)) for k in places[word]])

        found = None
        for word in sorted(places, key=lambda w: (size.get(w, 0), w)):
            own = rows.filter(F.col("token") == word).select("id", "place", starts(word).alias("s"))
            if found is None:
                found = own
            else:
                found = found.join(own.withColumnRenamed("s", "t"), ["id", "place"]).select("id", "place", F.array_intersect("s", "t").alias("s"))
            found = found.filter(F.size("s") > 0)
        return found.select("id").distinct()
