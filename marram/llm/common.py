"""Shared folder, materialised tables and vectorised word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts are handled in chunks of about this many characters inside a task.
CHUNK_CHARS = 250_000
#: So many bytes of text of an Arrow batch (10,000 rows) become Python strings at a time.
SLICE_BYTES = 4 * CHUNK_CHARS


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (``spark.checkpoint.dir``).

    Where a session on one machine names none (a test), a fresh local folder is set; a
    cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marram-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marram_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for df in tables:
        path = df._marram_path
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_tag(text: Column) -> Column:
    """With a doc_id, which may be null or repeated, what names a row: the hash of its text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def slices(batch: pa.RecordBatch, at: int):
    """The rows of ``batch`` in runs of about SLICE_BYTES of column ``at``, a row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(total):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def map_texts(rows: DataFrame, make: Callable[[], Callable[[list[str]], dict]], fields: dict[str, str], text: str = "_text") -> DataFrame:
    """``rows`` without ``text``, and ``fields`` as a function of the texts gives them.

    ``make`` is called once a task for that function, which takes the texts of a slice (null
    as empty) and gives a list or array a field.  All other columns pass by as Arrow, so
    they may have any type and a long beside a null keeps its value.
    """
    schema = StructType([f for f in rows.schema.fields if f.name != text] + [StructType.fromDDL(f"{n} {kind}").fields[0] for n, kind in fields.items()])

    def run(batches):
        own = make()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                got = own([t or "" for t in part.column(at).to_pylist()])
                made = [pa.array(got[n], _ARROW[kind]) for n, kind in fields.items()]
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != at] + made, schema.names)

    return rows.mapInArrow(run, schema)


def chunks(texts: list[str], limit: int = CHUNK_CHARS):
    """Yield (first, last) ranges of ``texts`` of about ``limit`` characters each."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _class_table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Letters, digits and every byte of a non-ASCII character.
ALNUM = _class_table(lambda b: b >= 0x80 or chr(b).isalnum())
#: Everything but the six ASCII white-space characters.
NOT_SPACE = _class_table(lambda b: b not in b" \t\n\v\f\r")

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a list of texts, flat: UTF-8 bytes, word bounds, 64-bit hashes, owner."""

    def __init__(self, texts: list[str], table: np.ndarray):
        parts = [t.encode("utf-8", "replace") for t in texts]
        self.raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        inside = table[self.raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        self.start, self.end = edges[0::2], edges[1::2]
        up, down = powers(len(self.raw) + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], dtype=np.uint64)))
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows and the index of each window's first word."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(m, np.uint64)
        for k in range(n):
            total = total * _MULT + self.hash[k : k + m]
        first = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(total[first]), first
