"""Centroid clustering of integer vectors by blocked matrix products.

Vectors travel as blocks: one row holds up to ``BLOCK`` of them as packed integers of the
narrowest kind that fits.  A block's squared distances are ``|x|^2 - 2 x.c + |c|^2`` by one
matrix product in float64, which is exact while ``(|x| + |c|)^2`` stays under 2**53, since
every partial sum is then an integer that a double holds.  Rows beyond that bound go by
64-bit integers, and beyond theirs by Python's integers, so results never depend on rounding.
A round sends home, by ``treeAggregate``, one sum and count a centroid and partition: what
the driver gets is bounded by the number of centroids and of components alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, materialise

#: Production parameters of the query.
SIZE, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
#: Vectors of a block.
BLOCK = 4096
#: A float64 holds every integer up to this one, a long up to LONG.
EXACT, LONG = 2**53, 2**63 - 1
_KINDS = (np.int16, np.int32, np.int64)
_STORED = "ids binary, kind int, values binary, size int"


def usable(vector: Column, size: int = SIZE) -> Column:
    """True where an array has exactly ``size`` components, none null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as bytes of the narrowest kind; kind 3 is decimal text."""
    top = max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0
    for kind, dtype in enumerate(_KINDS):
        if top <= np.iinfo(dtype).max:
            return kind, values.astype(dtype).tobytes()
    return len(_KINDS), " ".join(str(v) for v in values.ravel()).encode()


def _unpack(kind: int, data: bytes, n: int) -> np.ndarray:
    if kind < len(_KINDS):
        return np.frombuffer(data, _KINDS[kind]).reshape(n, -1).astype(np.int64)
    return np.array([int(v) for v in data.split()], object).reshape(n, -1)


def pack_blocks(vectors: DataFrame, vector: str, id_col: str, size: int = SIZE) -> DataFrame:
    """Blocks of the usable vectors as integers floor(256 * x); ids may be null or repeated."""
    rows = vectors.filter(usable(F.col(vector), size)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = np.floor(256.0 * part.column(1).flatten().to_numpy(zero_copy_only=False))
                # Beyond 2**53 a double is a whole number already, and Python's integers take it as it is.
                small = not len(flat) or np.abs(flat).max() < 2.0**62
                values = flat.astype(np.int64) if small else np.array([int(v) for v in flat], object)
                kind, data = _pack(values)
                ids = part.column(0)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as out:
                    out.write_batch(pa.record_batch([pa.array(ids.to_pylist(), pa.int64())], ["id"]))
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), pa.array([part.num_rows], pa.int32())], ["ids", "kind", "values", "size"])

    return rows.mapInArrow(run, _STORED)


def first_centroids(vectors: DataFrame, vector: str, id_col: str, k: int = CENTROIDS, seed: int = SEED, size: int = SIZE) -> list[list[int]]:
    """The ``k`` usable vectors with the smallest hex SHA-256 of ``seed:id``, in that order.

    A null id counts as empty; vectors of one id go in the order of their components.
    """
    rows = vectors.filter(usable(F.col(vector), size)).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("h"), F.col(vector).cast("array<double>").alias("x"))
    return [[int(np.floor(256.0 * v)) for v in r["x"]] for r in rows.orderBy("h", "x").limit(k).collect()]


class Nearest:
    """Nearest of a set of whole-number centroids, squared Euclidean, ties to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, object).reshape(len(centroids), -1)
        self.norms = [sum(int(v) * int(v) for v in c) for c in self.exact]
        self.longest = max(self.norms, default=0) ** 0.5
        self.fits = all(abs(int(v)) < 2**31 for v in self.exact.ravel())
        if self.fits:
            self.longs = self.exact.astype(np.int64)
            self.doubles = np.ascontiguousarray(self.longs.T, dtype=np.float64)

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row; distances are Python's integers where a long is too short."""
        n = len(values)
        label, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if values.dtype == object or not self.fits:
            return self._by_integers(values.astype(object))
        x = values.astype(np.float64)
        # A hair over the true norm: the bound must hold in whole numbers.
        reach = (np.sqrt((x * x).sum(1)) * (1 + 1e-9) + self.longest * (1 + 1e-9)) ** 2
        fast, middle = reach < EXACT, (reach >= EXACT) & (reach < 2.0**62)
        if fast.any():
            own = x[fast]
            d = (own * own).sum(1)[:, None] - 2.0 * (own @ self.doubles) + np.array(self.norms, np.float64)
            label[fast] = d.argmin(1)
            distance[fast] = d.min(1).astype(np.int64)
        for i in np.flatnonzero(middle):
            d = ((values[i] - self.longs) ** 2).sum(1)
            label[i], distance[i] = d.argmin(), d.min()
        if (reach >= 2.0**62).any():
            rest = np.flatnonzero(reach >= 2.0**62)
            distance = distance.astype(object)
            label[rest], distance[rest] = self._by_integers(values[rest].astype(object))
        return label, distance

    def _by_integers(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label, distance = np.zeros(len(values), np.int64), np.zeros(len(values), object)
        for i, row in enumerate(values):
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, c, strict=True)) for c in self.exact]
            distance[i] = min(d)
            label[i] = d.index(distance[i])
        return label, distance


def _sums(values: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (Python's integers) and counts a cluster of one block."""
    order = np.argsort(label, kind="stable")
    found, first = np.unique(label[order], return_index=True)
    total, count = np.zeros((k, values.shape[1]), object), np.bincount(label, minlength=k)
    if values.dtype != object and np.abs(values).max(initial=0) > LONG // max(len(values), 1):
        values = values.astype(object)
    total[found] = np.add.reduceat(values[order], first, axis=0).astype(object)
    return total, count.astype(object)


def _plus(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def _gather(blocks: DataFrame, centroids: list[list[int]], measure):
    """Sum of what ``measure(values, label, distance)`` gives for every block, or None if there is no block."""

    def part(rows):
        near, total = Nearest(centroids), None
        for r in rows:
            values = _unpack(r["kind"], bytes(r["values"]), r["size"])
            total = _plus(total, measure(values, *near(values)))
        yield total

    return blocks.select("kind", "values", "size").rdd.mapPartitions(part).treeAggregate(None, _plus, _plus)


def refine(blocks: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after ``rounds`` assignments, each followed by floor(sum / count) of every non-empty cluster."""
    k = len(centroids)
    for _ in range(rounds if k else 0):
        got = _gather(blocks, centroids, lambda values, label, distance: _sums(values, label, k))
        if got is None:
            break
        total, count = got
        centroids = [[int(v) // int(count[c]) for v in total[c]] if count[c] else centroids[c] for c in range(k)]
    return centroids


def inertia(blocks: DataFrame, centroids: list[list[int]]) -> list[int]:
    """Squared distances summed over each cluster."""
    k = len(centroids)

    def measure(values, label, distance):
        total = np.zeros(k, object)
        for c in range(k):
            own = distance[label == c]
            # In halves, so that sums of longs do not overflow.
            total[c] = sum(int(v) for v in own) if own.dtype == object else (int((own >> 32).sum()) << 32) + int((own & 0xFFFFFFFF).sum())
        return (total,)

    got = _gather(blocks, centroids, measure)
    return [int(v) for v in got[0]] if got else [0] * k


def assign(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector; a squared distance that no long holds is null."""

    def run(batches):
        near = Nearest(centroids)
        for batch in batches:
            for r in batch.to_pylist():
                label, distance = near(_unpack(r["kind"], r["values"], r["size"]))
                ids = pa.ipc.open_stream(r["ids"]).read_all().column(0).combine_chunks()
                far = distance if distance.dtype != object else [int(d) if d <= LONG else None for d in distance]
                yield pa.record_batch([ids, pa.array(label, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return blocks.mapInArrow(run, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Arrays of another length and those with a null, NaN or infinite component have no row;
    nor have empty tables.  Fewer than ``k`` usable vectors make as many centroids.  Ids may
    be null or repeated: each row stands for itself.  Sums and distances that no long holds
    are null.  Of other columns none is read, so their names may clash.
    """
    spark = vectors.sparkSession
    start = first_centroids(vectors, vector, id_col, k, seed, size)
    if not start:
        return spark.createDataFrame([], StructType([StructField(id_col, LongType())])).selectExpr(f"`{id_col}`", *(f"cast(null as {t}) as {c}" for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    blocks = materialise(pack_blocks(vectors, vector, id_col, size), "centroid-blocks")
    last = refine(blocks, start, rounds)
    own = inertia(blocks, last)
    fits = lambda v: v if v <= LONG else None
    facts = spark.createDataFrame(
        [(c, fits(own[c]), fits(sum(own)), hashlib.sha256(",".join(map(str, last[c])).encode()).hexdigest()) for c in range(len(last))],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # One row a centroid: bounded by k.
    return assign(blocks, last).join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds written out one after the other."""
    near = "SELECT vec_id, k, d FROM (SELECT v.vec_id, c.k, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.a, c.c)])::BIGINT AS d FROM v CROSS JOIN c{i} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1"
    parts = [
        f"v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS a FROM embeddings WHERE len(embedding) = {SIZE} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, a AS c FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS):
        parts.append(f"n{i} AS MATERIALIZED ({near.format(i=i)})")
        parts.append(f"s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT n.k, unnest(v.a) AS x, unnest(range(1, {SIZE + 1})) AS j FROM n{i} n JOIN v USING (vec_id)) GROUP BY 1, 2)")
        parts.append(f"m{i} AS (SELECT k, list((((s - ((s % n + n) % n)) // n))::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY 1)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (k))")
    parts.append(f"z AS MATERIALIZED ({near.format(i=ROUNDS)})")
    return f"WITH {', '.join(parts)} SELECT z.vec_id, z.k::INTEGER AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.k))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} c USING (k)"


#: Vectors of one id are one here; the given tables have none.
OP11_SQL = _sql()
