"""Tables with a key that are changed by merging, a bucket at a time.

A row's bucket is the hash of its key.  A merge reads the buckets that its changes fall into,
writes those in which a row really changes, and then writes a version: the folder of every
bucket.  Readers see whole versions only; the version's folder can be written once, so of two
writers that started from the same version one fails and can try again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

BUCKETS = 64


class KeyedTable:
    """A table of ``schema`` (DDL) under ``root``, one row for each value of ``keys`` (nulls are values)."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.columns = spark.createDataFrame([], schema).columns
        found = self._manifest(self.version())
        # The number of buckets is that of the first merge.
        self.buckets = found[0]["buckets"] if found else buckets

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        fs, target = self._fs(f"{self.root}/versions")
        if not fs.exists(target):
            return []
        names = [f.getPath() for f in fs.listStatus(target)]
        return sorted(int(p.getName()[1:]) for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def version(self) -> int:
        """The latest version, 0 where there is none."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> list:
        if not version:
            return []
        return self.spark.read.schema("bucket int, path string, buckets int").parquet(f"{self.root}/versions/v{version}").collect()

    def _of(self, rows: list) -> DataFrame:
        paths = [r["path"] for r in rows if r["path"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self._manifest(self.version() if version is None else version))

    def _bucket(self, of: str = "") -> Column:
        return F.pmod(F.xxhash64(*[F.col(of + k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame) -> dict[str, int]:
        """Put the rows of ``changes``, or remove those of its keys where ``removed`` is true.

        Gives the numbers of rows created, updated, removed and unchanged.  A merge that changes
        no row writes nothing and makes no version.  Of several changes of one key a put goes
        before a removal, and of puts the largest row is taken.  Changes may have other columns.
        """
        gone = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in changes.columns else F.lit(False)
        rows = changes.select(F.struct(*self.columns).alias("new"), gone.alias("gone"))
        rows = rows.withColumn("bucket", self._bucket("new."))
        rows = rows.groupBy("bucket", *[F.col(f"new.{k}").alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.max(F.struct((~F.col("gone")).alias("put"), "new")).alias("m"))
        rows = written(rows.select("bucket", *[f"_k{i}" for i in range(len(self.keys))], F.col("m.new").alias("new"), (~F.col("m.put")).alias("gone")), "merge-changes")
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        version = self.version()
        before = self._manifest(version)
        old = self._of([r for r in before if r["bucket"] in touched]).select(self._bucket().alias("bucket"), F.struct(*self.columns).alias("old"))
        same = reduce(Column.__and__, [rows["bucket"] == old["bucket"], *[rows[f"_k{i}"].eqNullSafe(F.col(f"old.{k}")) for i, k in enumerate(self.keys)]])
        what = F.when(F.col("gone"), F.when(F.col("old").isNotNull(), "removed")).when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "created").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
        both = rows.join(old, same, "full_outer").select(F.coalesce(rows["bucket"], old["bucket"]).alias("bucket"), what.alias("what"), F.when(F.coalesce("gone", F.lit(False)), F.lit(None)).otherwise(F.coalesce("new", "old")).alias("row"))
        both = written(both.filter("what is not null"), "merge-rows")
        count = {r["what"]: r["n"] for r in both.groupBy("what").agg(F.count("*").alias("n")).collect()}
        out = {k: count.get(k, 0) for k in ("created", "updated", "removed", "unchanged")}
        changed = {r["bucket"] for r in both.filter("what in ('created', 'updated', 'removed')").select("bucket").distinct().collect()}
        if not changed:
            return out
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        keep = both.filter(F.col("bucket").isin(sorted(changed)) & F.col("row").isNotNull()).select("bucket", "row.*")
        keep.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        fs, target = self._fs(folder)
        filled = {int(f.getPath().getName().split("=")[1]): f.getPath().toString() for f in fs.listStatus(target) if f.isDirectory()}
        paths = {r["bucket"]: r["path"] for r in before} | {b: filled.get(b) for b in changed}
        rows = [(b, p, self.buckets) for b, p in sorted(paths.items())]
        self.spark.createDataFrame(rows, "bucket int, path string, buckets int").coalesce(1).write.parquet(f"{self.root}/versions/v{version + 1}")
        return out

    def expire(self, keep: int = 2) -> int:
        """Forget all but the latest ``keep`` versions and delete folders that only those used; gives their number."""
        every = self.versions()
        stay, leave = every[-max(1, keep) :], every[: -max(1, keep)]
        folder = lambda path: path.rsplit("/", 1)[0]
        used = {folder(r["path"]) for v in stay for r in self._manifest(v) if r["path"]}
        old = {folder(r["path"]) for v in leave for r in self._manifest(v) if r["path"]} - used
        for path in [*(f"{self.root}/versions/v{v}" for v in leave), *old]:
            fs, target = self._fs(path)
            fs.delete(target, True)
        return len(leave)
