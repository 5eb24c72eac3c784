"""Runs of named stages over written tables, which go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Cancelled(Exception):
    """A run was asked to stop; the stages that were done stay done."""


class StagedRun:
    """Stages of a session, each a table under ``folder``/``session``.

    A stage is done when Spark has committed its table, so a run that starts again after a
    failure, a lost driver or a stop skips the stages that are done and reads their tables.
    """

    def __init__(self, spark: SparkSession, folder: str, session: str):
        self.spark, self.base = spark, f"{folder.rstrip('/')}/{session}"

    def _table(self, stage: str) -> DataFrame | None:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{stage}/_SUCCESS")
        found = mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)
        return self.spark.read.parquet(f"{self.base}/{stage}") if found else None

    def run(self, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], stop: Callable[[], bool] = lambda: False) -> dict[str, DataFrame]:
        """The table of every stage.  A stage is a function of the tables before it; ``stop`` is asked before each."""
        done: dict[str, DataFrame] = {}
        for name, stage in stages:
            if stop():
                raise Cancelled(f"stopped before {name}")
            found = self._table(name)
            if found is None:
                stage(done).write.mode("overwrite").parquet(f"{self.base}/{name}")
                found = self._table(name)
            done[name] = found
        return done

    def states(self, stages: list[str]) -> list[tuple[str, str]]:
        """(stage, done or pending), in order."""
        return [(s, "pending" if self._table(s) is None else "done") for s in stages]
