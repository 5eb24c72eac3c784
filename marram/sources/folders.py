"""A data source that lists a folder tree: ``spark.read.format("folder_listing")``.

The driver opens folders, the widest first, until there are enough to deal out; each task walks
the subtrees of its folders.  Folders that are passed over are never opened, empty files have a
row, and symbolic links are told apart.  The tree must be mounted on every executor; where
only Spark reaches the store, take ``marram.operators.changes.list_files``.
"""

from __future__ import annotations

import datetime
import os
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, size_bytes long, mtime timestamp, symlink boolean"
#: Folders that are dealt out at least, where a tree has as many, and those that the driver opens at most.
SPREAD, OPENED = 256, 512


class _Folders(InputPartition):
    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


def mounted(path: str) -> str:
    """A path as the file system has it, without the scheme of its address."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = mounted(options["path"]).rstrip("/") or "/"
        self.follow = str(options.get("followsymlinks", "false")).lower() == "true"
        self.ignored = frozenset(x for x in options.get("ignored", "").split("/") if x)

    def _entries(self, folder: str) -> tuple[list[str], list[str]]:
        """Subfolders to walk and files of a folder; one that cannot be opened is empty."""
        folders, files = [], []
        try:
            with os.scandir(folder) as found:
                for entry in found:
                    try:
                        if entry.is_dir(follow_symlinks=self.follow):
                            if entry.name not in self.ignored and not self._loops(entry):
                                folders.append(entry.path)
                        elif entry.is_symlink() or entry.is_file(follow_symlinks=False):
                            files.append(entry.path)
                    except OSError:
                        continue
        except OSError:
            pass
        return folders, files

    def _loops(self, entry: os.DirEntry) -> bool:
        """Does a linked folder hold itself?"""
        if not entry.is_symlink():
            return False
        real = os.path.realpath(entry.path)
        here = os.path.realpath(os.path.dirname(entry.path))
        return here == real or here.startswith(real.rstrip("/") + "/")

    def partitions(self) -> list[_Folders]:
        if not os.path.isdir(self.root):
            return [_Folders([], [self.root])] if os.path.isfile(self.root) else [_Folders([], [])]
        waiting, files = deque([self.root]), []
        for _ in range(OPENED):
            if not waiting or len(waiting) >= SPREAD:
                break
            more, own = self._entries(waiting.popleft())
            waiting.extend(sorted(more))
            files += own
        return [_Folders([folder], []) for folder in waiting] + [_Folders([], files[k : k + 10_000]) for k in range(0, len(files), 10_000)] or [_Folders([], [])]

    def _row(self, path: str) -> tuple | None:
        """A file's row; a link counts as a file where links are followed to one, and as a link otherwise."""
        link = os.path.islink(path)
        try:
            if link and self.follow and not os.path.isfile(path):
                return None
            stat = os.stat(path) if self.follow else os.lstat(path)
        except OSError:
            return None
        at = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC)
        return path, os.path.basename(path), stat.st_size, at, link

    def read(self, partition: _Folders) -> Iterator[tuple]:
        stack = list(partition.folders)
        yield from filter(None, map(self._row, partition.files))
        while stack:
            folders, files = self._entries(stack.pop())
            stack += folders
            yield from filter(None, map(self._row, files))


class FolderListing(DataSource):
    """Options: path (a folder, or one file), followSymlinks, ignored (names of folders, parted by ``/``)."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def walk(spark: SparkSession, root: str, follow_symlinks: bool = False, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, size_bytes, mtime, symlink) of the files below ``root``, or of ``root`` itself if it is a file.

    Without ``follow_symlinks`` links have a row of their own and linked folders are not
    walked; with it they count as what they lead to, broken ones have no row, and a linked
    folder that holds itself is passed over.  A root that is missing has no rows.
    """
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("followSymlinks", str(follow_symlinks).lower()).option("ignored", "/".join(ignored)).load(root)
