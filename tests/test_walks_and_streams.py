"""Listings of folders as a data source, timed flushes and catalogues kept by streams."""

from __future__ import annotations

import os
import time

import pytest

from marram.operators import changes as X
from marram.sources import folders
from marram.sources.versioned import KeyedTable
from marram.streaming import live as L


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib"
    for name, size in {"a.mp3": 3, "empty.flac": 0, "cover.jpg": 5, "x/b.OGG": 1, "x/y/c.txt": 2, "x/y/d.wav": 4, ".git/e.mp3": 9, "x/@eaDir/f.mp3": 9, "é/ü.opus": 1}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"z" * size)
    other = tmp_path / "other"
    other.mkdir()
    (other / "g.mp3").write_bytes(b"gg")
    os.symlink(other, root / "linked")
    os.symlink(root / "a.mp3", root / "x" / "same.mp3")
    os.symlink(root / "nowhere", root / "broken.mp3")
    os.symlink(root, root / "x" / "loop")
    return root


def listed(df, root):
    return {os.path.relpath(r["path"], root): (r["size_bytes"], r["symlink"]) for r in df.collect()}


@pytest.mark.parametrize("spread", [1, 3, 256])
def test_walks_see_empty_files_and_links(spark, tree, monkeypatch, spread):
    monkeypatch.setattr(folders, "SPREAD", spread)
    own = {"a.mp3": (3, False), "empty.flac": (0, False), "cover.jpg": (5, False), "x/b.OGG": (1, False), "x/y/c.txt": (2, False), "x/y/d.wav": (4, False), "é/ü.opus": (1, False)}
    got = listed(folders.walk(spark, str(tree), ignored=X.EXCLUDED), tree)
    assert {k: v for k, v in got.items() if not v[1]} == own and {k for k, v in got.items() if v[1]} == {"x/same.mp3", "broken.mp3", "linked", "x/loop"}
    assert listed(folders.walk(spark, f"file://{tree}", True, X.EXCLUDED), tree) == own | {"linked/g.mp3": (2, False), "x/same.mp3": (3, True)}
    assert set(listed(folders.walk(spark, str(tree)), tree)) == set(got) | {".git/e.mp3", "x/@eaDir/f.mp3"}


def test_audio_files_of_a_folder_or_a_file(spark, tree):
    names = lambda df: {os.path.relpath(r["path"], tree): r["size_bytes"] for r in df.collect()}
    assert names(X.walk_audio(spark, str(tree))) == {"a.mp3": 3, "empty.flac": 0, "x/b.OGG": 1, "x/y/d.wav": 4, "é/ü.opus": 1}
    assert set(names(X.walk_audio(spark, str(tree), True))) == {"a.mp3", "empty.flac", "x/b.OGG", "x/y/d.wav", "é/ü.opus", "linked/g.mp3", "x/same.mp3"}
    assert names(X.walk_audio(spark, str(tree / "a.mp3"))) == {"a.mp3": 3}
    assert names(X.walk_audio(spark, str(tree / "cover.jpg"))) == {} == names(X.walk_audio(spark, str(tree / "none")))
    # A root below an excluded name is walked.
    assert names(X.walk_audio(spark, str(tree / ".git"))) == {".git/e.mp3": 9}


def test_passed_over_folders_are_not_opened(tree, monkeypatch):
    opened = []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(str(p)) or scan(p))
    reader = folders._Reader({"path": str(tree), "ignored": "/".join(X.EXCLUDED)})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert len(rows) == 11 and not any(".git" in p or "@eaDir" in p for p in opened)


def test_a_quiet_key_gives_its_last_row(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.1, 2.0), (1, 0.2, 3.0), (2, 5.0, 9.0), (3, 0.0, 1.0), (3, 0.3, 2.0), (3, 0.4, 7.0)], "key long, at double, value double")
        rows.coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        query = L.throttle_stream(stream).writeStream.format("memory").queryName("throttled").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
        want = {(1, 0.0, 1.0, False), (1, 0.2, 3.0, True), (2, 5.0, 9.0, False), (3, 0.0, 1.0, False), (3, 0.3, 2.0, False), (3, 0.4, 7.0, True)}
        try:
            for _ in range(300):
                got = [tuple(r) for r in spark.table("throttled").collect()]
                if len(got) >= len(want):
                    break
                time.sleep(0.2)
        finally:
            query.stop()
        assert sorted(got) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_stream_of_listings_keeps_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/cat", L.CATALOG, ["path"], buckets=8)
    table.merge(spark.createDataFrame([(f"lib/{i}", i, 1, 5 if i == 3 else None) for i in range(40)], L.CATALOG))
    before = {r["bucket"]: r["path"] for r in table._manifest(1)}
    spark.createDataFrame([("lib/3", 3, 1), ("lib/3", 9, 2), ("new", 1, 1), ("lib/4", 4, 1)], "path string, size_bytes long, mtime long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, size_bytes long, mtime long").parquet(f"{tmp_path}/in")
    L.keep_catalog(stream, table, f"{tmp_path}/cp").awaitTermination()
    got = {r["path"]: tuple(r)[1:] for r in table.read().collect()}
    assert got == {f"lib/{i}": (i, 1, None) for i in range(40) if i != 3} | {"lib/3": (9, 2, None), "new": (1, 1, None)}
    assert sum(r["path"] != before[r["bucket"]] for r in table._manifest(table.version())) <= 2
    # The same batch once more changes nothing.
    L.keep_catalog(stream, table, f"{tmp_path}/cp2").awaitTermination()
    assert table.version() == 2
