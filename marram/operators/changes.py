"""Incremental scans: listing against catalogue by path, size and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.sources.folders import mounted, walk

from .catalog import in_scope

#: Extensions that are catalogued, files beside them, folders that are passed over.
SUPPORTED = ("mp3", "flac", "ogg", "opus", "m4a", "wav", "aiff", "aif")
SIDECARS = ("cover.jpg", "folder.jpg", "album.jpg", "cover.png", "folder.png", "album.png")
EXCLUDED = (".git", "@eaDir", "$RECYCLE.BIN", ".Trash-1000")


def _name() -> F.Column:
    return F.regexp_extract("path", r"([^/]*)$", 1)


def file_class(root: str = "") -> F.Column:
    """excluded (below an excluded folder under ``root``), sidecar, supported or unsupported, of ``path``."""
    below = F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))
    folders = F.slice(F.split(below, "/"), F.lit(1), F.size(F.split(below, "/")) - 1)
    ext = F.lower(F.regexp_extract(_name(), r"(?<=.)\.([^.]+)$", 1))
    excluded = F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED)))
    return F.when(excluded, "excluded").when(F.lower(_name()).isin(*SIDECARS), "sidecar").when(ext.isin(*SUPPORTED), "supported").otherwise("unsupported")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, mtime, content) of the files below ``root``; content is read only if it is used.  Empty files have no row."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listing.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")


def walk_audio(spark: SparkSession, root: str, follow_symlinks: bool = False) -> DataFrame:
    """(path, size_bytes, mtime) of the catalogued files of a mounted folder, or of a single file.

    Excluded folders are never opened, empty files have a row, and links count only if they
    are followed.
    """
    files = walk(spark, root, follow_symlinks, EXCLUDED)
    kept = files if follow_symlinks else files.filter("not symlink")
    return kept.filter(file_class(mounted(root)) == "supported").select("path", "size_bytes", "mtime")


def audio_only(files: DataFrame, root: str = "") -> DataFrame:
    """The files that are catalogued: of a known extension, no sidecar, in no excluded folder."""
    return files.filter(file_class(root) == "supported")


def partial_digest(files: DataFrame) -> DataFrame:
    """``files`` with a digest of the first 64 KiB, of up to 64 KiB at the end of a larger file, and of the size."""
    part = 65536
    start = F.greatest(F.length("content") - part, F.lit(part))
    tail = F.when(F.length("content") > part, F.substring(F.col("content"), start + 1, F.lit(part))).otherwise(F.lit(b""))
    text = F.concat(F.substring("content", 1, part), tail, F.encode(F.col("size_bytes").cast("string"), "UTF-8"))
    return files.withColumn("partial_hash", F.sha2(text, 256)).drop("content")


def scan_changes(listing: DataFrame, catalog: DataFrame, root: str) -> DataFrame:
    """(path, change): added, updated, unchanged, errored, missing (vanished from the scope).

    ``catalog`` has path, size_bytes, mtime and missing.  A file is unchanged if size and time
    are equal and it was not missing; a new or changed one is errored if ``listing`` has an
    ``error`` for it.  Catalogue rows out of scope are left alone.
    """
    error = F.col("error") if "error" in listing.columns else F.lit(None).cast("string")
    seen = listing.select("path", F.col("size_bytes").alias("new_size"), F.col("mtime").alias("new_mtime"), F.lit(True).alias("seen"), error.alias("error"))
    known = catalog.filter(in_scope(F.col("path"), root)).select("path", "size_bytes", "mtime", "missing", F.lit(True).alias("known"))
    same = (F.col("new_size") == F.col("size_bytes")) & (F.col("new_mtime") == F.col("mtime")) & ~F.col("missing")
    change = F.when(F.col("seen").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("error").isNotNull(), "errored").when(F.col("known").isNull(), "added").otherwise("updated")
    return seen.join(known, "path", "full_outer").select("path", change.alias("change"), (F.col("seen").isNull() & ~F.coalesce("missing", F.lit(False))).alias("newly_missing"))


def scan_stats(changes: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changes.agg(F.count_if(F.col("change") != "missing").alias("scanned"), count("added"), count("updated"), count("unchanged"), count("errored"), count("missing"))


def apply_changes(listing: DataFrame, catalog: DataFrame, root: str, now: int) -> DataFrame:
    """The catalogue after a scan: new and changed rows from the listing, vanished ones marked once."""
    out = catalog.filter(~in_scope(F.col("path"), root)).select("path", "size_bytes", "mtime", "missing_since")
    both = catalog.filter(in_scope(F.col("path"), root)).select("path", "size_bytes", "mtime", "missing_since").join(
        listing.select("path", F.col("size_bytes").alias("s"), F.col("mtime").alias("m")), "path", "full_outer"
    )
    here = F.col("m").isNotNull()
    merged = both.select("path", F.coalesce("s", "size_bytes").alias("size_bytes"), F.coalesce("m", "mtime").alias("mtime"), F.when(~here, F.coalesce("missing_since", F.lit(now).cast("long"))).alias("missing_since"))
    return out.unionByName(merged)


def stale_matches(matches: DataFrame, changed: DataFrame) -> DataFrame:
    """Fingerprint matches that outlive a change of their track's file."""
    return matches.join(changed.select("track_id"), "track_id", "left_anti")


def preview(paths: DataFrame, examples: int = 5, root: str = "") -> DataFrame:
    """(class, n, examples) of files by :func:`file_class`, with the first paths of each.

    Where ``paths`` has a flag ``symlink``, links are a class of their own.
    """
    kind = file_class(root)
    if "symlink" in paths.columns:
        kind = F.when(F.col("symlink"), "symlink").otherwise(kind)
    ranked = paths.select(kind.alias("class"), "path")
    counts = ranked.groupBy("class").agg(F.count("*").alias("n"))
    # Only each class's first paths are gathered: a top-k per class before the shuffle.
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("path"))).filter(F.col("r") <= examples)
    shown = first.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("examples"))
    return counts.join(shown, "class")


def browse(paths: DataFrame, folder: str, limit: int) -> DataFrame:
    """(kind, name) of a folder's entries: folders first, by name whatever the case; one row more tells of others."""
    rest = F.substring(F.col("path"), F.lit(len(folder.rstrip("/")) + 2), F.length("path"))
    below = paths.filter(F.startswith("path", F.lit(folder.rstrip("/") + "/"))).select(rest.alias("rest"))
    name = F.split_part("rest", F.lit("/"), F.lit(1))
    entries = below.select(F.when(F.contains("rest", F.lit("/")), "folder").otherwise("file").alias("kind"), name.alias("name")).distinct()
    return entries.orderBy(F.desc("kind"), F.lower("name"), "name").limit(limit + 1)
