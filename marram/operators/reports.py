"""Aggregate reports over the catalogue: one pass each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.scalars import stripped
from marram.sources.shared import written


def blank(c: Column, kind: str = "string") -> Column:
    """Null, a text of white space, an empty list; false and 0 are values."""
    if kind == "string":
        return c.isNull() | (stripped(c) == "")
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def dashboard(tracks: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts of live tracks by condition, and of work units by kind (partial albums are albums)."""
    live = ~F.col("is_missing")
    counts = tracks.agg(
        F.count_if(live).alias("tracks"),
        F.count_if(live & ~F.col("has_art")).alias("without_art"),
        F.count_if(live & F.col("album").isNull()).alias("unmatched"),
        F.count_if(live & F.col("probe_error").isNotNull()).alias("errored"),
        F.count_if(~live).alias("missing"),
    )
    kinds = groups.agg(F.count_if(F.col("kind").isin("album", "partial_album")).alias("albums"), F.count_if(F.col("kind") == "singleton").alias("singletons"), F.count_if(F.col("kind") == "unknown").alias("unknown_units"))
    return counts.join(kinds)


def metrics(tracks: DataFrame, groups: DataFrame, jobs: DataFrame) -> DataFrame:
    """(name, label, value): totals that include missing tracks, and jobs by state."""
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), F.lit("").alias("label"), "value")
    by_state = jobs.groupBy("state").agg(F.count("*").alias("value")).select(F.lit("jobs").alias("name"), F.col("state").alias("label"), "value")
    return reduce(DataFrame.unionByName, [one(tracks, "tracks"), one(groups, "groups"), one(tracks.filter("is_missing"), "missing"), by_state])


def prometheus(values: DataFrame, prefix: str = "catalog") -> DataFrame:
    """One text line a metric, in name and label order."""
    label = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit('{state="'), "label", F.lit('"}')))
    return values.select("name", "label", F.concat(F.lit(f"{prefix}_"), "name", label, F.lit(" "), F.col("value").cast("string")).alias("line")).select("line")


def split_report(tracks: DataFrame) -> DataFrame:
    """Singletons (blank album or album artist) and distinct albums, compared as they stand."""
    single = blank(F.col("album")) | blank(F.col("album_artist"))
    return tracks.agg(F.count("*").alias("total"), F.count_if(single).alias("singletons"), F.countDistinct(F.when(~single, F.struct("album_artist", "album"))).alias("albums"))


def completeness(tracks: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, total): values that are not blank, in one pass over the rows."""
    kinds = dict(tracks.dtypes)
    counts = tracks.agg(F.count("*").alias("total"), *[F.count_if(~blank(F.col(f), kinds[f])).alias(f) for f in fields])
    return counts.unpivot("total", fields, "field", "present").select("field", "present", "total")


def exact_duplicates(tracks: DataFrame) -> DataFrame:
    """(artist_key, title_key, ids): rows that share trimmed lower-case artist and title.

    Where very many rows may share a key, take :func:`exact_duplicate_rows`.
    """
    return exact_duplicate_rows(tracks).groupBy("artist_key", "title_key").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def exact_duplicate_rows(tracks: DataFrame) -> DataFrame:
    """(artist_key, title_key, id) of the rows that share both keys with another: no key is gathered."""
    key = lambda c: F.lower(stripped(F.col(c)))
    full = tracks.filter(~blank(F.col("artist")) & ~blank(F.col("title"))).select(key("artist").alias("artist_key"), key("title").alias("title_key"), "id")
    many = full.groupBy("artist_key", "title_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("artist_key", "title_key")
    return full.join(many, ["artist_key", "title_key"], "left_semi")


def breakdown(tracks: DataFrame, column: str = "format") -> DataFrame:
    """(value, n), the most frequent first; ties by value."""
    return tracks.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def mean_of(tracks: DataFrame, column: str) -> DataFrame:
    return tracks.agg(F.round(F.avg(column), 6).alias("mean"))


#: Cells into which a key's values are split in a round, and the rows that are ranked as they are.
CELLS, RANKED = 64, 100_000


def nearest_rank(df: DataFrame, key: str, value: str, share: float = 0.95) -> DataFrame:
    """(key, p): the value at position min(int(n * share), n - 1) of each key's sorted values; nulls first, NaN last.

    Exact, and no key is sorted in one task: a round splits each key's values at CELLS
    approximate quantiles, counts the cells exactly and goes on in the one that holds the
    position, which has about 1 / CELLS of the rows.  A cell of one value is the answer, however
    many rows have it; one of at most RANKED rows is counted by value and ranked.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    known = F.col("v").isNotNull()
    size = rows.groupBy("k").agg(F.count("*").alias("n"), F.count_if(~known).alias("nulls"))
    at = F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1) + 1 - F.col("nulls")
    state = written(size.select("k", at.cast("long").alias("at"), (F.col("n") - F.col("nulls")).alias("n")), "rank-state")
    # Positions among the nulls are settled.
    found = state.filter("at < 1").select("k", F.lit(None).cast(rows.schema["v"].dataType).alias("v"))
    state, left = state.filter("at >= 1"), rows.filter(known)
    here = (F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("c") < F.col("at"))
    while True:
        ready = state.filter(F.col("n") <= RANKED)
        few = _beside(left, ready, "left_semi").groupBy("k", "v").agg(F.count("*").alias("c"))
        few = few.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("v")))
        found = found.unionByName(_beside(few, ready).filter(here).select("k", "v"))
        state = state.filter(F.col("n") > RANKED)
        if state.isEmpty():
            return found.select(F.col("k").alias(key), F.col("v").alias("p"))
        left = _beside(left, state, "left_semi")
        grid = left.groupBy("k").agg(F.percentile_approx("v", [i / CELLS for i in range(CELLS + 1)], 10 * CELLS).alias("cuts"))
        celled = _beside(left, grid).select("k", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("cell"))
        cells = celled.groupBy("k", "cell").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        cells = cells.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("cell")))
        hit = _beside(cells, state).filter(here)
        hit = written(hit.select("k", (F.col("at") - F.col("upto") + F.col("c")).alias("at"), F.col("c").alias("n"), "low", "high"), "rank-state")
        one = F.col("low").eqNullSafe(F.col("high"))
        found = found.unionByName(hit.filter(one).select("k", F.col("low").alias("v")))
        state = hit.filter(~one)
        left = written(_beside(left, state).filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select("k", "v"), "rank-rows")
        state = state.select("k", "at", "n")


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on their k, nulls being equal."""
    out = left.join(right.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), how)
    return out.drop("_k")


def common_value(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value, multiple): the value that all rows of a key share, nulls being a value of their own."""
    spread = F.countDistinct(F.to_json(F.struct(F.col(column))))
    return df.groupBy(key).agg(spread.alias("k"), F.max(column).alias("v")).select(key, F.when(F.col("k") == 1, F.col("v")).alias("value"), (F.col("k") > 1).alias("multiple"))


def consensus(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, agreed, members): the one distinct non-zero value of a key, else null."""
    own = F.when(F.col(column) != 0, F.col(column))
    return df.groupBy(key).agg(F.when(F.countDistinct(own) == 1, F.max(own)).alias("agreed"), F.count("*").alias("members"))
