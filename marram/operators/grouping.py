"""Grouping of tracks into releases: ids, fingerprint votes, similar tags, singletons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.text import match_key_column
from marram.sources.shared import written
from marram.sources.versioned import BUCKETS, KeyedTable

from .catalog import in_scope
from .components import component_of
from .feeds import mixed_groups
from .names import near_pairs
from .reports import blank

#: Largest mean distance of artist and album at which a track joins a cluster.
NEAR = 0.25
#: Distinct (artist, album) keys in one part of a comparison of :func:`tag_clusters`.
PAIR_KEYS = 2_000
#: Votes of a component that one task settles.
COMPONENT_VOTES = 1_000_000


def group_key(basis: Column, value: Column) -> Column:
    """An opaque key of a group."""
    return F.substring(F.sha2(F.concat_ws(":", basis, value), 256), 1, 32)


def release_key() -> Column:
    """struct(basis, value) of the first id that a track has: release, barcode, catalogue number with label."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    pair = lambda basis, value: F.struct(F.lit(basis).alias("basis"), value.alias("value"))
    return F.when(has("mb_release_id"), pair("release_id", F.col("mb_release_id"))).when(has("barcode"), pair("barcode", F.col("barcode"))).when(has("catalog_number") & has("label"), pair("catalog_label", F.concat_ws("|", "catalog_number", "label")))


def by_ids(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, basis, id) of the groups of two or more that share an id, and the other tracks.

    The others carry ``had_key``: alone under their key.
    """
    keyed = tracks.withColumn("_k", release_key())
    size = keyed.filter("_k is not null").groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1").select("_k")
    inside = keyed.join(size, "_k", "left_semi").select(group_key(F.col("_k.basis"), F.col("_k.value")).alias("key"), F.col("_k.basis").alias("basis"), "id")
    rest = keyed.join(size, "_k", "left_anti").withColumn("had_key", F.col("_k").isNotNull()).drop("_k")
    return inside, rest


def release_votes(matches: DataFrame) -> DataFrame:
    """(track_id, release_id): a vote for each release that a track's matches name."""
    return matches.select("track_id", F.explode("mb_release_ids").alias("release_id")).distinct()


def vote_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("release_id").agg(F.count("*").alias("votes"))


def fingerprint_groups(votes: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(release_id, track_id): releases claim their voters, the most voted first (ties by id).

    A release passes unless it has fewer than two free voters, or both fewer than the global
    threshold and fewer than half of its own.  Claims meet only within a connected component of
    releases that share voters, so each component is settled in a task of its own, one release
    after the other: a chain takes as many rounds as its component takes to find, which is the
    logarithm of its length.  Components of over COMPONENT_VOTES votes are settled by rounds of
    joins instead (:func:`_claim_by_rounds`), with the same result.
    """
    votes = written(votes.select("release_id", "track_id").filter("release_id is not null and track_id is not null").distinct(), "votes")
    n = votes.select("track_id").distinct().count()
    threshold = max(min(max(least, int(n * share)), n) if n else least, least)
    parts = component_of(votes, "release_id", "track_id")
    labelled = written(votes.join(parts, "release_id"), "vote-parts")
    large = labelled.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > COMPONENT_VOTES).select("component")
    kinds = dict(votes.dtypes)
    small = labelled.join(large, "component", "left_anti").groupBy("component").applyInPandas(lambda pdf: _claim_in_order(pdf, threshold, share), f"release_id {kinds['release_id']}, track_id {kinds['track_id']}")
    if large.isEmpty():
        return small
    return small.unionByName(_claim_by_rounds(labelled.join(large, "component", "left_semi").select("release_id", "track_id"), threshold, share))


def _fails(free, votes, threshold: int, share: float):
    return ((free < threshold) & (free < votes * share)) | (free < 2)


def _claim_in_order(pdf: pd.DataFrame, threshold: int, share: float) -> pd.DataFrame:
    """The claims of one component: its releases in order of votes."""
    voters = pdf.groupby("release_id")["track_id"].apply(list).to_dict()
    taken, claims = set(), []
    for release in sorted(voters, key=lambda r: (-len(voters[r]), r)):
        free = [t for t in voters[release] if t not in taken]
        if not _fails(len(free), len(voters[release]), threshold, share):
            taken.update(free)
            claims += [(release, t) for t in free]
    return pd.DataFrame(claims, columns=["release_id", "track_id"])


def _claim_by_rounds(votes: DataFrame, threshold: int, share: float) -> DataFrame:
    """The claims of any component: a release is settled once all with higher rank that share a voter are.

    A round is two joins and its state is written out.
    """
    ranked = written(votes.join(vote_counts(votes), "release_id").withColumn("rank", F.struct(-F.col("votes"), "release_id")), "vote-ranks")
    claims, open_ = None, ranked
    while True:
        first = open_.groupBy("track_id").agg(F.min("rank").alias("top"))
        seen = open_.join(first, "track_id").groupBy("release_id", "rank", "votes").agg(F.count("*").alias("free"), F.bool_and(F.col("rank") == F.col("top")).alias("ready"))
        state = written(seen, "vote-round")
        settled = state.filter("ready")
        won = open_.join(settled.filter(~_fails(F.col("free"), F.col("votes"), threshold, share)).select("release_id"), "release_id", "left_semi")
        rest = open_.join(settled.select("release_id"), "release_id", "left_anti").join(won.select("track_id"), "track_id", "left_anti")
        both = written(won.withColumn("won", F.lit(True)).unionByName(rest.withColumn("won", F.lit(False))), "vote-claims")
        own = both.filter("won").select("release_id", "track_id")
        claims = own if claims is None else claims.unionByName(own)
        open_ = both.filter("not won").drop("won")
        if open_.isEmpty():
            return claims


def tag_clusters(tracks: DataFrame, order: str, block: Column | None = None) -> DataFrame:
    """(id, leader_id, distance): each track joins the first cluster whose leader is near, else leads one.

    Tracks of equal match keys always share a cluster, so distinct key pairs are compared, in
    the order of their first tracks, and only within a ``block`` if there is one.  Near pairs
    are looked up in an index of letter pairs (:mod:`.names`), a pair of parts of about
    PAIR_KEYS keys a task; a key joins if an earlier leader is near it, which is settled in
    rounds of joins until none is open.
    """
    artist, album = F.coalesce(F.nullif("album_artist", F.lit("")), "artist"), F.col("album")
    names = tracks.select("id", F.col(order).alias("at"), artist.alias("artist"), album.alias("album"), (block if block is not None else F.lit(0)).alias("block"))
    pairs = names.groupBy("block", "artist", "album").agg(F.min(F.struct("at", "id")).alias("first"))
    keyed = written(pairs.select("block", "artist", "album", match_key_column("artist").alias("artist_key"), match_key_column("album").alias("album_key"), "first.at", "first.id"), "tag-names")
    distinct = keyed.groupBy("block", "artist_key", "album_key").agg(F.min(F.struct("at", "id")).alias("first")).select("block", "artist_key", "album_key", "first.at", "first.id")
    node = ("at", "id", "artist_key", "album_key")
    distinct = written(distinct, "tag-keys")
    parts = max(1, math.ceil(distinct.count() / PAIR_KEYS))
    kinds = dict(distinct.dtypes)
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("artist_key", "album_key"), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    flat = ", ".join(["block " + kinds["block"], *(f"{side}_{c} {kinds[c]}" for side in ("late", "early") for c in node), "distance double"])
    near = dealt.groupBy("block", "i", "j").applyInPandas(lambda pdf: _near_keys(pdf, node), flat)
    pick = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in node]).alias(side)
    near = written(near.select("block", pick("late"), pick("early"), "distance"), "tag-near")
    joined = _followers(near.select("block", F.col("late.id").alias("late"), F.col("early.id").alias("early")))
    keys = distinct.select("block", F.struct(*node).alias("late"), F.col("id").alias("late_id"))
    leads = keys.join(joined, ["block", "late_id"], "left_anti").select("block", "late", F.struct(F.col("late").alias("early"), F.lit(0.0).alias("distance")).alias("to"))
    free = near.withColumn("late_id", F.col("early.id")).join(joined, ["block", "late_id"], "left_anti")
    follows = free.groupBy("block", "late").agg(F.min(F.struct("early", "distance")).alias("to"))
    found = leads.unionByName(follows).select("block", "late.artist_key", "late.album_key", F.col("to.early.id").alias("leader_id"), F.col("to.distance").alias("distance"))
    spread = keyed.select("block", "artist", "album", "artist_key", "album_key").join(found, ["block", "artist_key", "album_key"]).select("block", "artist", "album", "leader_id", "distance")
    same = (names["block"] == spread["block"]) & names["artist"].eqNullSafe(spread["artist"]) & names["album"].eqNullSafe(spread["album"])
    return names.join(spread, same).select(names["id"], "leader_id", "distance")


def _followers(edges: DataFrame) -> DataFrame:
    """(block, late_id) of the nodes that do not lead, from edges (block, late, early) of near ones.

    A node whose edges all lead to followers leads; one with an edge to a leader follows.  A
    round decides all nodes next to a decided leader and writes one table: those that follow,
    and the edges between nodes that are still open.
    """
    open_ = edges
    followers = None
    while True:
        waiting = open_.select("block", F.col("late").alias("early")).distinct()
        more = open_.join(waiting, ["block", "early"], "left_anti").select("block", "late").distinct()
        rest = open_.join(more, ["block", "late"], "left_anti").join(more.withColumnRenamed("late", "early"), ["block", "early"], "left_anti")
        state = written(rest.select("block", "late", "early").unionByName(more.withColumn("early", F.lit(None).cast(dict(edges.dtypes)["early"]))), "tag-round")
        own = state.filter("early is null").select("block", F.col("late").alias("late_id"))
        followers = own if followers is None else followers.unionByName(own)
        open_ = state.filter("early is not null")
        if open_.isEmpty():
            return followers


def _near_keys(pdf: pd.DataFrame, node: tuple[str, ...]) -> pd.DataFrame:
    """Near keys of two parts, the later one first."""
    pdf = pdf.sort_values(list(node), kind="stable").reset_index(drop=True)
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left, right = (np.flatnonzero(pdf["part"].to_numpy() == p) for p in (i, j))
    keys = list(zip(pdf["artist_key"], pdf["album_key"], strict=True))
    x, y, found, _ = near_pairs([keys[k] for k in left], [keys[k] for k in right], NEAR, bool(i == j))
    x, y = left[x], right[y]
    late, early = np.maximum(x, y), np.minimum(x, y)
    sides = [pdf[list(node)].iloc[at].reset_index(drop=True).add_prefix(name) for name, at in (("late_", late), ("early_", early))]
    return pd.concat([pd.Series([pdf["block"].iloc[0]] * len(late), name="block", dtype=pdf["block"].dtype), *sides, pd.Series(found, name="distance", dtype=float)], axis=1)


def cluster_confidence(clusters: DataFrame) -> DataFrame:
    """(leader_id, members, confidence) of clusters of two or more: the tighter, the surer."""
    mean = F.avg(F.when(F.col("id") != F.col("leader_id"), F.col("distance")))
    return clusters.groupBy("leader_id").agg(F.count("*").alias("members"), mean.alias("m")).filter("members > 1").select("leader_id", "members", tightness(F.col("m")).alias("confidence"))


def tightness(mean: Column) -> Column:
    """Confidence of a cluster with this mean distance to its leader."""
    return F.least(F.greatest(F.round(0.85 - mean * 0.35 / NEAR, 3), F.lit(0.5)), F.lit(0.85))


def is_singleton() -> Column:
    same = F.coalesce(match_key_column("album") == match_key_column("title"), F.lit(False))
    return blank(F.col("album")) | same | (F.coalesce("track_total", F.lit(0)) == 1)


def partial_albums(groups: DataFrame, key: str = "key") -> DataFrame:
    """(key, members, agreed, kind): partial where all agree on more tracks than there are."""
    total = F.when(F.col("track_total") != 0, F.col("track_total"))
    out = groups.groupBy(key).agg(F.count("*").alias("members"), F.when(F.countDistinct(total) == 1, F.max(total)).alias("agreed"))
    return out.withColumn("kind", F.when(F.col("agreed") > F.col("members"), "partial_album").otherwise("album"))


def _considered(tracks: DataFrame, root: str | None) -> DataFrame:
    """Live tracks; with ``root`` those in its scope, but for groups that also have tracks outside."""
    live = tracks.filter("not is_missing")
    if root is None:
        return live
    inside = in_scope(F.col("path"), root)
    return live.join(mixed_groups(live.filter("group_id is not null"), "group_id", inside), "group_id", "left_anti").filter(inside)


def _placed(tracks: DataFrame, matches: DataFrame, pinned: DataFrame, block: Column | None = None, root: str | None = None) -> DataFrame:
    """(id, key, basis, release_id, leader_id, distance): where :func:`cascade` puts each track, and by what."""
    free = written(_considered(tracks, root).join(pinned, "group_id", "left_anti"), "grouping-free")
    none = {"release_id": F.lit(None).cast("string"), "leader_id": F.lit(None).cast("long"), "distance": F.lit(None).cast("double")}
    every = ["id", "key", "basis", *none]
    inside, rest = by_ids(free)
    rest = written(rest, "grouping-rest")
    votes = release_votes(matches.join(rest.select(F.col("id").alias("track_id")), "track_id", "left_semi"))
    voted = written(fingerprint_groups(votes), "grouping-voted").select(group_key(F.lit("fingerprint"), F.col("release_id")).alias("key"), F.lit("fingerprint").alias("basis"), F.col("track_id").alias("id"), F.col("release_id").cast("string").alias("release_id"))
    left = written(rest.join(voted.select("id"), "id", "left_anti").withColumn("_single", is_singleton()).withColumn("_at", F.col("id") + F.when(F.col("had_key"), F.lit(1 << 60)).otherwise(0)), "grouping-left")
    clusters = written(tag_clusters(left.filter("not _single"), "_at", block), "grouping-clusters")
    large = clusters.groupBy("leader_id").agg(F.count("*").alias("n")).filter("n > 1").select("leader_id")
    artist = F.coalesce(F.nullif("album_artist", F.lit("")), "artist")
    names = left.join(large, left["id"] == large["leader_id"], "left_semi").select(F.col("id").alias("leader_id"), group_key(F.lit("tags"), F.concat_ws("|", match_key_column(artist), match_key_column("album"))).alias("key"))
    tagged = clusters.join(names, "leader_id").select("key", F.lit("tags").alias("basis"), "id", "leader_id", "distance")
    alone = left.join(tagged.select("id"), "id", "left_anti").select(group_key(F.lit("singleton"), F.concat(F.lit("track:"), F.col("id").cast("string"))).alias("key"), F.lit("singleton").alias("basis"), "id")
    parts = [df.withColumns({n: c for n, c in none.items() if n not in df.columns}).select(*every) for df in (inside, voted, tagged, alone)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def cascade(tracks: DataFrame, matches: DataFrame, pinned: DataFrame, block: Column | None = None, root: str | None = None) -> DataFrame:
    """(id, key, basis): every live track that is not in a pinned group, by the first stage that takes it.

    With ``root`` only tracks in its scope count, and none of a group that also has tracks
    outside.  Tags are clustered in the order of ids (under 2**60), tracks that had an id of a
    release to themselves coming last.  A cluster's key is made of its leader's match keys, so
    it stays the same from run to run; clusters whose leaders have equal keys are one group.
    """
    return _placed(tracks, matches, pinned, block, root).select("id", "key", "basis")


#: Columns of a stored group that a proposal fills.
GROUP = "key string, kind string, basis string, confidence double, track_count long, expected_track_count int, album string, album_artist string, year int, label string, catalog_number string, barcode string, mb_release_id string"
_COPIED = ("album", "album_artist", "year", "label", "catalog_number", "barcode", "mb_release_id")


def proposals(placed: DataFrame, tracks: DataFrame) -> DataFrame:
    """Groups with the columns GROUP, from the rows of :func:`_placed`.

    Fields are those of the first member (of tags, the leader); a group by fingerprints has the
    release that its voters name, a singleton has album, album artist (else artist) and year
    only.  Ids are certain, fingerprints 0.9 and tags the surer, the tighter they are.  Where
    all members agree on more tracks than there are, the group is a partial album that expects
    as many.
    """
    own = tracks.select("id", "artist", "track_total", *_COPIED)
    rows = placed.join(own, "id")
    order = F.when(F.col("id") == F.col("leader_id"), F.lit(-(1 << 62))).otherwise(F.col("id"))
    total = F.when(F.col("track_total") != 0, F.col("track_total"))
    mean = F.avg(F.when(F.col("id") != F.col("leader_id"), F.col("distance")))
    made = rows.groupBy("key", "basis").agg(
        F.count("*").alias("track_count"),
        F.when(F.countDistinct(total) == 1, F.max(total)).alias("agreed"),
        mean.alias("mean"),
        F.max("release_id").alias("release_id"),
        F.min_by(F.struct("artist", *_COPIED), order).alias("first"),
    )
    single, voted = F.col("basis") == "singleton", F.col("basis") == "fingerprint"
    partial = ~single & (F.col("track_count") > 1) & F.coalesce(F.col("agreed") > F.col("track_count"), F.lit(False))
    fields = {c: F.when(~single, F.col(f"first.{c}")) for c in _COPIED}
    fields |= {"album": F.col("first.album"), "year": F.col("first.year"), "album_artist": F.when(single, F.coalesce(F.nullif(F.col("first.album_artist"), F.lit("")), F.col("first.artist"))).otherwise(F.col("first.album_artist"))}
    fields["mb_release_id"] = F.when(voted, F.col("release_id")).otherwise(fields["mb_release_id"])
    return made.select(
        "key",
        F.when(single, "singleton").when(partial, "partial_album").otherwise("album").alias("kind"),
        "basis",
        F.when(voted, F.lit(0.9)).when(F.col("basis") == "tags", tightness(F.col("mean"))).otherwise(F.lit(1.0)).alias("confidence"),
        "track_count",
        F.when(partial, F.col("agreed")).cast("int").alias("expected_track_count"),
        *[c.alias(n) for n, c in fields.items()],
    )


class GroupStore:
    """Groups and the group of every track, as two keyed tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.groups = KeyedTable(spark, f"{root}/groups", GROUP + ", is_pinned boolean", ["key"], buckets)
        self.members = KeyedTable(spark, f"{root}/members", "id long, key string", ["id"], buckets)

    def pin(self, keys: DataFrame, pinned: bool = True) -> None:
        """Pin the groups of ``keys`` (key), or free them."""
        self.groups.merge(self.groups.read().join(keys, "key", "left_semi").withColumn("is_pinned", F.lit(pinned)))

    def run(self, tracks: DataFrame, matches: DataFrame, block: Column | None = None, root: str | None = None) -> dict[str, int]:
        """Group ``tracks`` anew and store what changes.

        Tracks of pinned groups are left where they are, and so are pinned groups that a
        proposal would fill.  Gives the groups created and updated (proposed and there before),
        the tracks that get another group, and the live tracks in scope that were skipped
        because their group is pinned.  The same tracks again change no stored row.
        """
        stored = self.groups.read()
        known = self.members.read().withColumnRenamed("key", "group_id")
        own = tracks.drop("group_id").join(known, "id", "left")
        pinned = stored.filter("is_pinned").select(F.col("key").alias("group_id"))
        placed = written(_placed(own, matches, pinned, block, root), "grouping-placed")
        made = written(proposals(placed, own).join(stored.select("key", "is_pinned"), "key", "left"), "grouping-made")
        open_ = made.filter("is_pinned is null or not is_pinned")
        counts = made.agg(F.count_if(F.col("is_pinned").isNull()).alias("created"), F.count_if(~F.col("is_pinned")).alias("updated")).first()
        skipped = _considered(own, root).join(pinned, "group_id", "left_semi").count()
        self.groups.merge(open_.withColumn("is_pinned", F.lit(False)))
        moved = self.members.merge(placed.join(open_.select("key"), "key", "left_semi").select("id", "key"))
        return {"created": counts["created"], "updated": counts["updated"], "tracks_grouped": moved["created"] + moved["updated"], "tracks_skipped_pinned": skipped}


def upsert_counts(proposed: DataFrame, stored: DataFrame) -> DataFrame:
    """Groups created, updated and left alone (pinned) by key."""
    both = proposed.select("key").distinct().join(stored.select("key", F.col("is_pinned"), F.lit(True).alias("stored")), "key", "left")
    return both.agg(F.count_if(F.col("stored").isNull()).alias("created"), F.count_if(F.col("stored") & ~F.col("is_pinned")).alias("updated"), F.count_if(F.col("stored") & F.col("is_pinned")).alias("skipped"))
