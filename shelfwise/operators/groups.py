"""Groups of duplicate or similar items, and set operations on groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions import constants as K
from shelfwise.functions.vectors import epoch_us, l2
from shelfwise.operators.components import connected_components
from shelfwise.operators.pairs import pixels


def _ordered(*keys: Column) -> Column:
    """Ids of a group, ordered by the given keys and then by id."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "asset_id"))), lambda x: x["asset_id"])


def newest() -> list[Column]:
    return [-pixels(), -epoch_us(F.col("creation_date"))]


def exact_duplicates(images: DataFrame, hashes: DataFrame) -> DataFrame:
    """Images with equal hashes, best first: one hash aggregation, no pairs."""
    rows = images.join(hashes.where("dhash is not null"), ["library_id", "asset_id"])
    out = rows.groupBy("library_id", "dhash").agg(F.count("*").alias("n"), _ordered(*newest()).alias("members"), F.min("asset_id").alias("group_id"), F.max("creation_date").alias("newest")).where("n >= 2")
    return out.select("library_id", "group_id", F.lit("exactDuplicate").alias("reason"), F.lit(0.0).alias("similarity"), "members", "newest")


def exact_members(images: DataFrame, hashes: DataFrame) -> DataFrame:
    """(library_id, group_id, asset_id, n): the same groups a row a member, for hashes that very many images share."""
    rows = images.join(hashes.where("dhash is not null"), ["library_id", "asset_id"]).select("library_id", "dhash", "asset_id")
    heads = rows.groupBy("library_id", "dhash").agg(F.count("*").alias("n"), F.min("asset_id").alias("group_id")).where("n >= 2")
    return rows.join(heads, ["library_id", "dhash"]).select("library_id", "group_id", "asset_id", "n")


def burst_groups(images: DataFrame) -> DataFrame:
    rows = images.where("burst_identifier is not null")
    out = rows.groupBy("library_id", "burst_identifier").agg(F.count("*").alias("n"), _ordered(epoch_us(F.col("creation_date"))).alias("members"), F.min("asset_id").alias("group_id"), F.max("creation_date").alias("newest")).where("n >= 2")
    return out.select("library_id", "group_id", F.lit("burstShot").alias("reason"), F.lit(0.0).alias("similarity"), "members", "newest")


def component_of(pairs: DataFrame) -> DataFrame:
    """(library_id, asset_id, component) of pairs (library_id, a, b); ids are unique over libraries."""
    found = connected_components(pairs)
    return found.select(F.col("id").alias("asset_id"), "component")


def similar_groups(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components of similar pairs; ``items`` brings library, time and size."""
    return similar_groups_of(items, component_of(pairs))


def similar_groups_of(items: DataFrame, labels: DataFrame) -> DataFrame:
    """The same from components (asset_id, component)."""
    rows = labels.join(items, "asset_id")
    out = rows.groupBy("library_id", "component").agg(_ordered(*newest()).alias("members"), F.max("creation_date").alias("newest"))
    return out.select("library_id", F.col("component").alias("group_id"), F.lit("visuallySimilar").alias("reason"), F.lit(0.0).alias("similarity"), "members", "newest")


def near_groups(items: DataFrame, pairs: DataFrame, distance_of: DataFrame) -> DataFrame:
    """Components of near pairs in order of time; the distance of the first two decides the reason.

    ``distance_of`` (asset_id, vec) gives the vectors of the first two.
    """
    return near_groups_of(items, component_of(pairs), distance_of)


def near_groups_of(items: DataFrame, labels: DataFrame, distance_of: DataFrame) -> DataFrame:
    """The same from components (asset_id, component)."""
    rows = labels.join(items, "asset_id")
    out = rows.groupBy("library_id", "component").agg(_ordered(epoch_us(F.col("creation_date"))).alias("members"), F.max("creation_date").alias("newest"))
    first = out.select("component", F.col("members")[0].alias("one"), F.col("members")[1].alias("two"))
    a, b = distance_of.select(F.col("asset_id").alias("one"), F.col("vec").alias("va")), distance_of.select(F.col("asset_id").alias("two"), F.col("vec").alias("vb"))
    d = first.join(a, "one").join(b, "two").select("component", l2(F.col("va"), F.col("vb")).alias("d"))
    reason = F.when(F.col("d") < 0.01, "exactDuplicate").when(F.col("d") < 0.05, "nearDuplicate").otherwise("visuallySimilar")
    return out.join(d, "component").select("library_id", F.col("component").alias("group_id"), reason.alias("reason"), F.round("d", 6).alias("similarity"), "members", "newest")


def video_groups(videos: DataFrame, sizes: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """Components over both kinds of pairs: exact if any exact pair is in it; biggest file first."""
    exact = exact.select("library_id", "a", "b")
    rows = component_of(exact.union(near.select("library_id", "a", "b"))).join(videos, "asset_id").join(sizes.select("asset_id", "bytes"), "asset_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    sure = exact.select(F.col("a").alias("asset_id")).distinct().withColumn("exact", F.lit(True))
    rows = rows.join(sure, "asset_id", "left")
    out = rows.groupBy("library_id", "component").agg(_ordered(-F.col("bytes"), -epoch_us(F.col("creation_date"))).alias("members"), F.sum("bytes").alias("total_bytes"), F.bool_or(F.coalesce("exact", F.lit(False))).alias("exact"))
    return out.select("library_id", F.col("component").alias("group_id"), F.when(F.col("exact"), "exactDuplicate").otherwise("nearDuplicate").alias("reason"), "total_bytes", "members")


def key_of(members: str | Column = "members") -> Column:
    return F.concat_ws(",", F.array_sort(F.transform(members, lambda x: x.cast("string"))))


def priority(reason: str = "reason") -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(reason)), F.lit(-1))


def dedupe_sets(groups: DataFrame) -> DataFrame:
    """One group for each set of members, the one with the least (arrival, group_id)."""
    rows = groups.withColumn("key", key_of())
    order = F.struct("arrival", "group_id")
    return rows.groupBy("library_id", "key").agg(F.min_by(F.struct("group_id", "reason", "members"), order).alias("g")).select("library_id", "key", "g.*")


def merge_priority(groups: DataFrame) -> DataFrame:
    """Per member set: the highest reason, the rest from the earliest arrival."""
    rows = groups.withColumn("key", key_of())
    order = F.struct("arrival", "group_id")
    out = rows.groupBy("library_id", "key").agg(F.max_by("reason", F.struct(priority(), -F.col("arrival"))).alias("reason"), F.min_by(F.struct("group_id", "members"), order).alias("g"))
    return out.select("library_id", "key", "reason", "g.group_id", "g.members")


def merge_replace(groups: DataFrame) -> DataFrame:
    """Per member set: the whole group with the highest reason, the earliest of equals."""
    rows = groups.withColumn("key", key_of())
    best = F.struct((-priority()).alias("p"), "arrival", "group_id")
    return rows.groupBy("library_id", "key").agg(F.min_by(F.struct("reason", "group_id", "members"), best).alias("g")).select("library_id", "key", "g.*")


def strip_exact(groups: DataFrame) -> DataFrame:
    """Members of exact groups leave similar groups; what has fewer than two members left goes."""
    rows = groups.select("library_id", "group_id", "reason", F.posexplode("members").alias("pos", "asset_id"))
    exact = rows.where("reason = 'exactDuplicate'").select("library_id", "asset_id")
    similar = rows.where("reason = 'visuallySimilar'").join(exact, ["library_id", "asset_id"], "left_anti")
    kept = similar.groupBy("library_id", "group_id", "reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "asset_id"))), lambda x: x["asset_id"]).alias("members")).where("size(members) >= 2")
    return groups.where("reason <> 'visuallySimilar'").select("library_id", "group_id", "reason", "members").unionByName(kept)


def ranked(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Members by quality, unknown scores at 0.5; ties keep their order; rank 1 is the best."""
    rows = groups.select("library_id", "group_id", F.posexplode("members").alias("pos", "asset_id")).join(scores.select("asset_id", "quality_score"), "asset_id", "left")
    w = Window.partitionBy("library_id", "group_id").orderBy(F.desc(F.coalesce("quality_score", F.lit(0.5))), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).select("library_id", "group_id", "asset_id", "rank")
