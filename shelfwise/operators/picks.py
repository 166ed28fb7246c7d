"""Ranked deletion candidates that follow earlier decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(rows: DataFrame) -> DataFrame:
    """First occurrence of each asset in a list ordered by (source, pos)."""
    first = rows.groupBy("library_id", "asset_id").agg(F.min(F.struct("source", "pos")).alias("x"))
    return first.select("library_id", "asset_id", "x.source", "x.pos")


def lowest(candidates: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` worst candidates of each library; an unknown score counts 0.5."""
    rows = candidates.select("library_id", "asset_id").join(scores.select("asset_id", "score"), "asset_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.5)), 6))
    w = Window.partitionBy("library_id").orderBy("score", "asset_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_affinity(wasted: DataFrame, affinity: DataFrame) -> DataFrame:
    """Deletions so far of each shot's reason (ten reasons a library), 0 if none."""
    return wasted.join(affinity, ["library_id", "reason"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))


def smart_picks(candidates: DataFrame, worst: DataFrame, images: DataFrame, wasted: DataFrame, affinity: DataFrame) -> DataFrame:
    """(library_id, asset_id, reason, tier, rank).

    Tier 1: wasted shots of reasons deleted at least three times; tier 2: the worst candidates; tier 3: other
    wasted shots. Wasted shots are looked for among the newest 800 images that are no candidates, 1500 where a
    reason was deleted five times.
    """
    cap = affinity.groupBy("library_id").agg(F.max("deleted").alias("most"))
    rest = images.join(candidates.select("library_id", "asset_id"), ["library_id", "asset_id"], "left_anti").select("library_id", "asset_id", "creation_date")
    w = Window.partitionBy("library_id").orderBy(F.desc("creation_date"), "asset_id")
    recent = rest.withColumn("k", F.row_number().over(w)).where("k <= 1500").join(cap, "library_id", "left").where(F.col("k") <= F.when(F.col("most") >= 5, 1500).otherwise(800))
    shots = with_affinity(recent.select("library_id", "asset_id", "k").join(wasted.where("reason is not null").select("asset_id", "reason"), "asset_id"), affinity)
    shots = shots.withColumn("tier", F.when(F.col("deleted") >= 3, 1).otherwise(3))
    order = Window.partitionBy("library_id", "tier").orderBy(F.desc("deleted"), "k")
    shots = shots.withColumn("rank", F.row_number().over(order)).select("library_id", "asset_id", "reason", "tier", "rank")
    return shots.unionByName(worst.select("library_id", "asset_id", F.lit(None).cast("string").alias("reason"), F.lit(2).alias("tier"), "rank"))
