"""Storage accounting a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import constants as K
from shelfwise.operators import scans


def breakdown(assets: DataFrame, resources: DataFrame) -> DataFrame:
    sized = scans.first_sized_resource(assets, resources).select("asset_id", "bytes")
    b = F.coalesce("bytes", F.lit(0))
    return assets.select("asset_id", "library_id", "media_type").join(sized, "asset_id", "left").groupBy("library_id").agg(
        F.sum(F.when(F.col("media_type") == "image", b).otherwise(0)).alias("photo_bytes"), F.sum(F.when(F.col("media_type") == "video", b).otherwise(0)).alias("video_bytes"), F.count("*").alias("items"))


def fractions(sizes: DataFrame, storage: DataFrame) -> DataFrame:
    """Shares of the used space; what is not accounted for is never negative."""
    used = F.greatest(F.col("total_bytes") - F.col("available_bytes"), F.lit(1))
    other = F.greatest(used - F.col("photo_bytes") - F.col("video_bytes"), F.lit(0))
    part = lambda x: F.round(x / used, 6)
    return sizes.join(storage, "library_id").select("library_id", part(F.col("photo_bytes")).alias("photo_share"), part(F.col("video_bytes")).alias("video_share"), part(other).alias("other_share"), F.round(used / F.greatest("total_bytes", F.lit(1)), 6).alias("used_fraction"))


def reclaimable(assets: DataFrame, resources: DataFrame, analysis: DataFrame, storage: DataFrame) -> DataFrame:
    """Local bytes of large videos, allowances for blurry pictures and screenshots, and large photos; at most what is used."""
    local = F.when(F.coalesce("locally_available", F.lit(False)), F.coalesce("file_size", F.lit(0))).otherwise(0)
    parts = [
        scans.large_videos(assets, resources).select("library_id", local.alias("x")),
        analysis.where("is_blurry").select("library_id", F.lit(K.BLURRY_BYTES).cast("long").alias("x")),
        scans.with_bit(assets, K.SCREENSHOT).select("library_id", F.lit(K.SCREENSHOT_BYTES).cast("long").alias("x")),
        scans.large_photos(assets, resources).select("library_id", F.col("file_size").alias("x")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    total = rows.groupBy("library_id").agg(F.sum("x").alias("x"))
    used = F.greatest(F.col("total_bytes") - F.col("available_bytes"), F.lit(0))
    return storage.join(total, "library_id", "left").select("library_id", F.least(F.coalesce("x", F.lit(0)), used).alias("reclaimable"))
