"""The per-item analysis cache: freshness, split, upsert, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import constants as K
from shelfwise.functions.vectors import epoch_us

SIGNALS = ("dhash", "is_blurry", "quality_score", "semantic_category")


def epoch_s(x: str = "modification_date") -> Column:
    return F.coalesce(epoch_us(F.col(x)) / 1e6, F.lit(0.0))


def fresh(assets: DataFrame, cache: DataFrame, limit: float = K.FRESH_S) -> DataFrame:
    """Cached rows of assets whose modification date has not moved by more than ``limit`` seconds."""
    now = assets.select("asset_id", epoch_s().alias("now"))
    return cache.join(now, "asset_id").where(F.abs(F.col("modification_date") - F.col("now")) <= limit).drop("now")


def split(assets: DataFrame, cache: DataFrame, signal: str) -> DataFrame:
    """``assets`` with the cached ``signal`` and whether it is there."""
    hit = fresh(assets, cache).select("asset_id", signal)
    return assets.join(hit, "asset_id", "left").withColumn("cached", F.col(signal).isNotNull())


def upsert(cache: DataFrame, new: DataFrame, compat: bool = False) -> DataFrame:
    """Insert or update: a signal that is given overwrites, one that is null keeps the old.

    When the modification date moves by more than a second, the other old signals are dropped, unless ``compat``
    keeps them although they are stale. Missing signal columns count as null. Where ``new`` has a column ``since``
    (rows that a stream folded), the old date is compared with that one; an infinite one leaves nothing old.
    """
    if "since" not in new.columns:
        new = new.withColumn("since", F.col("modification_date"))
    for s in SIGNALS:
        if s not in new.columns:
            new = new.withColumn(s, F.lit(None).cast(cache.schema[s].dataType))
    n = new.select("asset_id", *[F.col(c).alias(f"n_{c}") for c in ("library_id", "modification_date", "since", *SIGNALS)])
    both = cache.join(n, "asset_id", "full_outer")
    stale = F.coalesce(F.abs(F.col("modification_date") - F.col("n_since")) > K.FRESH_S, F.col("n_since") == float("inf"), F.lit(False)) & F.lit(not compat)
    signal = lambda s: F.coalesce(F.col(f"n_{s}"), F.when(~stale, F.col(s)))
    return both.select("asset_id", F.coalesce("n_library_id", "library_id").alias("library_id"), F.coalesce("n_modification_date", "modification_date").alias("modification_date"), *[signal(s).alias(s) for s in SIGNALS])


def delete(cache: DataFrame, ids: DataFrame) -> DataFrame:
    return cache.join(ids, "asset_id", "left_anti")
