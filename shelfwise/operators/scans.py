"""Scans, resources and plain filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import constants as K
from shelfwise.functions.text import normalize_name


def has_bit(bit: int) -> Column:
    return F.col("media_subtypes").bitwiseAND(bit) != 0


def images(assets: DataFrame, screenshots: bool = False) -> DataFrame:
    out = assets.where("media_type = 'image'")
    return out if screenshots else out.where(~has_bit(K.SCREENSHOT))


def added_after(assets: DataFrame, last_scan: dt.datetime | None, by: str = "creation_date") -> DataFrame:
    """Assets newer than the last scan; without one, all of them."""
    return assets if last_scan is None else assets.where(F.col(by) > F.lit(last_scan).cast("timestamp_ntz"))


def with_bit(assets: DataFrame, bit: int) -> DataFrame:
    return assets.where((F.col("media_type") == "image") & has_bit(bit))


def primary_resource(assets: DataFrame, resources: DataFrame) -> DataFrame:
    """Size and place of each asset's resource of its own type, else of its first one."""
    wanted = F.when(F.col("media_type") == "video", "video").otherwise("photo")
    rows = resources.join(assets.select("asset_id", "media_type", "media_subtypes"), "asset_id").withColumn("rank", F.struct((F.col("resource_type") != wanted).alias("other"), "ord"))
    return rows.groupBy("library_id", "asset_id", "media_type", "media_subtypes").agg(F.min_by(F.struct("file_size", "locally_available"), "rank").alias("r")).select("library_id", "asset_id", "media_type", "media_subtypes", "r.file_size", "r.locally_available")


def first_sized_resource(assets: DataFrame, resources: DataFrame) -> DataFrame:
    rows = resources.join(assets.select("asset_id", "media_type"), "asset_id")
    right = ((F.col("media_type") == "image") & F.col("resource_type").isin("photo", "fullSizePhoto")) | ((F.col("media_type") == "video") & F.col("resource_type").isin("video", "fullSizeVideo"))
    return rows.where(right & F.col("file_size").isNotNull()).groupBy("library_id", "asset_id", "media_type").agg(F.min_by("file_size", "ord").alias("bytes"))


def first_resource_bytes(resources: DataFrame) -> DataFrame:
    return resources.groupBy("library_id", "asset_id").agg(F.coalesce(F.min_by(F.struct("file_size"), "ord")["file_size"], F.lit(0)).alias("bytes"))


def large_videos(assets: DataFrame, resources: DataFrame, least: int = K.LARGE_FILE) -> DataFrame:
    """Videos and live pictures whose primary resource is large."""
    chosen = assets.where((F.col("media_type") == "video") | ((F.col("media_type") == "image") & has_bit(K.LIVE)))
    return primary_resource(chosen, resources).where(F.col("file_size") >= least)


def large_photos(assets: DataFrame, resources: DataFrame, least: int = K.LARGE_PHOTO) -> DataFrame:
    return primary_resource(images(assets), resources).where(F.col("file_size") >= least)


def large_files(files: DataFrame, least: int = K.LARGE_FILE) -> DataFrame:
    """Visible files of at least ``least`` bytes from a file inventory."""
    return files.where(~F.col("is_dir") & (F.col("length") >= least) & ~F.col("path").rlike(r"(^|/)[.]"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """An inventory of a file tree (path, length, is_dir); contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.lit(False).alias("is_dir"))


def largest_files(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Both sources of large files with one shape."""
    a = videos.select(F.lit("asset").alias("source_type"), F.col("asset_id").cast("string").alias("key"), F.col("file_size").alias("bytes"))
    return a.unionByName(files.select(F.lit("file").alias("source_type"), F.col("path").alias("key"), F.col("length").alias("bytes")))


def lookup_by_ids(assets: DataFrame, ids: DataFrame) -> DataFrame:
    return assets.join(ids, "asset_id", "left_semi")


def full_name() -> Column:
    return F.concat_ws(" ", F.nullif(F.col("given_name"), F.lit("")), F.nullif(F.col("family_name"), F.lit("")))


def filled_fields() -> Column:
    parts = [F.col("given_name") != "", F.col("family_name") != "", F.col("organization_name") != "", F.size("phone_numbers") > 0, F.size("emails") > 0, F.col("birthday").isNotNull(), F.col("image_available")]
    total = F.lit(0)
    for p in parts:
        total = total + p.cast("int")
    return total


def labelled_dirs(files: DataFrame, least: dict[str, int]) -> DataFrame:
    """Pictures a class folder, whether each class has enough; a class without pictures counts 0."""
    found = files.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("label"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext")).where(F.col("ext").isin("jpg", "jpeg", "png", "heic", "tiff"))
    wanted = files.sparkSession.createDataFrame(list(least.items()), "label string, least int")
    counts = found.groupBy("label").agg(F.count("*").alias("n"))
    return wanted.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("enough"), F.col("n").isNull().alias("missing"))


def folded_name() -> Column:
    return normalize_name(full_name())
