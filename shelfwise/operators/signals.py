"""Quality labels, scores, categories and wasted shots over vision columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import constants as K
from shelfwise.functions.text import contains_any, shared_filename
from shelfwise.functions.vectors import epoch_us
from shelfwise.operators.scans import has_bit


def eyes_closed() -> Column:
    return F.exists("faces", lambda f: (f["left_ear"] < 0.15) & (f["right_ear"] < 0.15))


def face_label() -> Column:
    return F.when(eyes_closed(), "Eyes Closed").when(F.exists("faces", lambda f: f["capture_quality"] < 0.25), "Low Quality")


def exposure_label() -> Column:
    return F.when(F.col("luma") < 0.12, "Too Dark").when(F.col("luma") > 0.93, "Overexposed")


def no_subject() -> Column:
    """No salient object; a missing result is not a finding."""
    return F.coalesce(F.col("salient_count") == 0, F.lit(False))


def quality_labels() -> Column:
    """Ordered labels; ``is_blurry`` must be a column."""
    return F.array_compact(F.array(F.when(F.col("is_blurry"), "Blurry"), exposure_label(), face_label(), F.when(no_subject(), "No Subject")))


def heuristic_quality(labels: str = "labels") -> Column:
    # What each label takes off.
    cost = {"Blurry": 0.3, "Eyes Closed": 0.2, "Too Dark": 0.15, "Overexposed": 0.15, "Low Quality": 0.2, "No Subject": 0.15}
    score = F.lit(0.5)
    for name, x in cost.items():
        score = score - F.when(F.array_contains(labels, name), x).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def model_quality(probs: DataFrame) -> DataFrame:
    """Score from class probabilities; a missing class counts 0."""
    # Weight of each class.
    weight = {"sharp": 1.0, "blurry": -0.7, "overexposed": -0.5, "underexposed": -0.5}
    table = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])
    total = F.sum(F.coalesce(F.try_element_at(table, F.col("label")), F.lit(0.0)) * F.col("confidence")) + 0.5
    return probs.groupBy("library_id", "asset_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"))


def semantic_category(observations: DataFrame) -> DataFrame:
    """(asset_id, semantic_category): the first observation of at least 0.4 that names a category decides.

    Categories are tried in order; a deciding observation of exactly 0.4 means none.
    """
    prefixes = [(i, name, p) for i, (name, ps) in enumerate(K.CATEGORY_PREFIXES.items()) for p in ps]
    table = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(name).alias("name"), F.lit(p).alias("prefix")) for i, name, p in prefixes])
    rows = observations.select("asset_id", F.posexplode("observations").alias("pos", "o")).where("o.confidence >= 0.4").select("asset_id", (-F.col("o.confidence")).alias("rank"), "pos", F.lower("o.identifier").alias("identifier"), F.col("o.confidence").alias("confidence"))
    hits = rows.select("*", F.get(F.filter(table, lambda t: F.col("identifier").contains(t["prefix"])), 0).alias("hit")).where("hit is not null")
    first = hits.groupBy("asset_id").agg(F.min_by(F.struct("hit", "confidence"), F.struct("rank", "pos")).alias("x"))
    return first.where("x.confidence > 0.4").select("asset_id", F.col("x.hit.name").alias("semantic_category"))


def wasted_reason() -> Column:
    """First reason that applies, cheap signals first; needs vision columns and ``is_blurry``."""
    joined = F.lower(F.array_join("ocr_lines", " "))
    screen = F.exists("observations", lambda o: (o["confidence"] > 0.35) & contains_any(o["identifier"], K.SCREENS))
    lines = F.size("ocr_lines")
    return (
        F.when(F.col("luma") < 0.08, "darkShot").when(F.col("barcode_count") > 0, "qrCode").when(screen, "screenPhoto")
        .when((F.col("luma") > 0.55) & (lines >= 6) & (F.size("faces") == 0), "whiteboard").when((lines > 0) & (contains_any(joined, K.WATERMARKS) | (lines >= 14)), "memeForwarded")
        .when((F.col("luma") >= 0.08) & (F.col("luma") < 0.15), "lowLight").when(eyes_closed(), "eyesClosed").when(no_subject(), "noSubject").when(F.col("is_blurry"), "blurryPhoto")
    )


def shared_photos(assets: DataFrame, first: DataFrame) -> DataFrame:
    """Assets with at least three of five signs of having been received; ``first`` is each first resource."""
    rows = assets.join(first.select("asset_id", "original_filename", "file_size"), "asset_id", "left")
    signs = [
        F.col("latitude").isNull(), shared_filename(F.col("original_filename")), F.coalesce((F.col("file_size") > 0) & (F.col("file_size") < 500_000), F.lit(False)),
        F.coalesce(F.abs(epoch_us(F.col("creation_date")) - epoch_us(F.col("modification_date"))) > 60_000_000, F.lit(False)), F.col("burst_identifier").isNull() & ~has_bit(K.LIVE) & ~has_bit(K.DEPTH),
    ]
    total = F.lit(0)
    for s in signs:
        total = total + s.cast("int")
    return rows.withColumn("signals", total).where("signals >= 3")
