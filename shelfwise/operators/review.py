"""Review state, decisions, deletion plans, snapshots and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.operators.groups import key_of, merge_replace

REASONS = ("exactDuplicate", "nearDuplicate", "visuallySimilar", "burstShot")


def keyed(groups: DataFrame) -> DataFrame:
    return groups.withColumn("key", key_of())


def states(groups: DataFrame, state: DataFrame) -> DataFrame:
    """Groups with ``kind`` completed or skipped; completed wins; others have none."""
    best = state.where("kind in ('completed', 'skipped')").groupBy("library_id", "key").agg(F.min("kind").alias("kind"))
    return keyed(groups).join(best, ["library_id", "key"], "left")


def marked(state: DataFrame) -> DataFrame:
    return state.where("kind = 'marked'").select("library_id", F.col("key").cast("long").alias("asset_id")).distinct()


def reviewed_ids(groups: DataFrame, state: DataFrame) -> DataFrame:
    """Marked items and members of completed or skipped groups, once each."""
    seen = states(groups, state).where("kind is not null").select("library_id", F.explode("members").alias("asset_id"))
    return marked(state).union(seen).distinct()


def unreviewed(groups: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Groups without any reviewed member."""
    touched = groups.select("library_id", "group_id", F.explode("members").alias("asset_id")).join(reviewed, ["library_id", "asset_id"], "left_semi").select("library_id", "group_id").distinct()
    return groups.join(touched, ["library_id", "group_id"], "left_anti")


def members_marked(groups: DataFrame, state: DataFrame) -> DataFrame:
    """One row a member with its place and whether it is marked."""
    rows = groups.select("library_id", "group_id", F.posexplode("members").alias("pos", "asset_id"))
    return rows.join(marked(state).withColumn("marked", F.lit(True)), ["library_id", "asset_id"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def build_decisions(groups: DataFrame, state: DataFrame, labels: DataFrame, scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """(library_id, group_id, kept_id, kept_vec, deleted): groups with marks and at least one member left.

    The least member that is not marked counts as kept; the deleted ones carry labels, scores and vectors. Members
    without a vector have a null one.
    """
    rows = members_marked(groups, state)
    rows = rows.join(labels.select("asset_id", "labels"), "asset_id", "left").join(scores.select("asset_id", "score"), "asset_id", "left").join(vectors.select("asset_id", "vec"), "asset_id", "left")
    fields = ("asset_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("score", F.lit(0.5)).alias("score"), "vec")
    gone = F.array_sort(F.collect_list(F.when(F.col("marked"), F.struct(*fields))))
    kept = F.min(F.when(~F.col("marked"), F.struct("asset_id", "vec")))
    out = rows.groupBy("library_id", "group_id").agg(kept.alias("kept"), gone.alias("deleted"))
    return out.where("kept is not null and size(deleted) > 0").select("library_id", "group_id", F.col("kept.asset_id").alias("kept_id"), F.col("kept.vec").alias("kept_vec"), "deleted")


def decision_vectors(decisions: DataFrame) -> DataFrame:
    """(library_id, group_id, asset_id, vec, label): both sides of decisions that carry their vectors."""
    kept = decisions.where("kept_vec is not null").select("library_id", "group_id", F.col("kept_id").alias("asset_id"), F.col("kept_vec").alias("vec"), F.lit("kept").alias("label"))
    gone = decisions.select("library_id", "group_id", F.explode("deleted").alias("d")).where("d.vec is not null").select("library_id", "group_id", "d.asset_id", "d.vec", F.lit("deleted").alias("label"))
    return kept.union(gone)


def deletion_plan(groups: DataFrame, state: DataFrame, bytes_: DataFrame) -> DataFrame:
    """(library_id, n, bytes, completed): what the marks free, and the groups they complete."""
    rows = members_marked(groups, state)
    touched = rows.where("marked").groupBy("library_id").agg(F.count_distinct("group_id").alias("completed"))
    freed = marked(state).join(bytes_.select("library_id", "asset_id", "bytes"), ["library_id", "asset_id"]).groupBy("library_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return freed.join(touched, "library_id", "left").select("library_id", "n", "bytes", F.coalesce("completed", F.lit(0)).alias("completed"))


#: Tables of a snapshot and their columns; a version that lacks one reads as empty.
TABLES = {
    "groups": "library_id string, group_id long, reason string, members array<long>", "blurry": "library_id string, asset_id long", "screenshots": "library_id string, asset_id long",
    "large": "library_id string, ids array<long>, sizes array<long>", "files": "library_id string, path string", "rolls": "library_id string, members array<long>", "picks": "library_id string, asset_id long",
}


def write_snapshot(tables: dict[str, DataFrame], path: str, version: int, files_there: DataFrame | None = None) -> None:
    """Every result as a table in a folder of this version, the header last: a reader that finds it finds all, and until
    then the version before. Rows of ``files`` whose path is not in ``files_there`` are left out."""
    for name, df in tables.items():
        if name == "files" and files_there is not None:
            df = df.join(files_there.select("path").distinct(), "path", "left_semi")
        df.select(*TABLES_COLUMNS[name]).write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, sorted(tables))], "version int, names array<string>").coalesce(1).write.mode("append").json(f"{path}/snapshots")


TABLES_COLUMNS = {name: [c.split(" ")[0] for c in columns.split(", ")] for name, columns in TABLES.items()}


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of the newest version whose header is there; tables that it lacks are empty."""
    head = spark.read.schema("version int, names array<string>").json(f"{path}/snapshots").orderBy(F.desc("version")).first()
    return {n: spark.read.schema(c).parquet(f"{path}/v{head.version}/{n}") if n in (head.names or []) else spark.createDataFrame([], c) for n, c in TABLES.items()}


def refresh_snapshot(before: dict[str, DataFrame], found: DataFrame, blurry: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables of the next snapshot, new results a library): found groups merged into the previous ones, blurry pictures
    added to the known ones, everything else as it was."""
    cols = TABLES_COLUMNS["groups"]
    both = before["groups"].select(*cols).withColumn("arrival", F.lit(0)).unionByName(found.select(*cols).withColumn("arrival", F.lit(1)))
    merged = merge_replace(both)
    known = keyed(before["groups"]).select("library_id", "key").distinct()
    fresh = merged.join(known, ["library_id", "key"], "left_anti").select("library_id")
    seen = append_new(before["blurry"], blurry.select("library_id", "asset_id"), ["library_id", "asset_id"])
    added = blurry.join(before["blurry"], ["library_id", "asset_id"], "left_anti").select("library_id")
    return before | {"groups": merged.select(*cols), "blurry": seen}, fresh.unionAll(added).groupBy("library_id").agg(F.count("*").alias("n"))


SNAPSHOT = "version int, saved_at double, groups array<struct<ids: array<long>, similarity: double, reason: string>>, blurry array<long>, screenshots array<long>, large_ids array<long>, large_sizes array<long>"


def decode_snapshot(document: str = "document") -> Column:
    """A snapshot document as a struct; lists that an older version lacks are empty."""
    raw = F.from_json(document, SNAPSHOT)
    lists = ("groups", "blurry", "screenshots", "large_ids", "large_sizes")
    types = {"groups": "array<struct<ids: array<long>, similarity: double, reason: string>>"}
    return F.struct(raw["version"].alias("version"), raw["saved_at"].alias("saved_at"), *[F.coalesce(raw[x], F.array().cast(types.get(x, "array<long>"))).alias(x) for x in lists])


def rebuild(groups: DataFrame, assets: DataFrame) -> DataFrame:
    """Groups over the assets that still exist: unknown reasons go, and what has fewer than two members left."""
    rows = groups.where(F.col("reason").isin(*REASONS)).select("library_id", "group_id", "reason", F.posexplode("members").alias("pos", "asset_id"))
    kept = rows.join(assets.select("asset_id"), "asset_id", "left_semi")
    out = kept.groupBy("library_id", "group_id", "reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "asset_id"))), lambda x: x["asset_id"]).alias("members"))
    return out.where("size(members) >= 2")


def zip_parallel(rows: DataFrame, ids: str, sizes: str) -> DataFrame:
    """Two lists of equal length as rows; lists of different lengths give none."""
    pair = F.when(F.size(ids) == F.size(sizes), F.arrays_zip(F.col(ids).alias("id"), F.col(sizes).alias("size")))
    return rows.select("library_id", F.explode(pair).alias("x")).select("library_id", "x.id", "x.size")


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return existing.unionByName(new.join(existing.select(*key), key, "left_anti"))


def last_decisions(decisions: DataFrame, n: int = 500) -> DataFrame:
    w = Window.partitionBy("library_id").orderBy(F.desc("recorded_at"), "decision_id")
    return decisions.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def training_rows(decisions: DataFrame) -> DataFrame:
    """(decision_id, asset_id, vec_id, label): the kept side and each deleted one that has a vector."""
    kept = decisions.where("kept_vec_id is not null").select("library_id", "decision_id", F.col("kept_id").alias("asset_id"), F.col("kept_vec_id").alias("vec_id"), F.lit("kept").alias("label"))
    gone = decisions.select("library_id", "decision_id", F.explode("deleted").alias("d")).where("d.vec_id is not null").select("library_id", "decision_id", "d.asset_id", "d.vec_id", F.lit("deleted").alias("label"))
    return kept.union(gone)


def curate(files: DataFrame, most: int = 600, order: str | None = None) -> DataFrame:
    """A balanced pick of training pictures: labels from opinion score and brightness, ``most`` a class by hash."""
    label = F.when(F.col("mean_luma") > 220, "overexposed").when(F.col("mean_luma") < 30, "underexposed").when(F.col("mos") >= 70, "sharp").when(F.col("mos") <= 30, "blurry")
    rows = files.select("doc_id", label.alias("label")).where("label is not null")
    w = Window.partitionBy("label").orderBy(F.col(order) if order else F.xxhash64("doc_id"), "doc_id")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("doc_id", "label")


def fit_classifier(rows: DataFrame, label: str, features: str, multinomial: bool, iterations: int = 25) -> tuple[DataFrame, float]:
    """(predictions on a fifth held out by hash, its accuracy) of a logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    data = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(rows).withColumn("x", array_to_vector(features))
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=0.01, family="multinomial" if multinomial else "auto").fit(data.where(~held))
    out = model.transform(data.where(held))
    return out.select("id", label, "y", "prediction"), MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(out)
