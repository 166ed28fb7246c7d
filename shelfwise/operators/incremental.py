"""Near and similar groups that grow as pictures arrive, equal at any time to a scan of all that has come.

What is known is kept in a folder: prints in cells about pivots, or by day, and the rows of components. A step pairs
the pictures of its batch with each other and with the known ones of the cells or days that they reach, and writes
only into folders named by its number: doing a step again reads what was there before it and writes the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import constants as K
from shelfwise.functions.vectors import epoch_us, l2
from shelfwise.operators import pairs
from shelfwise.operators.components import extend_components
from shelfwise.session import drop, settle


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet folder with its partition columns; no rows where it is not there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _with(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.IntegerType()) for n in names]])


def _label(path: str, no: int, found: DataFrame) -> None:
    """Adds what the pairs of step ``no`` change in the components."""
    kind = found.schema["a"].dataType
    schema = _with(T.StructType([T.StructField("id", kind), T.StructField("component", kind)]), "batch")
    known = _read(found.sparkSession, f"{path}/labels", schema).where(F.col("batch") < no).drop("batch")
    changed = extend_components(known, found)
    changed.write.mode("overwrite").parquet(f"{path}/labels/batch={no}")
    drop(changed)


def labels(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(asset_id, component) after all steps."""
    rows = _read(spark, f"{path}/labels", _with(T._parse_datatype_string(f"id {kind}, component {kind}"), "batch"))
    return rows.groupBy(F.col("id").alias("asset_id")).agg(F.min("component").alias("component"))


def _generation(spark: SparkSession, path: str, no: int) -> tuple[int, int, dict[int, np.ndarray]] | None:
    """The last choice of pivots before step ``no``: its number, the rows there were, the pivots (1 024 at most)."""
    rows = _read(spark, f"{path}/pivots", T._parse_datatype_string("dim int, vec array<double>, dealt long, gen int")).where(F.col("gen") < no)
    last = rows.agg(F.max("gen")).first()[0]
    if last is None:
        return None
    chosen: dict[int, list] = {}
    dealt = 0
    for r in rows.where(F.col("gen") == last).orderBy("dim", "vec").collect():
        dealt = r.dealt
        if r.vec is not None:
            chosen.setdefault(r.dim, []).append(r.vec)
    return last, dealt, {d: np.unique(np.array(v), axis=0) for d, v in chosen.items()}


def reached(known: DataFrame, visits: DataFrame) -> DataFrame:
    """The known prints of cells that a visit reaches; other cells' files are not read (cells are pivots at most)."""
    return known.where(F.col("cell").isin([r.cell for r in visits.select("cell").distinct().collect()]))


def near_step(new: DataFrame, path: str, no: int, limit: float = K.NEAR) -> None:
    """Takes the prints ``new`` (library_id, asset_id, vec) as step ``no``.

    Known prints lie in the cells of their nearest pivots. A new one visits each cell whose pivot is at most twice
    the limit further away than its nearest: by the triangle inequality no close one lies elsewhere. Where cells don't
    pay there are no pivots, and one cell. Pivots are
    chosen again, and the known prints dealt again, whenever there are twice as many, so dealing costs a constant
    number of writes a print. Cells are written rebalanced: a small one is one file, a hot one many. Prints that can't be compared are in no pair. An id that comes again counts with both
    its prints.
    """
    spark = new.sparkSession
    new = settle(pairs.vectors(new), "arrived")
    before, here = _generation(spark, path, no), new.count()
    cells = _with(new.schema, "batch", "cell")
    known = _read(spark, f"{path}/cells/gen={before[0]}", cells).where(F.col("batch") < no) if before else spark.createDataFrame([], cells)
    total = known.count() + here
    if before and total < 2 * before[1]:
        gen, pivots = before[0], before[2]
    else:
        gen, every = no, known.select(new.columns).union(new)
        pivots = pairs.choose_pivots(every, total, limit)
        rows = [(None, None, total), *[(d, v.tolist(), total) for d, grid in pivots.items() for v in grid]]
        spark.createDataFrame(rows, "dim int, vec array<double>, dealt long").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots/gen={gen}")
        again = pairs.in_cells(known.select(new.columns), pivots, limit).where("not guest").drop("guest")
        again.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells/gen={gen}/batch=-1")
        known = _read(spark, f"{path}/cells/gen={gen}", cells).where(F.col("batch") < no)
    homes = settle(pairs.in_cells(new, pivots, limit, every=True), "homes")
    visits = homes.where("guest")
    both = reached(known, visits).select(*new.columns, "cell", F.lit(False).alias("guest")).union(visits.select(*new.columns, "cell", "guest"))
    met = settle(both, "visits")
    found = pairs.cell_pairs(met, limit, ["library_id"], within=False).union(pairs.pivot_pairs(new, limit))
    _label(path, no, found)
    homes.where("not guest").drop("guest").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells/gen={gen}/batch={no}")
    drop(new, homes, met)


def similar_step(new: DataFrame, path: str, no: int, limit: float = K.SIMILAR, bucket_s: int = 900) -> None:
    """Takes the prints ``new`` (library_id, asset_id, creation_date, vec) as step ``no``.

    Similar ones are of one time bucket, and known prints lie by the days of their buckets: days outside the new
    ones' range are not read. Prints without a date are in no pair.
    """
    spark = new.sparkSession
    bucket = F.floor(epoch_us(F.col("creation_date")) / (bucket_s * 1_000_000))
    rows = new.where("creation_date is not null").select("library_id", "asset_id", "creation_date", "vec", bucket.alias("bucket"))
    new = settle(rows.withColumn("day", F.floor(F.col("bucket") * bucket_s / 86_400).cast("int")), "arrived")
    first, last = new.agg(F.min("day"), F.max("day")).first()
    stored = _with(new.drop("day").schema, "batch", "day")
    known = _read(spark, f"{path}/days", stored).where((F.col("batch") < no) & F.col("day").between(first, last))
    side = lambda df, c: df.select("library_id", "bucket", F.col("asset_id").alias(c), F.col("vec").alias(f"v{c}"))
    across = side(new, "x").join(side(known, "y"), ["library_id", "bucket"]).withColumn("distance", l2(F.col("vx"), F.col("vy"))).where((F.col("distance") < limit) & (F.col("x") != F.col("y")))
    found = across.select("library_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").union(pairs.bucket_pairs(new.drop("bucket", "day"), limit, bucket_s))
    _label(path, no, found)
    new.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/days/batch={no}")
    drop(new)
