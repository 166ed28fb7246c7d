"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by the order of its nearest reference points (pivots). Inverted lists, one a pivot,
bring together vectors that have the pivot among their nearest; the pivots that two vectors share are counted, and
pairs that share enough are verified by their cosine in double precision. A pair belongs to the list of the first
pivot that it shares.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm import textscan as ts
from shelfwise.operators.components import connected_components
from shelfwise.session import settle

COSINE = 0.95
#: Pivots grow with the square root of the vectors, within these bounds and PIVOT_VALUES numbers together.
PIVOTS = (64, 65_536)
PIVOT_VALUES = 8 << 20
#: Nearest pivots kept of each vector, and how many of them a pair has to share.
NEAREST = 8
SHARED = 2
#: Rows of a block; lists beyond it are compared block by block.
BLOCK = 1_024


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, dim, content): usable vectors; content names equal directions bit by bit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, dims, keys = [], [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                if v is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                x = x + 0.0  # no negative zero
                ids.append(i)
                vecs.append(v)
                dims.append(len(x))
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.list_(pa.float64())), "dim": pa.array(dims, pa.int32()), "content": pa.array(keys, pa.binary())})

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null")
    return source.mapInArrow(scan, "vec_id long, vec array<double>, dim int, content binary")


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _grid(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def choose_pivots(reps: DataFrame, dim: int, count: int) -> np.ndarray:
    """Reference points: a sample by hash, growing with the square root of ``count``."""
    m = min(PIVOTS[1], max(PIVOTS[0], 2 * math.isqrt(count)), max(1, PIVOT_VALUES // dim))
    rows = reps.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).collect()
    return _unit(np.array([r.vec for r in rows], np.float64))


def described(reps: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """Adds ``pivots``: the nearest pivots of each vector, nearest first."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        k = min(nearest, len(points))
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            grid = _unit(_grid(batch.column("vec"), points.shape[1]))
            for a in range(0, len(grid), 4096):
                cosine = grid[a : a + 4096] @ points.T
                out.append(np.argsort(-cosine, axis=1, kind="stable")[:, :k].astype(np.int32))
            near = np.concatenate(out)
            yield batch.append_column("pivots", ts.lists(near.ravel(), np.full(len(near), k), pa.int32()))

    return reps.mapInArrow(scan, T.StructType([*reps.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType()))]))


def _block_links(cosine: float, shared: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def links(key: tuple, table: pa.Table) -> pa.Table:
        pivot, left, right = (x.as_py() for x in key[:3])
        ids, size, chunk = (table.column(k).to_numpy() for k in ("vec_id", "size", "chunk"))
        order = np.lexsort((ids, chunk))
        ids, size, chunk = ids[order], size[order], chunk[order]
        dim = table.column("dim")[0].as_py()
        grid = _unit(_grid(table.column("vec"), dim))[order]
        near = _grid(table.column("pivots"), len(table.column("pivots")[0]))[order]
        a, b = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        pivots, place = np.unique(near, return_inverse=True)
        has = np.zeros((len(ids), len(pivots)), np.float32)
        has[np.arange(len(ids))[:, None], place.reshape(near.shape)] = 1
        has = has[:, has.sum(0) > 1]
        mask = has[a] @ has[b].T >= min(shared, near.shape[1])  # pivots in common
        if left == right:
            mask = np.triu(mask, 1)
        if mask.any():
            mask &= grid[a] @ grid[b].T >= cosine
        i, j = np.nonzero(mask)
        i, j = a[i], b[j]
        keep = np.empty(len(i), bool)
        for s in range(0, len(i), 1 << 16):  # whether this list is the first of the pair
            e = slice(s, s + (1 << 16))
            same = (near[i[e]][:, :, None] == near[j[e]][:, None, :]).any(2)
            keep[e] = np.where(same, near[i[e]], 1 << 30).min(1) == pivot
        i, j = i[keep], j[keep]
        count = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
        label = np.arange(len(ids))
        while True:  # components within the block
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        at = np.flatnonzero(count)
        return pa.table({"vec_id": pa.array(ids[at], pa.int64()), "n": pa.array(count[at].astype(np.int64), pa.int64()), "root": pa.array(ids[label[at]], pa.int64())})

    return links


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """Links, component and keeper of every vector.

    Null and zero vectors, and those with null or non-finite components, link with nothing; neither do vectors
    of different lengths. Equal vectors are merged first and always link. ``vec_id`` names a vector: rows
    without it are left out, repeated rows count once but come back as often as they came. Labels and other
    columns are ignored. Dense lists are compared block against block, however long.
    """
    clean = settle(_clean(vectors), "vectors")
    same = clean.groupBy("content", "dim").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("size"))
    same = settle(same, "same")
    of = clean.select("vec_id", "content").distinct().join(same, "content").groupBy("vec_id").agg(F.min_by(F.struct("rep", "size"), "rep").alias("x")).select("vec_id", "x.rep", "x.size")
    reps = clean.join(same.select(F.col("rep").alias("vec_id"), "content", "size"), ["vec_id", "content"]).dropDuplicates(["vec_id"]).select("vec_id", "vec", "dim", "size")
    found = None
    for dim, count in [(r.dim, r["count"]) for r in same.groupBy("dim").count().where(f"count > {BLOCK}").orderBy("dim").toLocalIterator()]:
        own = reps.where(F.col("dim") == dim)
        posted = settle(described(own, choose_pivots(own, dim, count), nearest), "posted")
        lists = posted.select("vec_id", F.explode("pivots").alias("pivot"))
        chunks = lists.groupBy("pivot").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) as int)").alias("chunks"))  # one row a pivot
        rows = posted.select("*", F.explode("pivots").alias("pivot")).join(F.broadcast(chunks), "pivot").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
        part = rows.select("vec_id", "size", "dim", "vec", "pivots", "pivot", "chunk", "left", "right").groupBy("pivot", "left", "right").applyInArrow(_block_links(cosine, shared), "vec_id long, n long, root long")
        found = part if found is None else found.unionByName(part)
    # lengths that fill no more than a block have one list each, with one pivot
    few = reps.join(same.groupBy("dim").count().where(f"count <= {BLOCK}").select("dim"), "dim").withColumn("pivots", F.array(F.lit(0)))
    few = few.withColumn("pivot", F.lit(0)).withColumn("chunk", F.lit(0)).withColumn("left", F.lit(0)).withColumn("right", F.lit(0))
    part = few.groupBy("pivot", "left", "right", "dim").applyInArrow(_block_links(cosine, 1), "vec_id long, n long, root long")
    found = part if found is None else found.unionByName(part)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").join(of, "vec_id", "left")
    found = settle(found, "links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "rep")
    joined = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    out = every.join(links, "rep", "left").join(joined, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def recall(vectors: DataFrame, result: DataFrame, queries: int = 200, cosine: float = COSINE) -> float:
    """Share of the links of ``queries`` vectors (chosen by hash) that ``result`` counts, against all rows."""
    clean = _clean(vectors).dropDuplicates(["vec_id"])
    chosen = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    ids, grid = [r.vec_id for r in chosen], [_unit(np.array([r.vec]))[0] for r in chosen]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                x = _unit(np.array([v]))[0]
                hit = [q for q, y in zip(ids, grid, strict=True) if q != i and len(y) == len(x) and x @ y >= cosine]
                if hit:
                    yield pa.RecordBatch.from_pydict({"vec_id": pa.array(hit, pa.int64())})

    want = clean.mapInArrow(count, "vec_id long").groupBy("vec_id").count()
    row = want.join(result.dropDuplicates(["vec_id"]), "vec_id").agg(F.sum("count"), F.sum(F.least("count", "n_links"))).first()
    return row[1] / row[0] if row[0] else 1.0
