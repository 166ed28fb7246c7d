"""Pair joins by hash, distance and time, without comparing everything with everything."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import constants as K
from shelfwise.functions.vectors import epoch_us, hamming64, l2
from shelfwise.session import settle

#: Vectors of a block of a distance matrix, and pivots (one for a block's worth of vectors) at most.
BLOCK = 1_024
PIVOTS = 1_024
#: Large cells are dealt into so many blocks, as long as a block has no more numbers than that.
BLOCKS, NUMBERS = 12, 2 << 20
#: A copy of a vector costs as much as so many comparisons; fewer guests to a vector than those are always worth it.
WORTH, GUESTS = 5_000, 4
#: A tile of a distance matrix, and the coordinates that are looked at first.
TILE, FIRST = (1_024, 8_192), 16


def bucket_pairs(prints: DataFrame, limit: float = K.SIMILAR, bucket_s: int = 900) -> DataFrame:
    """(library_id, a, b, distance) of pictures of one time bucket closer than ``limit``."""
    rows = prints.withColumn("bucket", F.floor(epoch_us(F.col("creation_date")) / (bucket_s * 1_000_000)))
    a = rows.select("library_id", "bucket", F.col("asset_id").alias("a"), F.col("vec").alias("va"))
    b = rows.select("library_id", "bucket", F.col("asset_id").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, ["library_id", "bucket"]).where("a < b").withColumn("distance", l2(F.col("va"), F.col("vb"))).where(F.col("distance") < limit).select("library_id", "a", "b", "distance")


def _grid(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def _homes(pivots: dict[int, np.ndarray], limit: float, every: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each vector its cell, that of the nearest pivot, and a row as ``guest`` of each later cell that may hold
    a vector closer than ``limit``: one to which its distance is at most that of its own pivot plus twice the limit.
    With ``every``, it is a guest of all such cells, the earlier ones and its own too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 2 * BLOCK):
                    part = batch.take(pa.array(at[lo : lo + 2 * BLOCK]))
                    if not dim or dim not in pivots:
                        yield _with(part, np.zeros(part.num_rows, np.int32), False)
                        if every:
                            yield _with(part, np.zeros(part.num_rows, np.int32), True)
                        continue
                    far = np.sqrt(np.maximum(_squares(_grid(part.column("vec")), pivots[dim]), 0))
                    home = far.argmin(1)
                    yield _with(part, home.astype(np.int32), False)
                    row, cell = np.nonzero((far <= far.min(1, keepdims=True) + 2 * limit + 1e-6) & (every | (np.arange(far.shape[1])[None, :] > home[:, None])))
                    if len(row):
                        yield _with(part.take(pa.array(row)), cell.astype(np.int32), True)

    return scan


def _with(batch: pa.RecordBatch, cell: np.ndarray, guest: bool) -> pa.RecordBatch:
    return batch.append_column("cell", pa.array(cell)).append_column("guest", pa.array([guest] * batch.num_rows, pa.bool_()))


def _augmented(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is that of the squared distances, in single precision."""
    one = np.ones((len(x), 1)), np.ones((len(y), 1))
    return np.hstack([-2 * x, (x * x).sum(1)[:, None], one[0]]).astype(np.float32), np.hstack([y, one[1], (y * y).sum(1)[:, None]]).astype(np.float32)


def _candidates(x: np.ndarray, y: np.ndarray, limit: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in ``x`` and ``y`` of all vectors closer than ``limit``, and of a few more, tile by tile; ``within``: j > i only.

    A distance over some coordinates is no larger than the whole one, so few coordinates leave little to look at again.
    Sums in single precision are off by less than the margin; where numbers are too large for it, double precision is used.
    """
    top = max(np.where(np.isfinite(v), np.abs(v), 0).max(initial=0) for v in (x, y))
    single = top < 1e6 and np.isfinite(x).all() and np.isfinite(y).all()
    if single:
        middle = x.mean(0) if len(x) else 0.0
        x, y = x - middle, y - middle
        most = max((x * x).sum(1).max(initial=0), (y * y).sum(1).max(initial=0))
        edge = limit * limit * (1 + 1e-5) + 3e-5 * most + 1e-30
        some = np.sort(np.argsort(-x.var(0), kind="stable")[:FIRST])
        few, full = _augmented(x[:, some], y[:, some]), None
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
    for lo in range(0, len(x), TILE[0]):
        for at in range(lo - lo % TILE[1] if within else 0, len(y), TILE[1]):
            r, c = slice(lo, lo + TILE[0]), slice(at, at + TILE[1])
            if not single:
                i, j = np.nonzero(_squares(x[r], y[c]) < limit * limit * (1 + 1e-9) + 1e-9 * (1 + top**2))
            else:
                close = few[0][r] @ few[1][c].T < edge
                place = np.flatnonzero(close)
                if len(place) > close.size // 50 and x.shape[1] > FIRST:
                    full = full or _augmented(x, y)
                    place = np.flatnonzero(full[0][r] @ full[1][c].T < edge)
                i, j = np.divmod(place, close.shape[1])
            i, j = i + lo, j + at
            if within:
                i, j = i[j > i], j[j > i]
            for k in range(0, len(i), 1 << 16):
                e, f = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                if single:
                    keep = ((x32[e] - y32[f]) ** 2).sum(1) < edge
                    e, f = e[keep], f[keep]
                yield e, f


def _block_pairs(keys: list[str], limit: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs of one block against another (``side`` 1 and 2), or within one (side 0)."""

    def pairs(table: pa.Table) -> pa.Table:
        kind, ids, side = table.column("asset_id").type, table.column("asset_id").to_numpy(), table.column("side").to_numpy()
        grid = _grid(table.column("vec"))
        x, y = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i, j in _candidates(grid[x], grid[y], limit, not side.any()):
            i, j = x[i], y[j]
            far = np.sqrt(np.cumsum((grid[i] - grid[j]) ** 2, axis=1)[:, -1])  # terms are added in order
            keep = (far < limit) & (ids[i] != ids[j])
            found.append((i[keep], j[keep], far[keep]))
        i, j, far = (np.concatenate(z) for z in zip(*found, strict=True))
        same = {k: table.column(k).combine_chunks().take(pa.array(i)) for k in keys}
        return pa.table({**same, "a": pa.array(np.minimum(ids[i], ids[j]), kind), "b": pa.array(np.maximum(ids[i], ids[j]), kind), "distance": pa.array(far)})

    return pairs


def vectors(prints: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(library_id, *extra, asset_id, vec, dim) of the vectors that can be compared."""
    return prints.where("vec is not null and size(vec) > 0 and forall(vec, x -> x is not null)").select("library_id", *extra, "asset_id", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim"))


def choose_pivots(rows: DataFrame, total: int, limit: float | None = None, keys: tuple[str, ...] = ("library_id",)) -> dict[int, np.ndarray]:
    """A few of ``total`` vectors by hash, for each length.

    With ``limit``, none where cells don't pay: where the guests of cells, told from 1 000 vectors, cost more to copy
    than it costs to compare all vectors of ``keys``.
    """
    count = min(PIVOTS, -(-total // BLOCK))
    pick = lambda df, seed, n: df.select("dim", "vec").orderBy(F.xxhash64("asset_id", F.lit(seed)) if seed else F.xxhash64("asset_id"), "asset_id").limit(n).collect()
    chosen: dict[int, list] = {}
    for r in pick(rows, 0, count) if count > 1 else []:
        chosen.setdefault(r.dim, []).append(r.vec)
    pivots = {d: np.unique(np.array(v), axis=0) for d, v in chosen.items()}
    if limit is None or not pivots:
        return pivots
    tried = [np.sqrt(np.maximum(_squares(np.array([r.vec]), pivots[r.dim]), 0)) for r in pick(rows, 1, 1_000) if r.dim in pivots]
    guests = sum(((far <= far.min() + 2 * limit).sum() - 1) / 2 for far in tried) / max(1, len(tried))
    whole = rows.groupBy(*keys, "dim").count().agg(F.sum(F.expr("cast(count as double) * count / 2"))).first()[0]
    return {} if guests >= GUESTS and whole <= WORTH * guests * total else pivots


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray], limit: float, every: bool = False) -> DataFrame:
    """``rows`` with ``cell`` and ``guest``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("guest", T.BooleanType())])
    return rows.mapInArrow(_homes(pivots, limit, every), schema)


def cell_pairs(homes: DataFrame, limit: float, keys: list[str], within: bool = True) -> DataFrame:
    """(*keys, a, b, distance) of guests of a cell and its own vectors; ``within`` gives pairs of its own ones too."""
    place = [*keys, "dim", "cell"]
    sizes = homes.groupBy(*place).agg(*[F.count_if(F.col("guest") == g).alias(n) for g, n in ((False, "own"), (True, "guests"))])
    sizes = sizes.withColumns({n: F.expr(f"cast(ceil({n} / greatest({BLOCK}, least({NUMBERS} div dim, ceil({n} / {BLOCKS})))) as int)") for n in ("own", "guests")})
    blocks = homes.join(sizes, [c for c in place]).withColumn("block", F.pmod(F.xxhash64("asset_id"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("own"))).cast("int"))
    # left blocks are those of guests and of the cell, right blocks those of the cell: (whether left are guests, left, right, side)
    kind = "array<struct<w:boolean,x:int,y:int,side:int>>"
    left = F.expr("transform(sequence(if(guest, 0, block), own - 1), y -> named_struct('w', guest, 'x', block, 'y', y, 'side', if(not guest and y = block, 0, 1)))").cast(kind)
    met = F.expr("transform(filter(sequence(0, guests), x -> x < guests), x -> named_struct('w', true, 'x', cast(x as int), 'y', block, 'side', 2))").cast(kind)
    right = F.expr("transform(filter(sequence(0, own), x -> x < block), x -> named_struct('w', false, 'x', cast(x as int), 'y', block, 'side', 2))").cast(kind)
    tasks = blocks.where("own > 0").withColumn("meet", F.when(F.col("guest"), left).otherwise(F.concat(left, right, met) if within else met))
    dealt = tasks.select(*place, "asset_id", "vec", F.inline("meet"))
    asset = homes.schema["asset_id"].dataType
    out = T.StructType([*homes.select(*keys).schema.fields, T.StructField("a", asset), T.StructField("b", asset), T.StructField("distance", T.DoubleType())])
    return dealt.groupBy(*place, "w", "x", "y").applyInArrow(_block_pairs(keys, limit), out)


def pivot_pairs(prints: DataFrame, limit: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """(library_id, *extra, a, b, distance) of vectors of a library closer than ``limit``; exact.

    Where :func:`choose_pivots` finds that it pays, vectors gather in cells about their nearest pivots. By the triangle inequality a vector can only be close to
    vectors of cells whose pivot is not much further away than its own, and it is sent there as well. Within a
    cell, blocks are compared with blocks as matrix products; a cell of very many vectors is many blocks. Vectors of
    different lengths, null ones and those with null elements are close to none. Pivots are a few vectors by hash.
    """
    rows = vectors(prints, extra)
    homes = settle(in_cells(rows, choose_pivots(rows, rows.count(), limit, ("library_id", *extra)), limit), "cells")
    return cell_pairs(homes, limit, ["library_id", *extra])


def equal_pairs(rows: DataFrame, keys: list[str], item: str, block: int = 4_096, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, a, b) of items with equal keys, a < b: a join of ``rows`` with themselves that hot keys don't hold up.

    Keys are counted. Items of a key with more than ``block`` rows are dealt into blocks by hash and each pair of blocks
    is a key of its own, so no task has more than two blocks of a key; each such item is copied once a block. Null
    items are in no pair, and rows that repeat give pairs that repeat. Columns named in ``carry`` come along as those
    of a and of b, with ``_a`` and ``_b`` at the end of their names.
    """
    rows = rows.where(F.col(item).isNotNull()).select(*keys, item, *carry)
    hot = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("k_")).where("k_ > 1")
    many = hot.limit(100_001).count()
    side = lambda c: [F.col(item).alias(c), *[F.col(x).alias(f"{c}{x}") for x in carry]]
    if not many:
        both = rows.select(*keys, *side("x_")).join(rows.select(*keys, *side("y_")), keys).where("x_ < y_")
        return both.select(*keys, F.col("x_").alias("a"), F.col("y_").alias("b"), *[F.col(f"{c}{x}").alias(f"{x}_{e}") for c, e in (("x_", "a"), ("y_", "b")) for x in carry])
    rows = rows.join(F.broadcast(hot) if many <= 100_000 else hot, keys, "left").withColumn("k_", F.coalesce("k_", F.lit(1))).withColumn("own_", F.pmod(F.xxhash64(item), "k_").cast("int"))
    x = rows.select(*keys, *side("x_"), F.col("own_").alias("i_"), F.explode(F.sequence("own_", F.col("k_") - 1)).alias("j_"))
    y = rows.select(*keys, *side("y_"), F.explode(F.sequence(F.lit(0), "own_")).alias("i_"), F.col("own_").alias("j_"))
    both = x.join(y, [*keys, "i_", "j_"]).where("i_ < j_ or x_ < y_")
    less = F.col("x_") < F.col("y_")
    carried = [F.when(less if e == "a" else ~less, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"{c}_{e}") for e in "ab" for c in carry]
    return both.select(*keys, F.least("x_", "y_").alias("a"), F.greatest("x_", "y_").alias("b"), *carried)


def hash_pairs(hashes: DataFrame, bits: int = K.HASH_BITS) -> DataFrame:
    """(library_id, a, b) of items whose 64-bit hashes differ in at most ``bits`` bits; exact.

    Of ``bits + 1`` bands at least one is equal. Equal hashes are joined once, so a hash shared by very many
    items does not multiply in the bands: their items form a star about the least id.
    """
    width = 64 // (bits + 1)
    heads = hashes.where("dhash is not null").groupBy("library_id", "dhash").agg(F.min("asset_id").alias("head"))
    same = hashes.join(heads, ["library_id", "dhash"]).where("asset_id <> head").select("library_id", F.col("head").alias("a"), F.col("asset_id").alias("b"))
    band = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("dhash", i * width).bitwiseAND((1 << width) - 1).alias("v")) for i in range(bits + 1)])
    near = equal_pairs(heads.select("library_id", F.inline(band), F.struct("head", "dhash").alias("item")), ["library_id", "i", "v"], "item")
    near = near.where(hamming64(F.col("a.dhash"), F.col("b.dhash")) <= bits).select("library_id", F.col("a.head").alias("a"), F.col("b.head").alias("b"))
    return same.union(near.distinct())


def all_hash_pairs(hashes: DataFrame, bits: int = K.HASH_BITS) -> DataFrame:
    """Like :func:`hash_pairs`, every pair written out.

    Bands pair distinct hashes only, so a pair of items is made once: by their equal hash, or by a pair of hashes
    (more often, and given once, where an item has several hashes).
    """
    width = 64 // (bits + 1)
    rows = hashes.where("dhash is not null and asset_id is not null").select("library_id", "dhash", "asset_id").distinct()
    band = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("dhash", i * width).bitwiseAND((1 << width) - 1).alias("v")) for i in range(bits + 1)])
    near = equal_pairs(rows.select("library_id", "dhash").distinct().select("library_id", F.inline(band), "dhash"), ["library_id", "i", "v"], "dhash")
    near = near.where(hamming64(F.col("a"), F.col("b")) <= bits).select("library_id", F.col("a").alias("ha"), F.col("b").alias("hb")).distinct()
    x, y = rows.toDF("library_id", "ha", "x"), rows.toDF("library_id", "hb", "y")
    across = near.join(x, ["library_id", "ha"]).join(y, ["library_id", "hb"]).where("x <> y").select("library_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal_pairs(rows, ["library_id", "dhash"], "asset_id").select("library_id", "a", "b").union(across).distinct()


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends are not in one component of ``joined`` (id, component)."""
    a, b = (joined.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in")) for c in ("a", "b"))
    labelled = pairs.join(a, "a", "left").join(b, "b", "left")
    return labelled.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select(pairs.columns)


def keyframe_pairs(frames: DataFrame, limit: float = K.KEYFRAME, joined: DataFrame | None = None) -> DataFrame:
    """(library_id, a, b, distance): videos whose index-aligned frames are on average closer than ``limit``.

    A mean below the limit needs one frame below it, so candidates come from the exact frame join. Those that
    are in one component of ``joined`` already are left out before any vector is fetched.
    """
    candidates = pivot_pairs(frames, limit, extra=("frame_idx",)).select("library_id", "a", "b").distinct()
    if joined is not None:
        candidates = apart(candidates, joined)
    a = frames.select("library_id", F.col("asset_id").alias("a"), "frame_idx", F.col("vec").alias("va"))
    b = frames.select("library_id", F.col("asset_id").alias("b"), "frame_idx", F.col("vec").alias("vb"))
    both = candidates.join(a, ["library_id", "a"]).join(b, ["library_id", "b", "frame_idx"])
    mean = both.groupBy("library_id", "a", "b").agg(F.avg(l2(F.col("va"), F.col("vb"))).alias("distance"))
    return mean.where(F.col("distance") < limit)


def equal_videos(frames: DataFrame) -> DataFrame:
    """(library_id, asset_id, head): the least id of the videos of a library whose frames are all the same.

    Frames are compared by a digest of all their numbers. Videos with missing, repeated or endless ones stand alone.
    """
    whole = F.array_sort(F.collect_list(F.struct("frame_idx", "vec"))).alias("f")
    plain = "forall(f, x -> x.frame_idx is not null and x.vec is not null and size(x.vec) > 0 and forall(x.vec, v -> v is not null and not isnan(v - v))) and size(array_distinct(f.frame_idx)) = size(f)"
    rows = frames.groupBy("library_id", "asset_id").agg(whole).select("library_id", "asset_id", F.expr(f"if({plain}, sha2(cast(f as string), 256), cast(asset_id as string))").alias("key"))
    return rows.join(rows.groupBy("library_id", "key").agg(F.min("asset_id").alias("head")), ["library_id", "key"]).select("library_id", "asset_id", "head")


def keyframe_links(frames: DataFrame, joined: Callable[[DataFrame], DataFrame], limit: float = K.KEYFRAME) -> DataFrame:
    """(library_id, a, b) of videos that join what :func:`keyframe_pairs` joins, with fewer pairs.

    Videos with the same frames form a star about one of them, which alone is compared with others. ``joined`` gives
    the components (id, component) that the stars and what is known besides make: pairs within one are left out.
    """
    same = settle(equal_videos(frames), "same")
    stars = same.where("asset_id <> head").select("library_id", F.col("head").alias("a"), F.col("asset_id").alias("b"))
    heads = frames.join(same.where("asset_id = head").select("library_id", "asset_id"), ["library_id", "asset_id"], "left_semi")
    return stars.union(keyframe_pairs(heads, limit, joined(stars)).select("library_id", "a", "b"))


def _signed(tables: int, width: float, seed: int, limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each vector its key in each table: a number for its buckets along several random unit vectors.

    There are as many unit vectors to a table as leave two vectors at the limit together in four tables of ten.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in known:
                    pick = np.random.default_rng([seed, dim])
                    stay = max(0.01, 1 - 0.8 * limit / (width * dim**0.5))
                    each = max(1, min(256, int(np.log(0.4) / np.log(stay))))
                    lines = pick.normal(size=(dim, tables * each))
                    known[dim] = lines / np.sqrt((lines * lines).sum(0)), pick.uniform(0, width, tables * each), pick.integers(1, 1 << 62, (tables, each), np.int64) | 1
                lines, start, mix = known[dim]
                at = np.floor((_grid(part.column("vec")) @ lines + start) / width).astype(np.int64).reshape(len(part), *mix.shape)
                keys = pa.array((at * mix).sum(2).reshape(-1))
                yield part.append_column("keys", pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, tables, dtype=np.int32)), keys))

    return scan


def lsh_pairs(prints: DataFrame, limit: float, tables: int = 6, width: float = 0.5, seed: int = 3) -> DataFrame:
    """Approximate form of :func:`pivot_pairs` for dense data, by random projections.

    Vectors with equal keys in a table are compared, and all pairs that are found are close. Of pairs at the limit about
    one in twenty is missed by six tables, of closer ones fewer. A key that very many share is dealt in pairs of blocks.
    """
    rows = vectors(prints)
    schema = T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    keyed = settle(rows.mapInArrow(_signed(tables, width, seed, limit), schema), "keyed").select("library_id", "dim", "asset_id", "vec", F.posexplode("keys").alias("table", "key"))
    met = equal_pairs(keyed, ["library_id", "dim", "table", "key"], "asset_id", carry=("vec",))
    close = met.withColumn("distance", l2(F.col("vec_a"), F.col("vec_b"))).where((F.col("distance") < limit) & (F.col("a") < F.col("b")))
    return close.select("library_id", "a", "b", "distance").distinct()


def pixels() -> Column:
    return F.col("pixel_width").cast("long") * F.col("pixel_height")
