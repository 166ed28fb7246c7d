"""Product codes of vectors from exact integer products.

Components become integers; a vector is cut into equal parts, and each part is coded by its nearest entry in that part's
codebook. Distances come from float64 matrix products of limbs: integers are broken into limbs so small that every
partial sum of a product stays below 2^53 and is exact, and the products are put together again in int64. The first
of the nearest entries is taken. Codebooks are refined by rounds of assigning and averaging, whose sums are added
up by Spark; only the codebooks themselves come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import fits, settle

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integers, and vectors, that are compared with all entries at once in a task.
STEP = 1 << 20
ROWS = 1 << 14
#: Integers of all codebooks that are fitted together; vectors of further lengths follow.
BOOK_VALUES = 1 << 22
#: Labels whose sums may be broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000


def reach(dim: int) -> int:
    """Components of vectors of ``dim`` components are kept within this, so that a squared distance fits into a long."""
    return 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)


def limb_bits(dim: int) -> int:
    """Bits of a limb, sign apart, so that sums of ``dim`` products of two limbs stay below 2^53."""
    return max(1, (52 - (dim - 1).bit_length()) // 2)


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as a sum of limb k times 2^(k * bits), each limb at most 2^(bits - 1) in size, as float64; none if all are 0."""
    out, rest = [], values
    half = 1 << (bits - 1)
    while rest.any():
        low = ((rest + half) & ((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        rest = (rest - low) >> bits
    return out


def exact_dots(x: np.ndarray, y: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, by products of their limbs."""
    bits = bits or limb_bits(x.shape[1])
    out = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << ((i + j) * bits)
    return out


def nearest(x: np.ndarray, book: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the first nearest entry of ``book`` for each row of ``x``."""
    far = exact_dots(x, book, bits)
    far *= -2
    far += (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(1)


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * component) of finite vectors of one length, kept within reach."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -reach(dim), reach(dim)).astype(np.int64).reshape(-1, dim)


def whole(batch: pa.RecordBatch, name: str, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integers) of the vectors without null or non-finite components that can be cut into ``parts``, by length, a few at a time."""
    column = batch.column(name)
    if not len(column):
        return
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    for dim in np.unique(sizes).tolist():
        if dim == 0 or dim % parts:
            continue
        at = np.flatnonzero(sizes == dim)
        step = min(ROWS, max(1, STEP // dim))
        for lo in range(0, len(at), step):
            rows = at[lo : lo + step]
            some = column.take(pa.array(rows))
            values = some.flatten()
            good = np.isfinite(values.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim).all(1)  # null components read as nan
            if not good.all():
                rows, some = rows[good], some.filter(pa.array(good))
            if len(rows):
                yield dim, rows, integers(some, dim)


def _sums(books: dict[int, np.ndarray], name: str, parts: int):
    """Per task: (dim, part, entry, place, total, n) of the vectors assigned to each entry."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {d: (np.zeros(b.shape, np.int64), np.zeros(b.shape[:2], np.int64)) for d, b in books.items()}
        for batch in batches:
            for dim, _, x in whole(batch, name, parts):
                if dim not in books:
                    continue
                total, count = totals[dim]
                for p, piece in enumerate(np.split(x, parts, axis=1)):
                    at, _ = nearest(np.ascontiguousarray(piece), books[dim][p])
                    np.add.at(total[p], at, piece)
                    count[p] += np.bincount(at, minlength=count.shape[1])
        for dim, (total, count) in totals.items():
            p, e = np.nonzero(count)
            if len(p):
                width = total.shape[2]
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": pa.array(np.full(len(p) * width, dim, np.int32)), "part": pa.array(np.repeat(p, width).astype(np.int32)), "entry": pa.array(np.repeat(e, width).astype(np.int32)),
                        "place": pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), "total": pa.array(total[p, e].ravel()), "n": pa.array(np.repeat(count[p, e], width)),
                    }
                )

    return scan


def _coded(books: dict[int, np.ndarray], digests: dict[int, str], name: str, parts: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in whole(batch, name, parts):
                if dim not in books:
                    continue
                found = [nearest(np.ascontiguousarray(piece), books[dim][p]) for p, piece in enumerate(np.split(x, parts, axis=1))]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                error = sum(e for _, e in found)
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": some.column("vec_id"), "label": some.column("label"), "code": pa.array([codes[k : k + 2 * parts] for k in range(0, len(codes), 2 * parts)], pa.string()),
                        "error": pa.array(error), "codebooks_sha256": pa.array([digests[dim]] * len(rows), pa.string()),
                    }
                )

    return scan


def _lengths(vectors: DataFrame, name: str, parts: int) -> list[list[int]]:
    """The lengths of vectors that can be cut, in groups whose codebooks are fitted together."""
    found = [r.n for r in vectors.select(F.size(name).alias("n")).where(f"n > 0 and n % {parts} = 0").distinct().orderBy("n").collect()]
    out: list[list[int]] = []
    for n in found:
        if not out or (sum(out[-1]) + n) * ENTRIES > BOOK_VALUES:
            out.append([])
        out[-1].append(n)
    return out


def first_books(vectors: DataFrame, lengths: list[int], name: str, parts: int, entries: int) -> dict[int, np.ndarray]:
    """Codebooks (part, entry, component) of each length from the vectors of its least ids; of vectors with one id the least counts."""
    good = vectors.where(F.col("vec_id").isNotNull() & F.size(name).isin(lengths) & F.expr(f"forall({name}, x -> x is not null and not isnan(x) and abs(x) <> double('inf'))")).withColumn("dim", F.size(name))
    ids = good.select("dim", "vec_id").distinct()
    ranked = ids.selectExpr("dim", "vec_id", "row_number() over (partition by dim order by vec_id) as k").where(f"k <= {entries}")
    rows = good.join(F.broadcast(ranked.drop("k")), ["dim", "vec_id"]).groupBy("dim", "vec_id").agg(F.min(name).alias("vec")).toArrow()
    books = {}
    dims = rows.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        some = rows.filter(pa.array(dims == dim)).sort_by("vec_id").column("vec").combine_chunks()
        x = integers(some.chunk(0) if isinstance(some, pa.ChunkedArray) else some, dim)
        books[dim] = np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2))
    return books


def refined(vectors: DataFrame, books: dict[int, np.ndarray], name: str, parts: int) -> dict[int, np.ndarray]:
    """Codebooks after a round: each entry becomes the floor of the mean of the parts assigned to it; unused ones stay."""
    rows = vectors.mapInArrow(_sums(books, name, parts), "dim int, part int, entry int, place int, total long, n long").groupBy("dim", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = rows.toArrow()
    dim, part, entry, place, total, n = (found.column(k).to_numpy() for k in ("dim", "part", "entry", "place", "total", "n"))
    out = {d: b.copy() for d, b in books.items()}
    for d, b in out.items():
        at = np.flatnonzero(dim == d)
        b[part[at], entry[at], place[at]] = total[at] // n[at]
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, name: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that has only finite components.

    Null vectors and those with null or non-finite components are dropped, and so are those whose length is no multiple
    of ``parts``, empty ones too. Vectors of each length have codebooks of their own. Components beyond :func:`reach`
    count as that. Rows that repeat an id are coded each; a row without an id is coded and starts no entry. With fewer than
    ``entries`` ids, codebooks have as many entries. ``label_error`` adds up over equal labels, nulls together; a sum
    beyond a long is null. At most 256 entries. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("label").alias("label"), name)
    coded = []
    for lengths in _lengths(rows, name, parts):
        books = first_books(rows, lengths, name, parts, entries)
        for _ in range(rounds):
            books = refined(rows, books, name, parts)
        if books:
            schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long, codebooks_sha256 string"
            coded.append(rows.mapInArrow(_coded(books, {d: digest(b) for d, b in books.items()}, name, parts), schema))
    if not coded:
        return rows.where(F.lit(False)).selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    every = coded[0]
    for x in coded[1:]:
        every = every.union(x)
    every = settle(every, "codes")
    sums = settle(every.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "sums")
    out = every.join(F.broadcast(sums) if fits(sums, BROADCAST_ROWS) else sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
