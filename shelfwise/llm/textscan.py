"""Vectorised scanning of UTF-8 text inside Arrow batches.

All operators of this subpackage look at words or byte strings through these few helpers. They work on the
bytes that Arrow hands over, a few megabytes at a time, and never split a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z

#: Words end at white space: space and the controls from tab to carriage return.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, letters and bytes above ASCII.
ITEM_WORDS = np.ones(256, bool)
ITEM_WORDS[0x00:0x30] = False
ITEM_WORDS[0x3A:0x61] = False
ITEM_WORDS[0x41:0x5B] = True  # lower-cased before words are taken
ITEM_WORDS[0x7B:0x80] = False

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high and low bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with about ``limit`` bytes."""
    buf, offs = text_parts(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def prefix_sums(buf: np.ndarray, fold: bool = True) -> np.ndarray:
    """Running polynomial sums; two of them give the hash of any range of bytes."""
    table = _BYTE
    if not fold:
        table = mix(np.arange(1, 257, dtype=np.uint64))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * _power("up", _BASE, len(buf)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever those bytes stand."""
    raw = (sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, and for each row the index of its first word, then the count."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    at = offs[:-1]
    before[at[at < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    at = offs[1:]
    after[at[at > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of lower-cased words."""
    starts, ends, first = words(buf, offs, table)
    return range_hash(prefix_sums(buf), starts, ends), starts, ends, first


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive values, built from runs of powers of two."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, run, size = None, 0, hashes, 1
    while size <= length:
        if length & size:
            part = run[done : done + n]
            out = mix(part + _U(length)) if out is None else mix(out * _U(0x9FB21C651E98DF25) + part)
            done += size
        if size * 2 <= length:
            run = mix(run[: len(run) - size] * _U(0x9FB21C651E98DF25) + run[size:])
        size *= 2
    return out


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes; order counts."""
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = mix(out * _U(0x9FB21C651E98DF25) + x)
    return out


def doc_bucket(doc_id: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document; :func:`doc_bucket_sql` gives the same in SQL."""
    return (((doc_id ^ (doc_id >> 17)) % 1000003) % buckets).astype(np.int32)


def doc_bucket_sql(column: str, buckets: int) -> str:
    return f"cast(pmod(pmod({column} ^ shiftright({column}, 17), 1000003), {buckets}) as int)"


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of ``values`` as a list column."""
    offs = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def dealt(bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    """One row per bucket present, each column a list of that bucket's values.

    Millions of small values then travel through the shuffle as a few long arrays.
    """
    order = np.argsort(bucket, kind="stable")
    there, sizes = np.unique(bucket[order], return_counts=True)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(there, pa.int32())} | {k: lists(v[order], sizes, t) for k, (v, t) in columns.items()})


def dealt_together(parts: list[tuple[np.ndarray, dict[str, tuple[np.ndarray, pa.DataType]]]]) -> pa.RecordBatch:
    """Like :func:`dealt` for several sets of values at once: still one row per bucket."""
    there = np.unique(np.concatenate([bucket for bucket, _ in parts]))
    out: dict[str, pa.Array] = {"bucket": pa.array(there, pa.int32())}
    for bucket, columns in parts:
        order = np.argsort(bucket, kind="stable")
        sizes = np.diff(np.append(np.searchsorted(bucket[order], there), len(bucket)))
        out |= {k: lists(v[order], sizes, t) for k, (v, t) in columns.items()}
    return pa.RecordBatch.from_pydict(out)


def gathered(table: pa.Table | pa.RecordBatch, name: str, dtype: type) -> np.ndarray:
    """All values of a list column, in row order."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
