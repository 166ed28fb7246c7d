"""Runs of repeated words: maximal stretches with a period, found by uniting suffix classes.

Suffixes of a document that have a longest common prefix (LCP) of a length or more are a class. Neighbours in suffix order
are united by descending LCP, with a union-find whose classes are ordered sets of positions. Where two positions become
neighbours in a class, at distance q and LCP l >= q, the words from the first to l after the second have period q; where
the word before breaks the period, that stretch is a run, and every run is found so, with its smallest period.

Only LCPs that a run can have are united, so documents without a repeated window of so many words are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textscan as ts

#: Least words of a run.
LENGTH = 12
SLICE_BYTES = 1 << 21
REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def word_codes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, start, end) of each word, equal words having equal codes, and for each row its first word, then the count."""
    starts, ends, first = ts.words(buf, offs, ts.SPACE_WORDS)
    sizes = ends - starts
    joined = buf[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(joined)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, ends, first


def edited_index(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word at each place of the edited document; None where it is not edited."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def repeated(codes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Which rows may hold the same ``length`` words twice."""
    n, rows = len(codes) - length + 1, len(first) - 1
    out = np.zeros(rows, bool)
    if n <= 0:
        return out
    row = np.repeat(np.arange(rows), np.diff(first))
    inside = np.flatnonzero(row[:n] == row[length - 1 :])
    keys = ts.mix(ts.window_hashes(ts.mix(codes.astype(np.uint64)), length)[inside] ^ ts.mix(row[inside].astype(np.uint64)))
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    out[row[inside[order[1:][twice]]]] = True
    return out


class Suffixes:
    """Suffix order of rows of words by prefix doubling; ranks of prefixes are kept for the longest common ones."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        n = len(codes)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        end = first[1:][row]
        order = np.lexsort((codes, row))
        new = np.append(True, (codes[order][1:] != codes[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(order)]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, k = [(1, rank.astype(np.int32))], 1
        open_ = order[~(new & np.append(new[1:], True))]  # positions whose prefix is not theirs alone
        while len(open_):
            after = open_ + k
            beyond = np.where(after < end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.lexsort((beyond, rank[open_]))
            open_, beyond = open_[by], beyond[by]
            was = rank[open_]
            group = np.append(True, was[1:] != was[:-1])
            new = group | np.append(True, beyond[1:] != beyond[:-1])
            at = np.arange(len(open_))
            rank = rank.copy()
            rank[open_] = was + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            k *= 2
            self.levels.append((k, rank.astype(np.int32)))
            open_ = open_[~(new & np.append(new[1:], True))]
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.end = end

    def lcps(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, LCP) of neighbours in suffix order with at least ``least`` words in common."""
        a, b = self.order[:-1], self.order[1:]
        low = 1 << (least.bit_length() - 1)
        ranks = next((r for k, r in self.levels if k == low), None)
        if ranks is None:
            return a[:0], b[:0], a[:0]
        keep = ranks[a] == ranks[b]
        a, b = a[keep], b[keep]
        length = np.zeros(len(a), np.int64)
        for k, rank in self.levels[::-1]:
            x, y = a + length, b + length
            inside = (x < self.end[a]) & (y < self.end[b])
            same = inside & (rank[np.minimum(x, len(rank) - 1)] == rank[np.minimum(y, len(rank) - 1)])
            length[same] += k
        keep = length >= least
        return a[keep], b[keep], length[keep]


def unite(big: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Put the ordered positions ``small`` into ``big``; neighbours that come from different sides are given out."""
    if len(small) == 1:
        x = small[0]
        k = bisect_left(big, x)
        if k:
            yield big[k - 1], x
        if k < len(big):
            yield x, big[k]
        big.insert(k, x)
        return
    gap = -1
    for i, x in enumerate(small):
        k = bisect_left(big, x)
        if k != gap:
            if i and gap < len(big):
                yield small[i - 1], big[gap]
            if k:
                yield big[k - 1], x
            gap = k
    if gap < len(big):
        yield small[-1], big[gap]
    big += small
    big.sort()


def seeds(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """(first, second, LCP) of positions that become neighbours in a class at a distance within their LCP."""
    order = np.argsort(-lcp, kind="stable")
    nodes, where = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    members: list[list[int] | None] = [[x] for x in nodes.tolist()]
    parent = list(range(len(nodes)))
    out: list[tuple[int, int, int]] = []
    for x, y, shared in zip(where[: len(a)].tolist(), where[len(a) :].tolist(), lcp[order].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if len(members[x]) < len(members[y]):
            x, y = y, x
        parent[y] = x
        for i, j in unite(members[x], members[y]):
            if j - i <= shared:
                out.append((i, j, shared))
        members[y] = None
    return np.array(out, np.int64).reshape(-1, 3)


def runs(codes: np.ndarray, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of at least ``length`` words, by row, start, period; starts are within the row."""
    least = -(-length // 2)  # of a run of at least two periods, all but a period is common to two suffixes
    hit = np.flatnonzero(repeated(codes, first, least))
    found = [np.empty((4, 0), np.int64)]
    sizes = np.diff(first)
    lo = 0
    while lo < len(hit):  # a few rows at a time, long ones alone
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[hit[lo:]]), 1 << 16, "right")))
        rows = hit[lo:hi]
        at = np.concatenate([[0], np.cumsum(sizes[rows])])
        some = np.concatenate([codes[first[r] : first[r + 1]] for r in rows])
        i, j, shared = seeds(*Suffixes(some, at).lcps(least)).T
        row = np.searchsorted(at, i, "right") - 1
        starts = (i == at[row]) | (some[i - 1] != some[j - 1])
        keep = starts & (j - i + shared >= length)
        i, j, shared, row = i[keep], j[keep], shared[keep], row[keep]
        found.append(np.array([rows[row], i - at[row], j - i + shared, j - i]))
        lo = hi
    out = np.concatenate(found, axis=1)
    return tuple(out[:, np.lexsort((out[3], out[1], out[0]))])


def collapsed(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when of each run its first period stays, unless another run drops it."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    return np.cumsum(marks[:-1]) == 0


def _report(ids: list[int | None], buf: np.ndarray, offs: np.ndarray, length: int, edit: bool) -> list[tuple]:
    codes, starts, ends, first = word_codes(buf, offs)
    place = np.arange(len(codes))
    for k, d in enumerate(ids if edit else []):
        at = edited_index(d, int(first[k + 1] - first[k]))
        if at is not None:
            place[first[k] : first[k + 1]] = first[k] + at
    codes, starts, ends = codes[place], starts[place], ends[place]
    row, start, size, period = runs(codes, first, length)
    cut = np.searchsorted(row, np.arange(len(ids) + 1))
    out = []
    data = buf.tobytes()
    s, e = starts.tolist(), ends.tolist()
    for k, d in enumerate(ids):
        lo, hi, a, b = int(first[k]), int(first[k + 1]), int(cut[k]), int(cut[k + 1])
        kept = range(lo, hi)
        if b > a:
            kept = (lo + np.flatnonzero(collapsed(hi - lo, start[a:b], size[a:b], period[a:b]))).tolist()
        text = b" ".join([data[s[w] : e[w]] for w in kept])
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(start[a:b].tolist(), size[a:b].tolist(), period[a:b].tolist(), strict=True))
        most: tuple = (None, None, None, None)
        if b > a:
            best = a + int(np.lexsort((period[a:b], start[a:b], -size[a:b]))[0])
            x, y, z = int(start[best]), int(size[best]), int(period[best])
            most = (x, y, z, 1000 * y // z)
        out.append((d, b - a, *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), hi - lo, hi - lo - len(kept)))
    return out


def find_runs(docs: DataFrame, length: int = LENGTH, edit: bool = False) -> DataFrame:
    """The runs of every document: their number, the longest (ties: first, then shorter period), digests of all runs and
    of the words that stay when runs are collapsed, and how many words there are and are dropped.

    Words end at white space. Null and empty texts have no words and no runs, each row gives one row, repeated rows
    repeat, other columns are ignored. ``edit`` makes a tenth of the documents, by their ids, end in a repetition
    first; a row without an id is left as it is. Texts are read whole; no shuffle.
    """
    fields = [f.split(" ")[0] for f in REPORT.split(", ")]
    kinds = [pa.string() if f.endswith("sha256") else pa.int64() for f in fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in ts.slices(batch.column("text"), SLICE_BYTES):
                rows = _report(batch.column("doc_id")[lo:hi].to_pylist(), buf, offs, length, edit)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, REPORT)


def collapse_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` whose texts keep of each run its first period only, words joined by a space; texts without runs, and all
    other columns, stay as they are."""

    def cut(column: pa.Array) -> list[str | None]:
        out: list[str | None] = column.to_pylist()
        for lo, hi, buf, offs in ts.slices(column, SLICE_BYTES):
            codes, starts, ends, first = word_codes(buf, offs)
            row, start, size, period = runs(codes, first, length)
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            data = buf.tobytes()
            for k in np.unique(row).tolist():
                a, b = int(at[k]), int(at[k + 1])
                kept = first[k] + np.flatnonzero(collapsed(int(first[k + 1] - first[k]), start[a:b], size[a:b], period[a:b]))
                out[lo + k] = b" ".join([data[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]).decode()
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(cut(batch.column(at)), batch.schema.field(at).type))

    return docs.mapInArrow(scan, docs.schema)
