"""Exact substring dedup over suffix arrays built by two-stage sorting.

Every byte covered by a string of ``length`` bytes that also starts earlier in the corpus is removed. A whole
corpus has no one suffix array: the work is dealt out so that equal strings always meet in one task.

1. Each window of ``length`` bytes picks an anchor, the least hash among its short grams. Equal windows pick
   equal anchors, so a run of neighbouring windows with one anchor is dealt by that anchor's hash. Runs that
   agree in all their bytes are merged at once, in the map task and again where they meet: the earliest stays.
2. Where one anchor has runs with different bytes, the bytes themselves are fetched, cut into short pieces that
   are dealt by the bytes common to all their windows, and sorted: a suffix array by two-stage sorting, then
   the common prefixes of neighbours, tell which windows are equal.
3. The ranges found return to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textscan as ts
from shelfwise.session import deals, drop, settle

LENGTH = 100
GRAM = 24
#: Windows of one piece in step 2; the fewer, the more bytes its windows have in common.
PIECE = 8
#: Runs of windows that a map task merges at a time.
CHUNK = 1 << 20
#: Different runs of one anchor whose pieces are sorted together.
KINDS = 4_096

_U = np.uint64
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RUNS = "bucket int, h array<long>, same array<long>, doc array<long>, lo array<int>, n array<int>, off array<int>, gone array<boolean>"
_RANGES = "bucket int, doc array<long>, lo array<int>, n array<int>"
_NEEDS = ", need_doc array<long>, need_lo array<int>, need_n array<int>, need_off array<int>, need_h array<long>, need_parts array<int>"
_PIECES = "bucket int, key array<long>, doc array<long>, lo array<int>, n array<int>, dealt array<boolean>, data binary, gone_doc array<long>, gone_lo array<int>, gone_n array<int>"
_LEFT = _RANGES + ", left_doc array<long>, left_lo array<int>, one array<long>, two array<long>"


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of ``text`` (bytes, 0 ends each string), two-stage.

    Suffixes smaller than their successor are sorted directly, by up to ``depth`` bytes (no string may be
    longer); the rest follow from scanning the buckets of first bytes upwards: the suffix before a suffix just
    passed is next in the bucket of its own first byte.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    after = np.append(text[1:], 0)
    # smaller than the successor: by the first unequal byte of a run
    change = np.flatnonzero(text != after)
    run_end = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)] if len(change) else np.full(n, n - 1)
    direct = text < after[run_end]
    direct[text == 0] = True  # ends of strings: all equal, before everything else
    at = np.flatnonzero(direct & (text != 0))
    padded = np.append(text, np.zeros(depth, np.uint8))
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[at].copy()
    end = (rows == 0).argmax(1)
    has = (rows == 0).any(1)
    rows[(np.arange(depth)[None, :] > end[:, None]) & has[:, None]] = 0
    small = at[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")] if len(at) else at
    by_byte = np.split(small, np.searchsorted(text[small], np.arange(1, 257)))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    ends = np.flatnonzero(text == 0)
    out = []

    def passed(order: np.ndarray, c: int) -> None:
        before = order[order > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            values, starts = np.unique(first[by], return_index=True)
            for v, part in zip(values.tolist(), np.split(before[by], starts[1:]), strict=True):
                induced[v].append(part)

    out.append(ends)
    passed(ends, 0)
    for c in range(1, 256):
        larger = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        front = larger
        while len(front):  # runs of one byte
            front = front[front > 0] - 1
            front = front[text[front] == c]
            larger = np.concatenate([larger, front])
        order = np.concatenate([larger, by_byte[c]])
        out.append(order)
        passed(order, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each entry of ``order`` shares with the one before, up to ``limit``."""
    padded = np.append(text, np.zeros(limit + 1, np.uint8))
    view = np.lib.stride_tricks.sliding_window_view(padded, limit)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 14):
        b = min(len(order), a + (1 << 14))
        differ = view[order[a - 1 : b - 1]] != view[order[a:b]]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), limit)
    return out


def window_runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(h, same, row, lo, n, off): runs of windows with one anchor; lo counts from the row's start."""
    none = tuple(np.empty(0, np.int64) for _ in range(6))
    n_win = len(buf) - length + 1
    if n_win <= 0:
        return none
    sums = ts.prefix_sums(buf, fold=False)
    at = np.arange(len(buf) - gram + 1)
    h = ts.range_hash(sums, at, at + gram)
    best = (h & ~_U(0xFFFFFFFF)) | at.astype(np.uint64)  # leftmost of equal ones
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    anchor = (best & _U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n_win + 1, np.int64)
    a, b = offs[:-1], offs[1:] - length + 1
    keep = b > a
    np.add.at(valid, a[keep], 1)
    np.add.at(valid, b[keep], -1)
    p = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(p):
        return none
    x = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (x[1:] != x[:-1]) | (p[1:] != p[:-1] + 1)
    start = np.zeros(n_win, bool)
    start[a[keep]] = True
    new |= start[p]
    first = np.flatnonzero(new)
    lo, count, x = p[first], np.diff(np.append(first, len(p))), x[first]
    row = np.searchsorted(offs, lo, "right") - 1
    same = ts.range_hash(sums, lo, lo + count - 1 + length)
    return h[x].view(np.int64), same.view(np.int64), row, lo - offs[row], count, x - lo


def _earliest(keys: list[np.ndarray], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows by keys, then position; new marks the first row of each key and the rows tied with it."""
    order = np.lexsort((lo, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        differ = np.zeros(len(order) - 1, bool)
        for k in (*keys,):
            differ |= k[order][1:] != k[order][:-1]
        new[1:] = differ
    return order, new


def _tied(order: np.ndarray, new: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Rows of a key at the very place of its first one (a repeated row of the table) are not later."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc[order] == doc[order][first]) & (lo[order] == lo[order][first])


def _none(schema: str) -> pa.Table:
    """An empty table of a schema in SQL words."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.table({k: pa.array([], kinds[t]) for k, t in (x.split(" ") for x in schema.split(", "))})


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = KINDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts by document bucket, lists of ranges by document bucket, the settled table that these read)."""
    buckets = deals(docs, each=4 << 20)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, same, doc, lo, n, off = (np.concatenate(x) for x in zip(*held, strict=True))
            order, new = _earliest([h, same], doc, lo)
            gone = np.empty(len(order), bool)
            gone[order] = ~new & ~_tied(order, new, doc, lo)
            bucket = (ts.mix(h.view(np.uint64)) % _U(buckets)).astype(np.int32)
            i32 = pa.int32()
            return ts.dealt(bucket, {"h": (h, pa.int64()), "same": (same, pa.int64()), "doc": (doc, pa.int64()), "lo": (lo.astype(np.int32), i32), "n": (n.astype(np.int32), i32), "off": (off.astype(np.int32), i32), "gone": (gone, pa.bool_())})

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, buf, offs in ts.slices(batch.column("text")):
                h, same, row, lo, n, off = window_runs(buf, offs, length, gram)
                if len(h):
                    held.append((h, same, ids[a + row], lo, n, off))
                    size += len(h)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merged(table: pa.Table) -> pa.Table:
        h, same, doc = (ts.gathered(table, k, np.int64) for k in ("h", "same", "doc"))
        lo, n, off = (ts.gathered(table, k, np.int32) for k in ("lo", "n", "off"))
        known = ts.gathered(table, "gone", bool)
        live = np.flatnonzero(~known)
        order, new = _earliest([h[live], same[live]], doc[live], lo[live])
        tied = _tied(order, new, doc[live], lo[live])
        gone = np.concatenate([np.flatnonzero(known), live[order[~new & ~tied]]])
        kinds = live[order[new]]  # one of each kind of run, by anchor
        many = np.zeros(len(kinds), bool)
        if len(kinds) > 1:
            twin = h[kinds][1:] == h[kinds][:-1]
            many[1:] |= twin
            many[:-1] |= twin
        need = kinds[many]
        parts = -(-np.unique(h[need], return_counts=True)[1] // most)[np.unique(h[need], return_inverse=True)[1]]
        i32, i64 = pa.int32(), pa.int64()
        found = {"doc": (doc[gone], i64), "lo": (lo[gone], i32), "n": (n[gone], i32)}
        wanted = {"need_doc": (doc[need], i64), "need_lo": (lo[need], i32), "need_n": (n[need], i32), "need_off": (off[need], i32), "need_h": (h[need], i64), "need_parts": (parts.astype(np.int32), i32)}
        return pa.Table.from_batches([ts.dealt_together([(ts.doc_bucket(doc[gone], buckets), found), (ts.doc_bucket(doc[need], buckets), wanted)])])

    def cut(_key: tuple, texts: pa.Table, needs: pa.Table) -> pa.Table:
        """Pieces of the runs whose bytes are wanted; texts are gone through a few hundred KB at a time."""
        row_of = {d: i for i, d in enumerate(texts.column("doc_id").to_pylist())}
        doc, h = ts.gathered(needs, "need_doc", np.int64), ts.gathered(needs, "need_h", np.int64)
        lo, n, off, parts = (ts.gathered(needs, k, np.int32).astype(np.int64) for k in ("need_lo", "need_n", "need_off", "need_parts"))
        row = np.array([row_of.get(d, -1) for d in doc.tolist()], np.int64)
        order = np.argsort(row, kind="stable")
        row, doc, h, lo, n, off, parts = (x[order] for x in (row, doc, h, lo, n, off, parts))
        found: list[tuple[np.ndarray, ...]] = []
        raw: list[bytes] = []
        for first, end, buf, offs in ts.slices(texts.column("text").combine_chunks()):
            a, b = np.searchsorted(row, [first, end])
            if b == a:
                continue
            sums = ts.prefix_sums(buf, fold=False)
            base = offs[row[a:b] - first] + lo[a:b]
            # a piece holds the windows at which the anchor is PIECE * j to PIECE * j + PIECE - 1 bytes in
            o_max, o_min = off[a:b], off[a:b] - n[a:b] + 1
            reps = o_max // PIECE - o_min // PIECE + 1
            src = np.repeat(np.arange(b - a), reps)
            j = o_max[src] // PIECE - (np.arange(len(src)) - np.repeat(np.cumsum(reps) - reps, reps))
            o_hi, o_lo = np.minimum(o_max[src], PIECE * j + PIECE - 1), np.maximum(o_min[src], PIECE * j)
            core = base[src] + o_max[src] - PIECE * j
            key = ts.chain([h[a:b][src].view(np.uint64), j.astype(np.uint64), ts.range_hash(sums, core, core + length - PIECE + 1)])
            count, start = o_hi - o_lo + 1, base[src] + o_max[src] - o_hi
            found.append((key, ts.range_hash(sums, start, start + count - 1 + length), doc[a:b][src], lo[a:b][src] + o_max[src] - o_hi, count, parts[a:b][src]))
            text = buf.tobytes()
            raw += [text[x:y] for x, y in zip(start.tolist(), (start + count - 1 + length).tolist(), strict=True)]
        if not found:
            return _none(_PIECES)
        key, same, doc, lo, n, parts = (np.concatenate(x) for x in zip(*found, strict=True))
        order, new = _earliest([key, same], doc, lo)
        gone = order[~new & ~_tied(order, new, doc, lo)]
        keep = np.sort(order[new | _tied(order, new, doc, lo)])
        i32, i64 = pa.int32(), pa.int64()
        part = ts.mix(doc.astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)
        bucket = (ts.mix(key + part * _U(0x9E3779B97F4A7C15)) % _U(buckets)).astype(np.int32)
        pieces = {"key": (key[keep].view(np.int64), i64), "doc": (doc[keep], i64), "lo": (lo[keep].astype(np.int32), i32), "n": (n[keep].astype(np.int32), i32), "dealt": (parts[keep] > 1, pa.bool_())}
        merged_ = {"gone_doc": (doc[gone], i64), "gone_lo": (lo[gone].astype(np.int32), i32), "gone_n": (n[gone].astype(np.int32), i32)}
        batch = ts.dealt_together([(bucket[keep], pieces), (ts.doc_bucket(doc[gone], buckets), merged_)])
        order = keep[np.argsort(bucket[keep], kind="stable")]
        cuts = np.searchsorted(bucket[order], np.append(batch.column("bucket").to_numpy(), 1 << 30)).tolist()
        order = order.tolist()
        data = [b"".join(raw[k] for k in order[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        return pa.Table.from_batches([batch.append_column("data", pa.array(data, pa.binary()))]).select([c.split(" ")[0] for c in _PIECES.split(", ")])

    def settled(table: pa.Table) -> pa.Table:
        key, doc = ts.gathered(table, "key", np.int64), ts.gathered(table, "doc", np.int64)
        lo, n = ts.gathered(table, "lo", np.int32).astype(np.int64), ts.gathered(table, "n", np.int32).astype(np.int64)
        dealt = ts.gathered(table, "dealt", bool)
        raw = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        start = np.cumsum(n + length - 1) - (n + length - 1)
        # only pieces that meet another with their key, here or in another part
        order = np.argsort(key, kind="stable")
        twin = dealt.copy()
        if len(key) > 1:
            eq = key[order][1:] == key[order][:-1]
            twin[order[1:][eq]] = True
            twin[order[:-1][eq]] = True
        at = np.flatnonzero(twin)
        at = at[np.argsort(key[at], kind="stable")]
        found = [(np.empty((2, 0), np.int64), np.empty((2, 0), np.int64), np.empty((2, 0), np.int64))]
        step = 5_000  # pieces sorted at a time; a key's pieces stay together
        a = 0
        while a < len(at):
            b = min(len(at), a + step)
            while b < len(at) and key[at[b]] == key[at[b - 1]]:
                b += 1
            e = at[a:b]
            found.append(_later_windows(raw, start[e], n[e], doc[e], lo[e], length, dealt[e]))
            a = b
        later, left, named = (np.concatenate(x, axis=1) for x in zip(*found, strict=True))
        i32, i64 = pa.int32(), pa.int64()
        d = np.concatenate([ts.gathered(table, "gone_doc", np.int64), later[0]])
        p = np.concatenate([ts.gathered(table, "gone_lo", np.int32), later[1]]).astype(np.int32)
        k = np.concatenate([ts.gathered(table, "gone_n", np.int32), np.ones(later.shape[1], np.int32)]).astype(np.int32)
        ranges = {"doc": (d, i64), "lo": (p, i32), "n": (k, i32)}
        open_ = {"left_doc": (left[0], i64), "left_lo": (left[1].astype(np.int32), i32), "one": (named[0], i64), "two": (named[1], i64)}
        return pa.Table.from_batches([ts.dealt_together([(ts.doc_bucket(d, buckets), ranges), ((ts.mix(named[0].view(np.uint64)) % _U(buckets)).astype(np.int32), open_)])])

    def met(table: pa.Table) -> pa.Table:
        """The ranges, and of equal windows left in several parts of one key all but the earliest."""
        one, two, doc = (ts.gathered(table, k, np.int64) for k in ("one", "two", "left_doc"))
        lo = ts.gathered(table, "left_lo", np.int32)
        order, new = _earliest([one, two], doc, lo)
        gone = order[~new & ~_tied(order, new, doc, lo)]
        d = np.concatenate([ts.gathered(table, "doc", np.int64), doc[gone]])
        p, k = (np.concatenate([ts.gathered(table, c, np.int32), x]).astype(np.int32) for c, x in (("lo", lo[gone]), ("n", np.ones(len(gone), np.int32))))
        return pa.Table.from_batches([ts.dealt(ts.doc_bucket(d, buckets), {"doc": (d, pa.int64()), "lo": (p, pa.int32()), "n": (k, pa.int32())})])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    texts = source.withColumn("bucket", F.expr(ts.doc_bucket_sql("doc_id", buckets)))
    runs = source.mapInArrow(anchors, _RUNS)
    first = settle(runs.groupBy("bucket").applyInArrow(merged, _RANGES + _NEEDS), "ranges")
    needs = first.select("bucket", "need_doc", "need_lo", "need_n", "need_off", "need_h", "need_parts").where("size(need_doc) > 0")
    pieces = texts.groupBy("bucket").cogroup(needs.groupBy("bucket")).applyInArrow(cut, _PIECES)
    second = pieces.groupBy("bucket").applyInArrow(settled, _LEFT).groupBy("bucket").applyInArrow(met, _RANGES)
    return texts, first.select("bucket", "doc", "lo", "n").where("size(doc) > 0").unionByName(second), first


def _later_windows(raw: np.ndarray, start: np.ndarray, n: np.ndarray, doc: np.ndarray, lo: np.ndarray, length: int, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, window start) of the windows of these pieces that equal an earlier one, and of the first ones among pieces
    that are ``dealt`` in parts, with two hashes of each."""
    size = n + length - 1
    at = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(at, size) + inner] = raw[np.repeat(start, size) + inner] + 1  # UTF-8 has no byte 0xFF
    owner = np.repeat(np.arange(len(n)), size + 1)
    order = suffix_array(text, int(size.max()) + 1)
    place = order - at[owner[order]]
    order = order[place < n[owner[order]]]  # starts of whole windows
    equal = common_prefixes(text, order, length) >= length
    group = np.cumsum(~equal)
    own = owner[order]
    d, p = doc[own], lo[own] + order - at[own]
    by, new = _earliest([group], d, p)
    tied = _tied(by, new, d, p)
    later, left = by[~new & ~tied], by[new | tied]
    left = left[dealt[own[left]]]
    named = np.empty((2, 0), np.int64)
    if len(left):
        sums, at = ts.prefix_sums(text, fold=False), order[left]
        half = length // 2
        named = np.array([ts.range_hash(sums, at, at + length), ts.range_hash(sums, at, at + half) ^ ts.mix(ts.range_hash(sums, at + half, at + length))]).view(np.int64)
    return np.array([d[later], p[later]]), np.array([d[left], p[left]]), named


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, most: int = KINDS) -> DataFrame:
    """Bytes removed from each document, and a digest of the rest (``keep_text``: the rest itself, as bytes).

    Documents count as UTF-8 bytes, matches never cross them, strings are judged on the input, and the order is
    that of (doc_id, start). ``doc_id`` names a document: rows without it are left out, rows that repeat it are
    one place in the order (neither is earlier than the other). Null and empty texts come back empty. Other
    columns are ignored.
    """
    texts, ranges, read = removed_ranges(docs, length, gram, most)

    def apply(_key: tuple, here: pa.Table, found: pa.Table) -> pa.Table:
        doc, lo, n = ts.gathered(found, "doc", np.int64), ts.gathered(found, "lo", np.int32).astype(np.int64), ts.gathered(found, "n", np.int32).astype(np.int64)
        order = np.lexsort((lo, doc))
        doc, lo, hi = doc[order], lo[order], (lo + n - 1 + length)[order]
        rows = []
        for d, text in zip(here.column("doc_id").to_pylist(), here.column("text").to_pylist(), strict=True):
            raw = text.encode()
            a, b = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
            kept, removed, spans, at = [], 0, 0, 0
            if b > a:
                s, e = lo[a:b], np.minimum(np.maximum.accumulate(hi[a:b]), len(raw))
                new = np.ones(b - a, bool)
                new[1:] = s[1:] > e[:-1]
                first = np.flatnonzero(new)
                starts, ends = s[first], e[np.append(first[1:] - 1, b - a - 1)]
                for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.append(raw[at:x])
                    removed, spans, at = removed + y - x, spans + 1, y
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((d, len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        out = {"doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "n_spans": pa.array(cols[3], pa.int64()), "kept_sha256": pa.array(cols[4], pa.string())}
        return pa.table(out | ({"kept": pa.array(cols[5], pa.binary())} if keep_text else {}))

    out = texts.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(apply, REPORT + (", kept binary" if keep_text else ""))
    if keep_text:
        return out
    out = settle(out, "report")
    drop(read)
    return out
