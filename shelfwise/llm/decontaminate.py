"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scanned over training windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textscan as ts
from shelfwise.session import settle

WINDOW = 13
#: A benchmark of at most so many bytes of text is broadcast at once; a larger one goes in slices of this size.
BROADCAST_BYTES = 32 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BITS = 22
#: Columns beside those of the documents while the hits of slices are joined.
ROW = "__row"
HITS = "__hits"

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class TestWindows:
    """Windows of a benchmark (slice), by length, sorted by hash."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.items = [str(i) for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        buf, offs = ts.text_parts(column)
        hashes, starts, ends, first = ts.word_hashes(buf, offs, ts.ITEM_WORDS)
        low = _FOLD[buf].tobytes()
        self.words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = np.diff(first)
        item = np.repeat(np.arange(len(n)), n)
        self.by_length = {}
        for length in sorted({min(int(x), window) for x in n if x}):
            at = np.flatnonzero(n >= window) if length == window else np.flatnonzero(n == length)
            own = np.isin(item, at)
            pos = np.flatnonzero(own)
            pos = pos[pos + length <= first[item[pos] + 1]]
            h = ts.window_hashes(hashes, length)[pos]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.by_length[length] = (h[order], pos[order], item[pos[order]], bits)

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, starts, ends, hit, pairs): word layout, hit words, and verified (row, item) pairs."""
        hashes, starts, ends, first = ts.word_hashes(buf, offs, ts.ITEM_WORDS)
        delta = np.zeros(len(hashes) + 1, np.int64)
        rows, items = [], []
        low = None
        for length, (known, pos, item, bits) in self.by_length.items():
            h = ts.window_hashes(hashes, length)
            at = np.flatnonzero(bits[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            keep = hi > lo
            at, lo, hi = at[keep], lo[keep], hi[keep]
            row = np.searchsorted(first, at, "right") - 1
            keep = at + length <= first[row + 1]
            for p, a, b, r in zip(at[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), row[keep].tolist(), strict=True):
                if low is None:
                    low = _FOLD[buf].tobytes()
                here = [low[starts[q] : ends[q]] for q in range(p, p + length)]
                found = {int(item[k]) for k in range(a, b) if self.words[pos[k] : pos[k] + length] == here}
                if found:
                    delta[p] += 1
                    delta[p + length] -= 1
                    rows += [r] * len(found)
                    items += found
        hit = np.cumsum(delta[:-1]) > 0
        return first, starts, ends, hit, np.array([rows, items], np.int64)


def _slices(benchmark: DataFrame, limit: int) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """The benchmark's items in pieces small enough to broadcast, read one at a time, and how many pieces there are."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = -(-size // limit) or 1

    def read() -> Iterator[list[tuple[object, str]]]:
        for k in range(pieces):
            part = items if pieces == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(pieces)) == k)
            yield [(r.item_id, r.text) for r in part.distinct().toLocalIterator()]

    return pieces, read()


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number that stays, as it is written out."""
    return settle(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _joined(keyed: DataFrame, slices: Iterator[list[tuple[object, str]]], window: int, one_in: int) -> DataFrame:
    """(row, n_words, hits, items, contaminated) of every row: hit words and items of all slices together, judged once.

    Slices are broadcast one after the other, each one's hits are written before the next is read.
    """
    spark = keyed.sparkSession
    merged = None
    for items in slices:
        shared = spark.sparkContext.broadcast(TestWindows(items, window))
        every = merged is None

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, every=every) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                ids = batch.column(ROW).to_numpy(zero_copy_only=False)
                for lo, hi, buf, offs in ts.slices(batch.column("text")):
                    first, _, _, hit, (rows, found) = tests.scan(buf, offs)
                    names: list[set[str]] = [set() for _ in range(hi - lo)]
                    for r, i in set(zip(rows.tolist(), found.tolist(), strict=True)):
                        names[r].add(tests.items[i])
                    take = [r for r in range(hi - lo) if every or names[r]]
                    where = [np.flatnonzero(hit[first[r] : first[r + 1]]).tolist() if names[r] else [] for r in take]
                    yield pa.RecordBatch.from_pydict(
                        {
                            ROW: pa.array(ids[lo:hi][take], pa.int64()), "n_words": pa.array(np.diff(first)[take], pa.int64()),
                            "hits": pa.array(where, pa.list_(pa.int32())), "items": pa.array([sorted(names[r]) for r in take], pa.list_(pa.string())),
                        }
                    )

        piece = settle(keyed.select(ROW, "text").mapInArrow(scan, f"{ROW} long, n_words long, hits array<int>, items array<string>"), "hits")
        shared.destroy()
        merged = piece if merged is None else merged.unionByName(piece)
    merged = merged.groupBy(ROW, "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("contaminated", (F.size("hits") > 0) & (F.size("hits").cast("long") * one_in >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hit words and found items of every document.

    A document without words has no hits. Null text has no words; benchmark rows without id or words are left
    out, repeated ones count once. Each row of ``docs`` gives one row, repeated rows repeat, whatever the size of
    the benchmark. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces, slices = _slices(benchmark, limit)
    if pieces > 1:
        keyed = _keyed(source)
        found = _joined(keyed, slices, window, one_in)
        return keyed.select("doc_id", ROW).join(found, ROW).select(
            "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        )
    shared = docs.sparkSession.sparkContext.broadcast(TestWindows(next(slices), window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, offs in ts.slices(batch.column("text")):
                first, _, _, hit, (rows, found) = tests.scan(buf, offs)
                n = np.diff(first)
                n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), np.minimum(first[:-1], len(hit))) if hi > lo else n
                n_hit = np.where(n > 0, n_hit, 0)
                names: list[list[str]] = [[] for _ in range(hi - lo)]
                for r, i in set(zip(rows.tolist(), found.tolist(), strict=True)):
                    names[r].append(tests.items[i])
                names = [sorted(set(x)) for x in names]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids[lo:hi], "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in names], pa.int64()),
                        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], "contaminated": pa.array((n_hit > 0) & (one_in * n_hit >= n)),
                    }
                )

    return source.mapInArrow(scan, REPORT)


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, words: Iterable[int]) -> str:
    """The text from byte ``lo`` to ``hi`` without these words."""
    gone = np.zeros(hi - lo, bool)
    for w in words:
        gone[starts[w] - lo : ends[w] - lo] = True
    return buf[lo:hi][~gone].tobytes().decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, one_in: int = 20, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of such documents.

    All columns stay as they are. A document that is not contaminated keeps its text to the last byte. Documents are
    judged by the hits of the whole benchmark, whatever its size.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    pieces, slices = _slices(benchmark, limit)
    if pieces > 1:
        keyed = _keyed(docs)
        bad = _joined(keyed, slices, window, one_in).where("contaminated").select(ROW, F.col("hits").alias(HITS))
        if remove == "documents":
            return keyed.join(bad, ROW, "left_anti").select(docs.columns)
        return keyed.join(bad, ROW, "left").select(*docs.columns, HITS).mapInArrow(_cut_given, docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(TestWindows(next(slices), window))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi, buf, offs in ts.slices(batch.column("text")):
                first, starts, ends, hit, _ = tests.scan(buf, offs)
                part = batch.slice(lo, hi - lo)
                bad = [r for r in range(hi - lo) if (k := int(hit[first[r] : first[r + 1]].sum())) and one_in * k >= first[r + 1] - first[r]]
                if bad and remove == "documents":
                    part = part.filter(pa.array(~np.isin(np.arange(hi - lo), bad)))
                elif bad:
                    texts = part.column("text").to_pylist()
                    for r in bad:
                        texts[r] = _cut(buf, starts, ends, offs[r], offs[r + 1], (first[r] + np.flatnonzero(hit[first[r] : first[r + 1]])).tolist())
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                if part.num_rows:
                    yield part

    return docs.mapInArrow(cut, docs.schema)


def _cut_given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts out the words that the column of hits names."""
    for batch in batches:
        at, hits = batch.schema.get_field_index("text"), batch.column(HITS)
        for lo, hi, buf, offs in ts.slices(batch.column("text")):
            _, starts, ends, first = ts.word_hashes(buf, offs, ts.ITEM_WORDS)
            part = batch.slice(lo, hi - lo)
            texts = part.column("text").to_pylist()
            for r, words in enumerate(hits[lo:hi].to_pylist()):
                if words:
                    texts[r] = _cut(buf, starts, ends, offs[r], offs[r + 1], [first[r] + w for w in words])
            part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
            yield part.select([n for n in part.schema.names if n != HITS])
