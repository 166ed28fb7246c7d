"""Token-ID files: documents as arrays of ids, each compressed by itself under a shared dictionary.

A file set is a folder with two Parquet tables. ``shards`` holds runs of consecutive documents in ascending
doc_id order, or another that is asked for: their compressed id arrays back to back, with the offset of each, the position of its first id in
the whole corpus, and the hash of the dictionary. ``dictionary`` holds the dictionary. A short document is read
by its offset alone, without unpacking its neighbours.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import textscan as ts
from shelfwise.session import drop, partitions, settle

END = 0
#: Documents whose ids train the dictionary, and ids taken of each; both bounds hold at any corpus size.
DICTIONARY_DOCS = 2_000
DICTIONARY_IDS = 4_096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Distinct pieces of so many bytes of text are tokenized at a time.
ENCODE_BYTES = 2 << 20
#: Pieces that a worker keeps, about 40 bytes each.
CACHE_PIECES = 1 << 19
SHARD_BYTES = 4 << 20
SHARD_DOCS = 8_192

SHARDS = "part int, part_start long, dictionary string, doc_ids array<long>, starts array<long>, counts array<int>, offsets array<int>, data binary"
REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long"

_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_SAFE[0x80:] = True
_SAFE[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # these lead bytes may start a space beyond ASCII


def _cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the pieces of some rows."""
    space = buf == 0x20
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:] = _SAFE[buf[:-1]]
    before[2:] &= ~((buf[1:-1] >= 0x80) & (buf[:-2] == 0xC2))
    for lead in (0xE1, 0xE2, 0xE3):
        before[3:] &= ~((buf[2:-1] >= 0x80) & (buf[:-3] == lead))
    after[:-1] = _SAFE[buf[1:]]
    after[(ends := offs[1:])[ends > 0] - 1] = False
    begin = space & before & after
    begin[offs[:-1][offs[:-1] < len(buf)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(buf))
    return starts, ends, ts.range_hash(ts.prefix_sums(buf, fold=False), starts, ends)


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs [at, at + size), one after another."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """Whole texts to ids; every distinct word is put through the tokenizer once a batch, and words that come
    again are kept for later batches of the same worker, up to CACHE_PIECES.

    Texts are cut before single spaces between characters that are certainly no white space. Byte-level
    tokenizers whose pre-tokenizer keeps a space with the word that follows never join ids across such a place.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        self.keys, self.at, self.size_of, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _known(self, key: np.ndarray, times: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct piece, back to back, and how many each has; ``key`` is sorted."""
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        miss = np.flatnonzero(~hit)
        made, made_size = self._pieces(buf, starts[miss], ends[miss])
        size = np.empty(len(key), np.int64)
        size[hit], size[miss] = self.size_of[place[hit]], made_size
        out = np.empty(int(size.sum()), np.uint32)
        at = np.cumsum(size) - size
        out[_spread(at[hit], size[hit])] = self.flat[_spread(self.at[place[hit]], size[hit])]
        out[_spread(at[miss], made_size)] = made
        again = miss[times[miss] > 1][: max(0, CACHE_PIECES - len(self.keys))]
        if len(again):
            keys = np.concatenate([self.keys, key[again]])
            order = np.argsort(keys)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size[again]) - size[again]])[order]
            self.size_of = np.concatenate([self.size_of, size[again]])[order]
            self.flat = np.concatenate([self.flat, out[_spread(at[again], size[again])]])
            self.keys = keys[order]
        return out, size

    def __call__(self, buf: np.ndarray, offs: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each row); every row ends with ``end``."""
        rows = len(offs) - 1
        if not len(buf):
            return np.full(rows, end, np.uint32), np.ones(rows, np.int64)
        found, lo = [], 0
        while lo < rows:  # hashes are taken of small runs of rows
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + ts.SLICE_BYTES, "right")) - 1)
            a, b = int(offs[lo]), int(offs[hi])
            if b > a:
                starts, ends, key = _cut(buf[a:b], offs[lo : hi + 1] - a)
                found.append((starts + a, ends + a, key))
            lo = hi
        starts, ends, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.append(True, sorted_key[1:] != sorted_key[:-1])
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        flat, size = self._known(sorted_key[new], np.diff(np.append(np.flatnonzero(new), len(key))), buf, starts[one], ends[one])
        # the end of each row is one more piece
        flat = np.append(flat, np.uint32(end))
        size = np.append(size, 1)
        at = np.cumsum(size) - size
        first = np.searchsorted(starts, offs[:-1])
        count = np.diff(np.append(first, len(starts)))
        count[np.diff(offs) == 0] = 0
        where = np.cumsum(count)
        piece = np.insert(which, where, len(size) - 1)
        lens = size[piece]
        total = np.cumsum(lens)
        ids = flat[np.repeat(at[piece] - (total - lens), lens) + np.arange(total[-1])]
        return ids, np.diff(np.append(0, total[where + np.arange(rows)]))

    def _pieces(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, back to back, and how many each has."""
        odd = np.append(0, np.cumsum(~_SAFE[buf]))
        simple = (buf[starts] == 0x20) & (odd[ends] - odd[starts] == 1)
        raw = buf.tobytes()
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(starts)
        size = np.zeros(len(starts), np.int64)
        plain = np.flatnonzero(simple)
        groups = [plain[i : i + 4096] for i in range(0, len(plain), 4096)]
        texts = [b"".join(raw[a:b] for a, b in zip(starts[g].tolist(), ends[g].tolist(), strict=True)).decode() for g in groups]
        parts = []
        for g, text in zip(groups, texts, strict=True):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(g):  # a space token that this does not foresee: take the pieces one by one
                simple[g] = False
                continue
            size[g] = np.diff(np.append(first, len(ids)))
            parts.append((g, ids))
        rest = np.flatnonzero(~simple)
        for i in range(0, len(rest), 1024):
            g = rest[i : i + 1024]
            for k, e in zip(g.tolist(), self.tokenizer.encode_batch_fast([raw[starts[k] : ends[k]].decode() for k in g], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, np.uint32)
                size[k] = len(out[k])
        at = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        for g, ids in parts:
            lens = size[g]
            flat[np.repeat(at[g] - (np.cumsum(lens) - lens), lens) + np.arange(len(ids))] = ids
        for k in rest.tolist():
            flat[at[k] : at[k] + size[k]] = out[k]
        return flat, size


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * count else "<u4").astype("<u4")


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A compression dictionary from the ids of a bounded sample; empty if there is too little text."""
    chosen = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(DICTIONARY_DOCS).select("doc_id")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, buf, offs in ts.slices(batch.column("text")):
                ids, count = encoder(tokenizer)(buf, offs)
                at = np.cumsum(count) - count
                out += [_packed(ids[a : a + min(n, DICTIONARY_IDS)]) for a, n in zip(at.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(out, pa.binary())})

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id", "left_semi").limit(DICTIONARY_DOCS).mapInArrow(sample, "ids binary").collect()
    samples = sorted(bytes(r.ids) for r in rows if len(r.ids) > 8)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, path: str, tokenizer: str, order: str = "doc_id") -> None:
    """Encode every document and write the file set under ``path``, in the order of the column ``order``.

    Null and empty texts have the end id alone. Each row is one document: repeated doc_ids stand side by side,
    rows without doc_id come first. Other columns are ignored.
    """
    spark = docs.sparkSession
    place = [] if order == "doc_id" else [F.col(order).alias("place")]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place)
    words = train_dictionary(source, tokenizer)
    named = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(named, bytearray(words))], "dictionary string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    kept = {k: t for k, t in source.dtypes if k != "text"}

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(words), write_checksum=False)
        for batch in batches:
            for lo, hi, buf, offs in ts.slices(batch.column("text"), ENCODE_BYTES):
                ids, count = encoder(tokenizer)(buf, offs)
                at = np.append(0, np.cumsum(count)).tolist()
                data = [pack.compress(_packed(ids[a:b])) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({k: batch.column(k)[lo:hi] for k in kept} | {"n": pa.array(count, pa.int32()), "data": pa.array(data, pa.binary())})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, n, data = zip(*held, strict=True)
            sizes = [len(x) for x in data]
            counts = np.array(n, np.int64)
            rows = np.array([len(held)])
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "part_start": pa.array([start], pa.int64()), "dictionary": [named], "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                    "starts": ts.lists(np.cumsum(counts) - counts, rows, pa.int64()), "counts": pa.array([n], pa.list_(pa.int32())),
                    "offsets": pa.array([np.append(0, np.cumsum(sizes)).tolist()], pa.list_(pa.int32())), "data": pa.array([b"".join(data)], pa.binary()),
                }
            )

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "data")), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= SHARD_BYTES or len(held) >= SHARD_DOCS:
                    yield flush()
                    start += sum(x[1] for x in held)
                    held, size = [], 0
        if held:
            yield flush()

    settled = settle(source.mapInArrow(frames, ", ".join(f"{k} {t}" for k, t in kept.items()) + ", n int, data binary"), "frames")
    key = "place" if place else "doc_id"
    settled.repartitionByRange(partitions(spark), key).sortWithinPartitions(*dict.fromkeys([key, "doc_id", "n", "data"])).mapInArrow(shards, SHARDS).write.parquet(f"{path}/shards")
    drop(settled)


def _part_starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each part; parts are as many as the writer's partitions."""
    totals = shards.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    out, at = {}, 0
    for row in sorted(totals):
        out[row.part] = at
        at += row.n
    return out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, unpacked from the files."""
    return _unpack(spark, spark.read.parquet(f"{path}/shards"), path, True)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, ids) of a few documents; only their own frames are unpacked."""
    shards = spark.read.parquet(f"{path}/shards").where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, doc_ids))))
    return _unpack(spark, shards, path, True, frozenset(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its unpacked ids."""
    return _unpack(spark, spark.read.parquet(f"{path}/shards"), path, False)


def _unpack(spark: SparkSession, shards: DataFrame, path: str, whole: bool, only: frozenset[int] | None = None) -> DataFrame:
    row = spark.read.parquet(f"{path}/dictionary").first()
    words, named = bytes(row.data), row.dictionary
    before = _part_starts(spark.read.parquet(f"{path}/shards"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(words))
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("dictionary")[r].as_py() != named:
                    raise ValueError("the shard was written with another dictionary")
                doc, starts, counts = (batch.column(k)[r].as_py() for k in ("doc_ids", "starts", "counts"))
                offsets, data = batch.column("offsets")[r].as_py(), batch.column("data")[r].as_py()
                base = before[batch.column("part")[r].as_py()] + batch.column("part_start")[r].as_py()
                at = [i for i, d in enumerate(doc) if only is None or d in only]
                ids = (_unpacked(open_.decompress(data[offsets[i] : offsets[i + 1]]), counts[i]) for i in at)
                out = {"doc_id": pa.array([doc[i] for i in at], pa.int64()), "start": pa.array([base + starts[i] for i in at], pa.int64())}
                if whole:
                    out["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))
                else:
                    found = [(len(x), zlib.crc32(x.tobytes())) for x in ids]
                    out |= {"n_tokens": pa.array([n for n, _ in found], pa.int64()), "ids_crc32": pa.array([c for _, c in found], pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    return shards.mapInArrow(unpack, "doc_id long, start long, ids array<long>" if whole else REPORT)
