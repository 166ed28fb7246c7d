"""Language-model scores of whole texts, beside a plain unigram score over words.

The model (see ``attention``) reads subword ids. Everything it is made of is gathered from all training
documents: id counts, class transitions, and training windows in which every id is a target once. Word counts of the
unigram score are exact over the corpus; no table of all words is ever in one place.

Texts are read once, in units of some megabytes: a unit holds its documents as compressed ids and a list of its
distinct words, which get their corpus counts and come back to the unit for scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import attention as net
from shelfwise.llm import textscan as ts
from shelfwise.llm.subwords import subwords
from shelfwise.llm.token_files import ENCODE_BYTES
from shelfwise.session import deals, drop, settle

ADD = 0.1
#: Training windows of a piece of a document, and of each trainer.
PIECE_WINDOWS = 128
TRAINER_WINDOWS = 65_536
#: Pieces are dealt in so many parts by hash. A round takes those up to a bound, its rate and its windows a step; trainers
#: start a round from the average of the one before.
DEALS = 8
ROUNDS = ((1, 0.004, 64), (4, 0.002, 256), (8, 0.002, 256))
#: Trainers whose weights are added up in one task.
BRANCH = 64
#: Text of a unit of documents.
UNIT_BYTES = 16 << 20
#: Hashed neighbours that describe an id.
GROUPS = 32
#: Cells of a grid of counts that are added up at a time.
PIECE = 16_384
#: Windows scored at a time.
BATCH = 128
#: Ids that are opened at a time: few enough for arrays that a process keeps, as fresh ones cost more than the work on them.
OPEN_IDS = 1 << 17
REPORT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_FRAMES = "unit long, doc_id long, held_out boolean, n int, frame binary, bucket int, h array<long>, c array<long>"

_U = np.uint64
_LN10 = float(np.log(10.0))


def decoded(path: str, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of documents of ids whose last id each is the end."""
    flat, at = subwords(path).bytes, subwords(path).offsets
    ends = np.cumsum(count) - 1
    own = np.ones(len(ids), bool)
    own[ends] = False
    lens = np.where(own, at[ids + 1] - at[ids], 0)
    total = np.cumsum(lens)
    index = np.repeat(at[ids] - (total - lens), lens) + np.arange(int(total[-1]) if len(total) else 0)
    return flat[index], np.append(0, total[ends])


def _frames(docs: DataFrame, path: str, end: int, fold: int, buckets: int) -> DataFrame:
    """Every document as a compressed array of ids, which give back the text; beside them, the distinct words of each
    unit of documents with their training counts, dealt by word (rows without ``frame``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        task, unit, size = TaskContext.get().partitionId() << 32, 0, 0
        hashes: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def words() -> pa.RecordBatch:
            h, c = _distinct(np.concatenate(hashes), np.concatenate(times))
            out = ts.dealt((ts.mix(h) % _U(buckets)).astype(np.int32), {"h": (h.view(np.int64), pa.int64()), "c": (c, pa.int64())})
            return _filled(out.append_column("unit", pa.array([task + unit] * out.num_rows, pa.int64())))

        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in ts.slices(batch.column("text"), ENCODE_BYTES):
                ids, count = subwords(path)(buf, offs, end)
                at = np.append(0, np.cumsum(count)).tolist()
                ids = ids.astype("<u4" if subwords(path).size > 1 << 16 else "<u2")
                data = [pack.compress(ids[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
                yield _filled(pa.RecordBatch.from_pydict({"unit": pa.array([task + unit] * (hi - lo), pa.int64()), "doc_id": batch.column("doc_id")[lo:hi], "held_out": batch.column("held_out")[lo:hi], "n": pa.array(count, pa.int32()), "frame": pa.array(data, pa.binary())}))
                for a, b, part, offs_ in ts.slices(batch.column("text").slice(lo, hi - lo)):
                    h, _, _, first = ts.word_hashes(part, offs_, ts.SPACE_WORDS)
                    h, c = _distinct(h, np.repeat(~held[lo + a : lo + b], np.diff(first)).astype(np.int64))
                    hashes.append(h)
                    times.append(c)
                size += int(offs[-1])
                if size >= UNIT_BYTES:
                    yield words()
                    unit, size, hashes, times = unit + 1, 0, [], []
        if hashes:
            yield words()

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == fold
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").where("doc_id is not null")
    return source.mapInArrow(scan, _FRAMES)


def _filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of the schema of frames; columns that it lacks are null."""
    kinds = {"unit": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n": pa.int32(), "frame": pa.binary(), "bucket": pa.int32(), "h": pa.list_(pa.int64()), "c": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([batch.column(k) if k in batch.schema.names else pa.nulls(batch.num_rows, t) for k, t in kinds.items()], list(kinds))


def _distinct(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``h`` and the sums of their ``c``."""
    order = np.argsort(h)
    h = h[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return h[new], np.add.reduceat(c[order], new) if len(new) else np.empty(0, np.int64)


def _opened(batch: pa.RecordBatch | pa.Table, wide: bool, limit: int = OPEN_IDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, counts) of runs of rows with about ``limit`` ids."""
    open_ = zstandard.ZstdDecompressor()
    n = batch.column("n").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("n").to_numpy()
    total = np.append(0, np.cumsum(n))
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        data = b"".join(open_.decompress(x) for x in batch.column("frame").slice(lo, hi - lo).to_pylist())
        yield lo, hi, np.frombuffer(data, "<u4" if wide else "<u2").astype(np.int64), n[lo:hi].astype(np.int64)
        lo = hi


def _cut(ids: np.ndarray, count: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first ids, ends, ids of context, hash of document and piece) of the pieces of documents, which hold PIECE_WINDOWS
    windows each. Every id is a target in one piece; the ids just before a piece go with it as context."""
    each = PIECE_WINDOWS * net.SCORED
    k = -(-count // each)
    row = np.repeat(np.arange(len(count)), k)
    j = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    base = (np.cumsum(count) - count)[row]
    lead = np.where(j > 0, net.CONTEXT + 1, 0)
    h = ts.mix(doc_id[row].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + j.astype(np.uint64))
    return base + j * each - lead, base + np.minimum((j + 1) * each, count[row]), lead, ts.mix(h)


def _windows(ids: np.ndarray, count: np.ndarray, lead: np.ndarray, begin: int) -> np.ndarray:
    """Training windows [n, WINDOW + 1] of pieces, whose first ``lead`` ids are context: each other id is the target of
    one place. -1 is padding: before a text's ``begin``, and beyond a piece's end."""
    n = -(-(count - lead) // net.SCORED)
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = (lead[row] + k * net.SCORED - net.CONTEXT - 1)[:, None] + np.arange(net.WINDOW + 1)[None, :]
    at = (np.cumsum(count) - count)[row][:, None] + place
    there = (place >= 0) & (place < count[row][:, None])
    return np.where(there, ids[np.clip(at, 0, max(len(ids) - 1, 0))], np.where(place == -1, begin, -1)).astype(np.int32)


def _summed(train: DataFrame, wide: bool, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> tuple[np.ndarray, int]:
    """(sums of a grid of ``size`` cells over all training documents, their number).

    ``add`` adds some documents' ids to the grid, given also the two ids before each and the place in the text; a task keeps one grid, and grids are added up piece by piece in
    two steps. The grid is bounded by the model's vocabulary, whatever the corpus.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, pack = np.zeros(size + 1, np.int64), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo, hi, ids, count in _opened(batch, wide):
                grid[-1] += hi - lo
                add(grid[:-1], ids, np.append(0, ids[:-1]), np.append([0, 0], ids[:-2])[: len(ids)], np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count))
        cuts = list(range(0, size + 1, PIECE))
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(cuts)), pa.int32()), "task": pa.array([TaskContext.get().partitionId() % 64] * len(cuts), pa.int32()), "data": pa.array([pack(grid[c : c + PIECE].tobytes()) for c in cuts], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        open_, out = zstandard.ZstdDecompressor(), np.int64(0)
        for x in table.column("data"):
            out = out + np.frombuffer(open_.decompress(x.as_py()), np.int64)
        return pa.table({"piece": table.column("piece").slice(0, 1), "data": pa.array([zstandard.ZstdCompressor(level=1).compress(out.tobytes())], pa.binary())})

    parts = train.mapInArrow(scan, "piece int, task int, data binary").groupBy("piece", "task").applyInArrow(total, "piece int, data binary")
    grid = np.zeros(size + 1, np.int64)
    for r in parts.groupBy("piece").applyInArrow(total, "piece int, data binary").toLocalIterator():
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.data)), np.int64)
        grid[r.piece * PIECE : r.piece * PIECE + len(data)] = data
    return grid[:-1], int(grid[-1])


def _id_counts() -> Callable:
    def add(grid: np.ndarray, ids: np.ndarray, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        np.add.at(grid, ids, 1)

    return add


def _neighbours(row: np.ndarray, begin: int) -> Callable:
    """Hashed neighbours to the left and right of the ids with rows of their own."""
    group = (ts.mix(np.arange(len(row), dtype=np.uint64)) % _U(GROUPS)).astype(np.int64)

    def add(grid: np.ndarray, ids: np.ndarray, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        before = np.where(place == 0, begin, one)
        top = row[ids] < net.TOP
        half = net.TOP * GROUPS
        np.add.at(grid, row[ids[top]].astype(np.int64) * GROUPS + group[before[top]], 1)
        top = (row[before] < net.TOP) & (place > 0)
        np.add.at(grid, half + row[before[top]].astype(np.int64) * GROUPS + group[ids[top]], 1)

    return add


def _followed(voc: net.Vocabulary) -> Callable:
    """Classes after each context, then ids with rows of their own after each group, then frequent ids after two."""
    moves, pairs = net.CONTEXTS * net.CLASSES, net.TOP * net.BEFORE

    def add(grid: np.ndarray, ids: np.ndarray, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        one, two = np.where(place == 0, voc.begin, one), np.where(place < 2, voc.begin, two)
        at = voc.context(one, two).astype(np.int64)
        np.add.at(grid, at * net.CLASSES + voc.cls[ids], 1)
        row, last = voc.row[ids].astype(np.int64), voc.row[one].astype(np.int64)
        own = row < net.TOP
        np.add.at(grid, moves + row[own] * net.BEFORE + voc.before[one[own]], 1)
        own = (row < net.NEXT) & (last < net.LAST)
        np.add.at(grid, moves + pairs + (row[own] * net.LAST + last[own]) * net.EARLIER + voc.cls[two[own]] % net.EARLIER, 1)

    return add


def _bytes_of(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].tobytes() for k in sorted(w))


def _weights_of(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _trained(train: DataFrame, voc: Broadcast, wide: bool) -> dict[str, np.ndarray]:
    """Weights: one pass over all training ids in rounds. Pieces of documents are dealt by hash to rounds and trainers,
    so that equal texts do not meet; the weights of a round's trainers are averaged, BRANCH at a time."""
    count = train.agg(F.sum(F.ceil(F.col("n") / net.SCORED))).first()[0] or 0
    if not count:
        return net.fresh()
    kind = "<u4" if wide else "<u2"

    def pieces(begun: int, bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Those of a round; the others are not packed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=1).compress
            for batch in batches:
                doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for lo, hi, ids, count in _opened(batch, wide):
                    first, end, lead, h = _cut(ids, count, doc[lo:hi])
                    deal = (h >> _U(61)).astype(np.int32) % DEALS
                    own = np.flatnonzero((deal >= begun) & (deal < bound))
                    flat = ids.astype(kind)
                    data = [pack(flat[a:b].tobytes()) for a, b in zip(first[own].tolist(), end[own].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"h": pa.array((h[own] >> _U(1)).astype(np.int64), pa.int64()), "n": pa.array((end - first)[own], pa.int32()), "lead": pa.array(lead[own], pa.int32()), "frame": pa.array(data, pa.binary())})

        return run

    def fitted(start: dict[str, np.ndarray], rate: float, batch: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("h", "ascending"), ("frame", "ascending")])
            lead = table.column("lead").to_numpy().astype(np.int64)
            grid = np.concatenate([_windows(ids, count, lead[lo:hi], voc.value.begin) for lo, hi, ids, count in _opened(table, wide)])
            w, _ = net.fit(start, voc.value, grid, rate, 1, batch)
            return pa.table({"trainer": table.column("trainer").slice(0, 1), "n": pa.array([len(grid)], pa.int64()), "w": pa.array([_bytes_of(w)], pa.binary())})

        return run

    def add(table: pa.Table) -> pa.Table:
        n = np.array(table.column("n").to_pylist())
        total = sum(k * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for k, w in zip(n.tolist(), table.column("w"), strict=True))
        return pa.table({"trainer": table.column("trainer").slice(0, 1), "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    schema = "trainer long, n long, w binary"
    most = -(-count // TRAINER_WINDOWS)
    out, begun = net.fresh(), 0
    for bound, rate, batch in ROUNDS:
        dealt = train.mapInArrow(pieces(begun, bound), "h long, n int, lead int, frame binary").withColumn("trainer", F.pmod("h", F.lit(most)))
        sums = dealt.repartition(most, "trainer").groupBy("trainer").applyInArrow(fitted(out, rate, batch), schema)
        trainers, begun = most, bound
        while trainers > 1:
            trainers = -(-trainers // BRANCH)
            sums = sums.withColumn("trainer", F.pmod("trainer", F.lit(trainers))).groupBy("trainer").applyInArrow(add, schema)
        if found := sums.first():  # a small corpus may have no piece in a round
            out = _weights_of(bytes(found.w), out)
    return out


def score_ids(w: dict[str, np.ndarray], voc: net.Vocabulary, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 probability of each document's ids, every id scored once, windows batched across documents; ``w`` is
    prepared."""
    begin, out, room = voc.begin, np.zeros(len(count)), net.Room()
    step = BATCH * net.SCORED
    total = np.append(0, np.cumsum(count))
    lo = 0
    while lo < len(count):  # whole documents, about a batch at a time
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + step, "right")) - 1)
        inputs, targets, there, scored, row = net.document_windows(ids[total[lo] : total[hi]], count[lo:hi], begin)
        for a in range(0, len(inputs), BATCH):
            e = slice(a, a + BATCH)
            p = net.log_probs(w, voc, inputs[e], targets[e], there[e], room)
            out[lo:hi] += np.bincount(row[e], np.where(scored[e], p, 0).sum(1), hi - lo)
        lo = hi
    return out / _LN10


def lm_scores(docs: DataFrame, tokenizer: str, fold: int = 0) -> DataFrame:
    """Both scores of every document, learned from those outside the fold.

    Null and empty texts are an end alone. ``doc_id`` names a document: rows without it are left out, repeated
    rows count as often as they come. Without any training document the unigram score of each token is 0.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    size = subwords(tokenizer).size
    wide, end = size > 1 << 16, size - 1
    every = settle(_frames(docs, tokenizer, end, fold, deals(docs)), "frames")
    frames = every.where("frame is not null").select("unit", "doc_id", "held_out", "n", "frame")
    train = frames.where("not held_out")
    counts, n_docs = _summed(train, wide, size, _id_counts())
    around, _ = _summed(train, wide, 2 * net.TOP * GROUPS, _neighbours(net.rows_of(counts)[1], end))
    voc = net.vocabulary(counts, net.cluster(counts, *around.reshape(2, net.TOP, GROUPS)), end)
    sizes = [net.CONTEXTS * net.CLASSES, net.TOP * net.BEFORE, net.NEXT * net.LAST * net.EARLIER]
    moves, pairs, triples = np.split(_summed(train, wide, sum(sizes), _followed(voc))[0], np.cumsum(sizes)[:2])
    net.set_after(voc, moves.reshape(net.CONTEXTS, net.CLASSES))
    net.set_pairs(voc, pairs.reshape(net.TOP, net.BEFORE))
    net.set_fine(voc, triples.reshape(net.NEXT, net.LAST * net.EARLIER))
    nothing = np.empty(0, np.float32)
    lean = spark.sparkContext.broadcast(replace(voc, pair=nothing, rest=nothing, fine=nothing))  # what training needs
    weights = net.prepared(_trained(train, lean, wide), voc)
    lean.destroy()
    shared = spark.sparkContext.broadcast((weights, replace(voc, after=nothing)))

    def words_of(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, _, _, at = ts.word_hashes(*decoded(tokenizer, ids, count), ts.SPACE_WORDS)
        return hashes, at

    def counted(table: pa.Table) -> pa.Table:
        """Corpus counts of the words of one word bucket, back to each unit."""
        h, c = ts.gathered(table, "h", np.int64), ts.gathered(table, "c", np.int64)
        order = np.argsort(h)
        new = np.append(True, h[order][1:] != h[order][:-1])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        total = np.bincount(which, c).astype(np.int64)
        sizes = [len(x) for x in table.column("h")]
        rows = len(sizes)
        return pa.table({"unit": table.column("unit"), "h": ts.lists(h, np.array(sizes), pa.int64()), "c": ts.lists(total[which], np.array(sizes), pa.int64()), "tokens": pa.array([int(total.sum())] + [0] * (rows - 1), pa.int64()), "distinct": pa.array([int((total > 0).sum())] + [0] * (rows - 1), pa.int64())})

    dealt = every.where("frame is null").select("unit", "bucket", "h", "c")
    known = settle(dealt.groupBy("bucket").applyInArrow(counted, "unit long, h array<long>, c array<long>, tokens long, distinct long"), "words")
    n_words, distinct = known.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_all, v_all = n_words + n_docs, distinct + (n_docs > 0)
    floor = float(np.log10(n_all + ADD * (v_all + 1)))

    def finish(_key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        h, c = ts.gathered(counts, "h", np.int64).view(np.uint64), ts.gathered(counts, "c", np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        log_end = float(np.log10(n_docs + ADD))
        base, known_, tokens, score = [], [], [], []
        for _, _, ids, count in _opened(table, wide):
            found, at = words_of(ids, count)
            times = c[np.searchsorted(h, found)] if len(h) else np.empty(0, np.int64)
            part = np.append(0, np.cumsum(np.log10(times + ADD)))
            seen = np.append(0, np.cumsum(times > 0))
            n = np.diff(at) + 1
            base.append(part[at[1:]] - part[at[:-1]] + log_end - n * floor)
            known_.append(seen[at[1:]] - seen[at[:-1]] + int(n_docs > 0))
            tokens.append(n)
            score.append(score_ids(*shared.value, ids, count))
        cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        rows = table.num_rows
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": cat(tokens, pa.int64()), "n_known": cat(known_, pa.int64()), "train_tokens": pa.array([n_all] * rows, pa.int64()), "base_score": cat(base, pa.float64()), "score": cat(score, pa.float64())})

    out = settle(frames.groupBy("unit").cogroup(known.select("unit", "h", "c").groupBy("unit")).applyInArrow(finish, REPORT), "scores")
    drop(every, known)
    return out
