"""Quality classifier: nearest neighbours vote among labelled latent-semantic vectors.

A document is a weighted bag of hashed words, word shapes and a few counts; a truncated decomposition of
labelled documents gives the latent space. All labelled vectors of the bounded sample are broadcast, every
document's cosine with each is computed in blocks, and the nearest vote with weights of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textscan as ts

#: Labelled documents a class that vote, chosen by hash over all labelled rows. Holds at any size of the tables.
REFERENCES = 2_000
WORDS, SHAPES, COUNTS = 1_024, 512, 64
WIDTH = WORDS + SHAPES + COUNTS
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 6
CUT = 0.7
#: The most rows of a block of documents against all references.
BLOCK = 512
REPORT = "doc_id long, held_out boolean, score double, predicted int"

_U = np.uint64
#: Kinds of bytes in a word's shape: control, lower, upper, digit, stop, other mark, beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KIND[_c] = 4 if chr(_c) in ".,;:?'\"-()" else 5 + _c % 16
_KIND[128:] = 1
_KIND[0xC3] = 1


def bags(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[rows, WIDTH] damped counts: words, shapes, and how the text is built."""
    rows = len(offs) - 1
    hashes, starts, ends, first = ts.word_hashes(buf, offs, ts.SPACE_WORDS)
    n = np.diff(first)
    out = np.zeros((rows, WIDTH), np.float32)
    if len(hashes):
        row = np.repeat(np.arange(rows), n)
        word = (hashes % _U(WORDS)).astype(np.int64)
        out[:, :WORDS] = np.bincount(row * WORDS + word, minlength=rows * WORDS).reshape(rows, WORDS)
        kind = _KIND[buf]
        new = np.append(True, kind[1:] != kind[:-1])
        new[starts] = True
        runs = np.flatnonzero(new)
        a, b = np.searchsorted(runs, starts), np.searchsorted(runs, ends)
        first_run = ts.mix(kind[starts].astype(np.uint64) + _U(9))
        last = ts.mix(kind[ends - 1].astype(np.uint64) + _U(31))
        shape = ts.mix(first_run + last * _U(3) + np.minimum(b - a, 6).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        out[:, WORDS : WORDS + SHAPES] = np.bincount(row * SHAPES + (shape % _U(SHAPES)).astype(np.int64), minlength=rows * SHAPES).reshape(rows, SHAPES)
        # repetition, length, marks and lines
        at = WORDS + SHAPES
        some = np.flatnonzero(n)
        order = np.lexsort((hashes, row))
        fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1]))
        distinct = np.bincount(row[order][fresh], minlength=rows)
        size = np.diff(offs)
        shares = [
            (distinct / np.maximum(n, 1)) ** 0.5, np.minimum(np.bincount(row, ends - starts, rows) / np.maximum(n, 1) / 16, 1),
            *(_share(kind == k, offs, size) for k in (2, 3, 4)), _share(kind >= 5, offs, size), _share(buf == 10, offs, size),
        ]
        for j, x in enumerate(shares):
            step = np.minimum((np.sqrt(np.clip(x, 0, 1)) * 8).astype(np.int64), 7)
            out[some, at + 8 * j + step[some]] = np.maximum(n[some] / 8, 1)
    np.log1p(out, out=out)
    return out


def _share(flag: np.ndarray, offs: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flag))
    return (total[offs[1:]] - total[offs[:-1]]) / np.maximum(size, 1)


@dataclass
class Voters:
    scale: np.ndarray  # weight of each term
    base: np.ndarray  # terms to latent space
    vectors: np.ndarray
    labels: np.ndarray
    weight: np.ndarray  # of a vote, so that classes count as they occur
    prior: float

    def latent(self, bag: np.ndarray) -> np.ndarray:
        x = (bag * self.scale) @ self.base
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, bag: np.ndarray) -> np.ndarray:
        """Share of label 1 among the weighted votes; texts without terms get the prior."""
        out = np.full(len(bag), self.prior)
        for a in range(0, len(bag), BLOCK):
            part = bag[a : a + BLOCK]
            some = np.flatnonzero(part.any(1))
            if not len(some):
                continue
            cosine = np.round(self.latent(part[some]) @ self.vectors.T, 5)  # so that ties do not hang on the order of sums
            k = min(NEIGHBOURS, cosine.shape[1])
            near = nearest(cosine, k)
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** SHARPNESS * self.weight[near]
            out[a + some] = np.clip((vote * self.labels[near]).sum(1) / vote.sum(1), 0, 1)
        return out


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest values of each row; of equal ones those that come first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(cosine, near, 1).min(1)
    for r in np.flatnonzero((cosine >= last[:, None]).sum(1) > k):  # a tie at the limit
        near[r] = np.lexsort((np.arange(cosine.shape[1]), -cosine[r]))[:k]
    return near


def train(docs: DataFrame, labels: DataFrame, fold: int = 2) -> Voters | None:
    """Voters from labelled documents outside the fold: at most about REFERENCES a class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(f"doc_id is not null and quality in (0, 1) and pmod(crc32(cast(doc_id as string)), 4) <> {fold}")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return None
    wide = 1_000_000
    rate = F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, min(wide, -(-wide * REFERENCES // n)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < rate[F.col("quality")]).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in ts.slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[lo:hi], "quality": batch.column("quality")[lo:hi], "bag": pa.array([x.tobytes() for x in bags(buf, offs).astype(np.float16)], pa.binary())})

    first = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * REFERENCES)  # about 2 * REFERENCES rows are chosen
    joined = texts.join(F.broadcast(first), "doc_id")
    rows = sorted({(r.doc_id, r.quality, bytes(r.bag)) for r in joined.mapInArrow(sample, "doc_id long, quality int, bag binary").toLocalIterator()})
    return _fit(np.array([np.frombuffer(b, np.float16) for _, _, b in rows], np.float32).reshape(-1, WIDTH), np.array([q for _, q, _ in rows], np.float64), counts) if rows else None


def _fit(bag: np.ndarray, quality: np.ndarray, counts: dict[int, int]) -> Voters:
    keep = bag.any(1)
    bag, quality = bag[keep], quality[keep]
    present = (bag > 0).sum(0)
    scale = np.log((1 + len(bag)) / (1 + present)).astype(np.float32) + 0.1
    x = bag * scale
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    base = vectors[:, ::-1][:, :RANK].astype(np.float32)
    weight = np.array([counts.get(int(q), 0) / max(1, int((quality == q).sum())) for q in quality])
    total = sum(counts.values())
    voters = Voters(scale, base, np.empty((0, RANK), np.float32), quality, weight / weight.max() if len(weight) else weight, counts.get(1, 0) / total)
    voters.vectors = voters.latent(bag)
    return voters


def classify(docs: DataFrame, labels: DataFrame, fold: int = 2) -> DataFrame:
    """Score and prediction of every whole text.

    Texts without words, and all texts if nothing was learned, get the share of label 1 (0.5 without labels).
    Each row gives one row, repeated rows repeat; a null doc_id counts as held out; labels that are null or not
    0 or 1 are left out, contradicting ones count as 0. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for lo, hi, buf, offs in ts.slices(batch.column("text")):
                score = voters.score(bags(buf, offs)) if voters is not None else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[lo:hi], "held_out": batch.column("held_out")[lo:hi], "score": score, "predicted": pa.array((score >= CUT).astype(np.int32))})

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == fold, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(scan, REPORT)
