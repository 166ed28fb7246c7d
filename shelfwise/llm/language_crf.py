"""Language identification with a linear-chain conditional random field over words.

Every word gets a label. Its features are affixes, letter n-grams and its entry in a lexicon; transitions
between the labels of neighbouring words are learned, and forward-backward gives each word's label
probabilities, so a text may switch between languages. A document's language is that of most of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textscan as ts

#: Labelled documents a language that the model is fitted on, chosen by hash over the whole table, and the
#: chains taken of each. The bounds hold at any size of the table. All languages are learned; beyond ``MANY`` the
#: documents of each are fewer, down to ``LEAST_DOCS``, and texts are labelled in smaller pieces.
DOCS_PER_LANG = 600
LEAST_DOCS = 20
MANY = 64
CHAINS_PER_DOC = 6
#: Words of a chain; longer texts are cut into chains.
CHAIN = 64
BITS = 18
AFFIX = 4
LEXICON = 4_000
EPOCHS = 4
UNKNOWN = "und"
REPORT = "doc_id long, held_out boolean, lang_pred string, score double"

#: Letters of words: ASCII letters and all bytes above ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
LETTERS[128:] = True

_U = np.uint64


def features(buf: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(affixes and whole word [words, 2 * AFFIX + 1], n-grams, first n-gram of each word), as weight rows."""
    mask = _U((1 << BITS) - 1)
    size = ends - starts
    cols = []
    for k in range(1, AFFIX + 1):
        n = np.minimum(size, k)
        cols.append(ts.mix(ts.range_hash(sums, starts, starts + n) + _U(2 * k)) & mask)
        cols.append(ts.mix(ts.range_hash(sums, ends - n, ends) + _U(2 * k + 1)) & mask)
    cols.append(ts.mix(ts.range_hash(sums, starts, ends) + _U(101)))
    grams = np.maximum(size - 2, 1)
    first = np.cumsum(grams) - grams
    at = np.repeat(starts - first, grams) + np.arange(int(grams.sum()))
    ngrams = ts.mix(ts.range_hash(sums, at, np.minimum(at + 3, np.repeat(ends, grams))) + _U(103)) & mask
    return np.stack(cols, 1), ngrams.astype(np.int64), first


@dataclass
class Chain:
    """Weights of the model: one row a hashed feature, transitions and start scores."""

    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexical: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def rows(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight rows of the affixes, lexicon rows; the last one is that of words outside)."""
        word = cols[:, -1]
        at = np.searchsorted(self.lexicon, word)
        at[at == len(self.lexicon)] = 0
        known = self.lexicon[at] == word if len(self.lexicon) else np.zeros(len(word), bool)
        return cols[:, :-1].astype(np.int64), np.where(known, at, len(self.lexicon))

    def emissions(self, cols: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        affix, lex = self.rows(cols)
        out = self.weights[affix].sum(1) + self.lexical[lex]
        n = np.diff(np.append(first, len(grams)))
        return out + np.add.reduceat(self.weights[grams], first, axis=0) / np.sqrt(n)[:, None]


def forward_backward(emission: np.ndarray, inside: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label probabilities [n, t, k], expected transitions [k, k], log of the sum over labelings) of n chains."""
    n, t, k = emission.shape
    top = emission.max(2, keepdims=True)
    local = np.exp(emission - top)
    step = np.exp(transition)
    alpha = np.empty_like(local)
    scale = np.ones((n, t), local.dtype)
    a = np.exp(start)[None, :] * local[:, 0]
    for i in range(t):
        if i:
            a = np.where(inside[:, i, None], (alpha[:, i - 1] @ step) * local[:, i], alpha[:, i - 1])
        scale[:, i] = a.sum(1)
        alpha[:, i] = a = a / scale[:, i, None]
    beta = np.ones((n, k), local.dtype)
    gamma = np.empty_like(local)
    pairs = np.zeros((k, k), np.float64)
    gamma[:, t - 1] = alpha[:, t - 1]
    for i in range(t - 1, 0, -1):
        on = inside[:, i, None]
        ahead = local[:, i] * beta / scale[:, i, None]
        pairs += ((alpha[:, i - 1] * on).T @ ahead) * step
        beta = np.where(on, ahead @ step.T, beta)
        g = alpha[:, i - 1] * beta
        gamma[:, i - 1] = g / g.sum(1, keepdims=True)
    log_z = (np.log(scale) + np.where(inside, top[:, :, 0], 0)).sum(1)
    return gamma, pairs, log_z


def _learned(docs: DataFrame, fold: int) -> DataFrame:
    return docs.where(f"doc_id is not null and lang is not null and text is not null and pmod(crc32(cast(doc_id as string)), 4) <> {fold}")


def docs_per_lang(langs: int) -> int:
    """Documents of each language, so that a fit of many costs about as much as one of ``MANY``."""
    return DOCS_PER_LANG if langs <= MANY else max(LEAST_DOCS, DOCS_PER_LANG * MANY**2 // langs**2)


def _bytes(model: Chain | None) -> int:
    """Bytes of text that are labelled at a time."""
    return ts.SLICE_BYTES * MANY // max(MANY, len(model.langs) if model else 0)


def train(docs: DataFrame, fold: int = 2, seed: int = 11) -> Chain | None:
    """Fit on a bounded sample of labelled documents outside the fold; null if there is none."""
    known = _learned(docs, fold)
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    wide = 1_000_000
    each = docs_per_lang(len(counts))
    rates = docs.sparkSession.createDataFrame([(lang, min(wide, -(-wide * each // n))) for lang, n in counts.items()], "lang string, rate long")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(wide)).alias("at"))
    chosen = known.join(F.broadcast(rates), "lang").where("at < rate").select("doc_id", "lang", "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, _, buf, offs in ts.slices(batch.column("text")):
                starts, ends, first = ts.words(buf, offs, LETTERS)
                raw = buf.tobytes()
                out = []
                for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    cuts = list(range(a, b, CHAIN))
                    if len(cuts) > CHAINS_PER_DOC:
                        cuts = sorted(np.random.default_rng(abs(ids[lo + r])).choice(cuts, CHAINS_PER_DOC, replace=False).tolist())
                    out += [(langs[lo + r], b" ".join(raw[starts[w] : ends[w]] for w in range(c, min(b, c + CHAIN))).decode("utf-8", "replace")) for c in cuts]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in out], pa.string()), "chain": pa.array([x for _, x in out], pa.string())})

    rows = sorted((r.lang, r.chain) for r in chosen.mapInArrow(sample, "lang string, chain string").toLocalIterator())
    return _fit(rows, sorted(counts), seed)


def _fit(rows: list[tuple[str, str]], langs: list[str], seed: int) -> Chain:
    k = len(langs)
    number = {x: i for i, x in enumerate(langs)}
    label = np.array([number[x] for x, _ in rows])
    buf, offs = ts.text_parts(pa.array([x for _, x in rows], pa.string()))
    starts, ends, chain = ts.words(buf, offs, LETTERS)
    sums = ts.prefix_sums(buf)
    cols, grams, first = features(buf, sums, starts, ends)
    n_grams = np.diff(np.append(first, len(grams)))
    words, times = np.unique(cols[:, -1], return_counts=True)
    lexicon = np.sort(words[np.lexsort((words, -times))[:LEXICON]])
    model = Chain(langs, np.zeros((1 << BITS, k), np.float32), lexicon, np.zeros((len(lexicon) + 1, k), np.float32), np.eye(k) * 0.5, np.zeros(k))
    affix, lex = model.rows(cols)
    rng = np.random.default_rng(seed)
    power = np.full((1 << BITS, 1), 1.0, np.float32)  # sums of squared gradients, for step sizes
    order = np.arange(len(rows))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in np.array_split(order, max(1, len(order) // 64)):
            size = chain[at + 1] - chain[at]
            at, size = at[size > 0], size[size > 0]
            if not len(at):
                continue
            own = np.repeat(chain[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            g = np.repeat(first[own] - (np.cumsum(n_grams[own]) - n_grams[own]), n_grams[own]) + np.arange(int(n_grams[own].sum()))
            g_first = np.cumsum(n_grams[own]) - n_grams[own]
            e = model.weights[affix[own]].sum(1) + model.lexical[lex[own]] + np.add.reduceat(model.weights[grams[g]], g_first, axis=0) / np.sqrt(n_grams[own])[:, None]
            inside = np.arange(int(size.max()))[None, :] < size[:, None]
            grid = np.zeros((*inside.shape, k))
            grid[inside] = e
            gamma, pairs, _ = forward_backward(grid, inside, model.transition, model.start)
            want = np.zeros((len(own), k))
            want[np.arange(len(own)), np.repeat(label[at], size)] = 1
            grad = (want - gamma[inside]).astype(np.float32)
            parts = [(affix[own].ravel(), np.repeat(grad, affix.shape[1], axis=0)), (grams[g], np.repeat(grad / np.sqrt(n_grams[own])[:, None], n_grams[own], axis=0).astype(np.float32))]
            idx, values = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
            rows_, inverse = np.unique(idx, return_inverse=True)
            total = np.stack([np.bincount(inverse, values[:, j], len(rows_)) for j in range(k)], 1).astype(np.float32)
            power[rows_, 0] += (total**2).mean(1)
            model.weights[rows_] += 0.3 * total / np.sqrt(power[rows_])
            model.lexical += 0.05 * np.stack([np.bincount(lex[own], grad[:, j], len(lexicon) + 1) for j in range(k)], 1).astype(np.float32) / np.sqrt(len(at))
            seen = np.zeros((k, k))
            np.add.at(seen, (label[at], label[at]), size - 1)
            model.transition += 0.02 * (seen - pairs) / len(at)
            model.start += 0.02 * (np.bincount(label[at], minlength=k) - gamma[:, 0].sum(0)) / len(at)
    model.transition = np.clip(model.transition, -4, 4)
    return model


def label_words(model: Chain, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities of each word's labels, starts, ends, first): chains never cross rows."""
    starts, ends, first = ts.words(buf, offs, LETTERS)
    k = len(model.langs)
    if not len(starts):
        return np.empty((0, k)), starts, ends, first
    sums = ts.prefix_sums(buf)
    key = ts.range_hash(sums, starts, ends)
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    e = model.emissions(*features(buf, sums, starts[one], ends[one]))[which].astype(np.float32)
    n = np.diff(first)
    chains = -(-n // CHAIN)
    head = np.repeat(first[:-1], chains) + CHAIN * (np.arange(int(chains.sum())) - np.repeat(np.cumsum(chains) - chains, chains))
    size = np.minimum(np.repeat(first[1:], chains) - head, CHAIN)
    inside = np.arange(int(size.max()))[None, :] < size[:, None]
    grid = np.zeros((*inside.shape, k), np.float32)
    grid[inside] = e
    gamma, _, _ = forward_backward(grid, inside, model.transition.astype(np.float32), model.start.astype(np.float32))
    return gamma[inside], starts, ends, first


def _languages(model: Chain | None, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    rows = len(offs) - 1
    lang, score = [UNKNOWN] * rows, np.zeros(rows)
    if model is not None:
        p, _, _, first = label_words(model, buf, offs)
        n = np.diff(first)
        some = np.flatnonzero(n)
        mean = np.add.reduceat(p, first[some], axis=0) / n[some][:, None] if len(some) else np.empty((0, 1))
        plain = np.append(0, np.cumsum((buf < 128) & LETTERS[buf]))
        for r, m in zip(some.tolist(), mean, strict=True):
            if plain[offs[r + 1]] > plain[offs[r]] or any(c.isalpha() for c in buf[offs[r] : offs[r + 1]].tobytes().decode()):
                lang[r], score[r] = model.langs[int(m.argmax())], min(1.0, float(m.max()))
    return lang, score


def predict(docs: DataFrame, model: Chain | None, fold: int = 2) -> DataFrame:
    """Language and its probability, averaged over the words of each whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned. Each
    row gives one row, repeated rows repeat; a null doc_id counts as held out. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, buf, offs in ts.slices(batch.column("text"), _bytes(model)):
                lang, score = _languages(model, buf, offs)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[lo:hi], "held_out": batch.column("held_out")[lo:hi], "lang_pred": lang, "score": score})

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == fold, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(scan, REPORT)


def identify(docs: DataFrame, fold: int = 2) -> DataFrame:
    """Learn from the labelled documents outside the fold, then predict all."""
    return predict(docs, train(docs, fold), fold)


def keep_known(docs: DataFrame, fold: int = 2) -> DataFrame:
    """``docs`` without those that ``identify`` calls ``und``; all columns stay. If nothing was learned, all stay."""
    model = train(docs, fold)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, buf, offs in ts.slices(batch.column("text"), _bytes(model)):
                lang, _ = _languages(model, buf, offs)
                out = batch.slice(lo, hi - lo).filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))
                if out.num_rows:
                    yield out

    return docs.mapInArrow(scan, docs.schema)
