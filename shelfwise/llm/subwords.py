"""Subword ids by longest match in a tokenizer's vocabulary, for models that need ids and not a tokenizer's own.

Texts are cut into pieces as in ``token_files``; a piece is matched from its start, always by the longest entry of
the vocabulary. A byte-level vocabulary holds all single bytes, so every text has ids and they give it back.
"""

from __future__ import annotations

import numpy as np

from shelfwise.llm import textscan as ts
from shelfwise.llm.token_files import Encoder, _spread

#: Longest entry that is looked up, and longest stretch of a piece that is matched at once.
LONGEST = 16
STRETCH = 64
#: Bytes that bound the length of what may start with them.
HEAD = 4
_BITS = 22

_U = np.uint64


def byte_table(encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all ids back to back, offsets, which are special). Byte-level vocabularies write printable bytes as
    themselves and the others as the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    parts = [b""] * encoder.size
    special = {i for i, t in encoder.tokenizer.get_added_tokens_decoder().items() if t.special}
    for token, i in encoder.tokenizer.get_vocab().items():
        parts[i] = token.encode() if i in special else bytes(byte[c] for c in token)
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts])), np.isin(np.arange(encoder.size), list(special))


class Subwords(Encoder):
    """Whole texts to ids by longest match."""

    def __init__(self, path: str):
        super().__init__(path)
        self.bytes, self.offsets, special = byte_table(self)
        size = np.diff(self.offsets)
        own = np.flatnonzero((size > 0) & ~special)
        key = ts.range_hash(ts.prefix_sums(self.bytes, fold=False), self.offsets[own], self.offsets[own + 1])
        self.there = np.zeros(1 << _BITS, bool)
        self.there[(key & _U((1 << _BITS) - 1)).astype(np.int64)] = True
        # of each head's place, the longest entry with it; shorter entries are always looked up
        self.reach = np.full(1 << _BITS, HEAD - 1, np.uint8)
        headed = own[size[own] >= HEAD]
        head = ts.range_hash(ts.prefix_sums(self.bytes, fold=False), self.offsets[headed], self.offsets[headed] + HEAD)
        np.maximum.at(self.reach, (head & _U((1 << _BITS) - 1)).astype(np.int64), np.minimum(size[headed], LONGEST).astype(np.uint8))
        order = np.argsort(key)
        self.vocabulary_keys, self.vocabulary_ids = key[order], own[order].astype(np.uint32)

    def _pieces(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        # long pieces in stretches
        parts = -(-(ends - starts) // STRETCH)
        piece = np.repeat(np.arange(len(starts)), parts)
        begin = starts[piece] + STRETCH * (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(begin + STRETCH, ends[piece])
        size = stop - begin
        sums = ts.prefix_sums(buf[_spread(begin, size)], fold=False)
        place = np.cumsum(size) - size
        stop = place + size
        active = np.arange(len(place))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            ids, lens = self._longest(sums, place[active], stop[active])
            found.append((active, ids))
            place[active] += lens
            active = active[place[active] < stop[active]]
        count = np.zeros(len(place), np.int64)
        for at, _ in found:
            count[at] += 1
        where = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        for k, (at, ids) in enumerate(found):
            flat[where[at] + k] = ids
        return flat, np.bincount(piece, count, len(starts)).astype(np.int64)

    def _longest(self, sums: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, lens = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
        reach = stop - at
        long = np.flatnonzero(reach >= HEAD)
        head = ts.range_hash(sums, at[long], at[long] + HEAD)
        reach[long] = np.minimum(reach[long], self.reach[(head & _U((1 << _BITS) - 1)).astype(np.int64)])
        open_ = np.flatnonzero(reach >= HEAD)
        for n in range(LONGEST, 0, -1):
            if n == HEAD - 1:
                open_ = np.flatnonzero(lens == 0)
            able = open_[reach[open_] >= n]
            h = ts.range_hash(sums, at[able], at[able] + n)
            maybe = self.there[(h & _U((1 << _BITS) - 1)).astype(np.int64)]
            able, h = able[maybe], h[maybe]
            k = np.minimum(np.searchsorted(self.vocabulary_keys, h), len(self.vocabulary_keys) - 1)
            hit = self.vocabulary_keys[k] == h
            ids[able[hit]], lens[able[hit]] = self.vocabulary_ids[k[hit]], n
            open_ = open_[lens[open_] == 0]
        if len(open_):
            raise ValueError("the vocabulary does not hold all single bytes")
        return ids, lens


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]
