"""N-gram Jaccard self-join over count vectors.

Shingles are hashed into groups; a document is the point of its group counts. The similarity bounds how many
shingles two linked documents can differ in, so with more groups than that at least one group holds the very
same shingles in both: such equal groups bring candidates together without loss. Candidates are indexed by
their points in an R-tree; the sum of coordinate minima bounds the overlap, and survivors are verified on
their full sets.

Copies are merged first. A group of near copies is not expanded into pairs: every document is compared with one
leader of its candidates. Candidates left in different components are searched in the R-tree; of the pairs that the
bound lets through, a search gives out a forest over the components at most, and once those are verified, what is still
open is searched and verified on full sets in one place, which again gives out a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textscan as ts
from shelfwise.operators.components import connected_components
from shelfwise.session import deals, drop, fits, settle

SHINGLE = 4
PERCENT = 85
#: Coordinates of a point in the index.
DIMS = 64
#: Groupings tried before empty groups count as equal ones.
LEVELS = 4
CHUNK = 1 << 20
#: Rows of ids that may be broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000
LEAF = 16
#: Rows of candidates that are searched in one task. A key with more is dealt as pairs of blocks.
BLOCK = 4_096
TASK_ROWS = 20_000
#: Rows with full sets in one task.
SET_ROWS = 4_000

_U = np.uint64


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; the whole sequence if it is shorter; empty without words."""
    hashes, _, _, first = ts.word_hashes(buf, offs, ts.SPACE_WORDS)
    full = ts.window_hashes(hashes, size)
    short = {k: ts.window_hashes(hashes, k) for k in range(1, size)}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            x = np.sort(full[a : b - size + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        else:
            out.append(short[n][a : a + 1] if n else np.empty(0, np.uint64))
    return out


@lru_cache(maxsize=4)
def _classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, groups, slack) of each class of set sizes.

    A pair belongs to the class of its smaller set. With d the most that its sets can differ in, groups are
    d + 1 + slack: a set with at most ``slack`` empty groups shares a group that is not empty.
    """
    lows = [1]
    while lows[-1] < 1 << 31:
        lows.append(max(lows[-1] + 1, int(lows[-1] * 1.4)))
    groups, slacks = [], []
    for lo, hi in zip(lows, lows[1:], strict=False):
        a = hi - 1
        d = (a + a * 100 // percent) * (100 - percent) // (100 + percent)
        slack = 1 + d // 8
        groups.append(d + 1 + slack if d else 0)
        slacks.append(slack)
    return np.array(lows), np.array(groups), np.array(slacks)


def group_keys(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set; two sets that link and differ have one in common."""
    lows, groups, slacks = _classes(percent)
    n = len(shingles)
    if not n:
        return np.empty(0, np.uint64)
    top = int(np.searchsorted(lows, n, "right")) - 1
    low = int(np.searchsorted(lows, -(-n * percent // 100), "right")) - 1
    out = []
    for c in range(low, top + 1):
        g = int(groups[c])
        if not g:
            continue
        for level in range(LEVELS):
            values = shingles if level == 0 else np.sort(ts.mix(shingles + _U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            which = ((values >> _U(32)) * _U(g)) >> _U(32)
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            content = np.add.reduceat(ts.mix(values), first)
            salt = _U((c * LEVELS + level) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
            out.append(ts.mix(content + salt + which[first] * _U(0x9FB21C651E98DF25)))
            empty = g - len(first)
            if empty <= slacks[c]:
                break
            if level == LEVELS - 1:
                gone = np.setdiff1d(np.arange(g, dtype=np.uint64), which[first])
                out.append(ts.mix(salt + (gone + _U(1)) * _U(0xD1342543DE82EF95)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def point(shingles: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """How many shingles fall into each of ``dims`` groups."""
    return np.bincount(((shingles >> _U(32)) * _U(dims) >> _U(32)).astype(np.int64), minlength=dims).astype(np.int32)


def sketch(shingles: np.ndarray) -> bytes:
    """The point of a set in as many groups as the power of two that its size reaches, at least DIMS; a byte a group."""
    return np.minimum(point(shingles, max(DIMS, 1 << max(0, len(shingles).bit_length() - 1))), 255).astype(np.uint8).tobytes()


def enough(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


class Sketches:
    """Group counts of some sets. Coarser groups are sums of finer ones, so any two sets can be compared."""

    def __init__(self, data: list[bytes], size: np.ndarray):
        self.size = size
        self.groups = np.array([len(x) for x in data], np.int64)
        self.place = np.zeros(len(data), np.int64)
        self.points = np.zeros((len(data), DIMS), np.int32)
        self.excess = np.zeros(len(data), np.int64)  # what a byte could not hold
        self.grids: dict[int, np.ndarray] = {}
        for g in np.unique(self.groups).tolist():
            at = np.flatnonzero(self.groups == g)
            grid = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(-1, g)
            self.grids[g], self.place[at] = grid, np.arange(len(at))
            self.points[at] = grid.reshape(len(at), DIMS, -1).sum(2, dtype=np.int32)
            self.excess[at] = size[at] - self.points[at].sum(1)
        self.points[:, 0] += self.excess.astype(np.int32)  # so that a point sums to the size

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper bound on what sets a[i] and b[i] have in common: the sum of the minima of their group counts."""
        out = np.zeros(len(a), np.int64)
        coarse = np.minimum(self.groups[a], self.groups[b])
        kind = self.groups[a] * (1 << 32) + self.groups[b]
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            g = int(coarse[at[0]])
            step = max(1, (1 << 22) // g)
            for lo in range(0, len(at), step):
                e = at[lo : lo + step]
                x, y = (self.grids[int(self.groups[s[0]])][self.place[s]].reshape(len(e), g, -1).sum(2, dtype=np.int32) for s in (a[e], b[e]))
                out[e] = np.minimum(x, y).sum(1)
        return out + np.minimum(self.excess[a], self.excess[b])


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """Which edges (a, b) make a forest of greatest weight over ``count`` nodes, by rounds of best edges."""
    label = np.arange(count)
    order = np.lexsort((b, a, -weight))  # a total order, so that best edges make no circle
    a, b = a[order], b[order]
    taken = []
    live = np.flatnonzero(a != b)
    while len(live):
        ends, edge = np.concatenate([label[a[live]], label[b[live]]]), np.concatenate([live, live])
        best = np.full(count, len(a))
        np.minimum.at(best, ends, edge)
        pick = np.unique(best[best < len(a)])
        taken.append(pick)
        x, y = label[a[pick]], label[b[pick]]
        to = np.arange(count)
        while True:
            low = np.minimum(to[x], to[y])
            new = to.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if np.array_equal(new, to):
                break
            to = new
        label = to[label]
        live = live[label[a[live]] != label[b[live]]]
    return order[np.concatenate(taken)] if taken else np.empty(0, np.int64)


class CountTree:
    """R-tree over count vectors, packed bottom-up; boxes keep upper corners and least sizes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        size = points.sum(1)
        self.order = np.lexsort((*points.T[: min(8, points.shape[1])][::-1], size))
        self.points, self.leaf = points[self.order], leaf
        self.levels = []
        upper, least = self.points, size[self.order]
        while len(upper) > leaf:
            cuts = np.arange(0, len(upper), leaf)
            upper, least = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((upper, least))

    def search(self, queries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose bound on the overlap is high enough."""
        q_size = queries.sum(1)
        out = []
        step = max(1, 200_000 // max(1, len(self.points) // self.leaf ** len(self.levels)))
        for a in range(0, len(queries), step):
            k = min(len(queries), a + step) - a
            width = len(self.levels[-1][0]) if self.levels else len(self.points)
            q, at = np.repeat(np.arange(a, a + k), width), np.tile(np.arange(width), k)
            for upper, least in self.levels[::-1]:
                keep = self._keep(queries, q_size, q, upper, least, at, percent)
                q, at = q[keep], at[keep]
                below = len(self.points) if upper is self.levels[0][0] else len(self.levels[self._index(upper) - 1][0])
                q, at = np.repeat(q, self.leaf), (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                inside = at < below
                q, at = q[inside], at[inside]
            keep = self._keep(queries, q_size, q, self.points, self.points.sum(1), at, percent)
            out.append((q[keep], self.order[at[keep]]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _index(self, upper: np.ndarray) -> int:
        return next(i for i, (u, _) in enumerate(self.levels) if u is upper)

    @staticmethod
    def _keep(queries: np.ndarray, q_size: np.ndarray, q: np.ndarray, upper: np.ndarray, least: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
        keep = np.empty(len(q), bool)
        for s in range(0, len(q), 1 << 15):
            e = slice(s, s + (1 << 15))
            bound = np.minimum(queries[q[e]], upper[at[e]]).sum(1)
            keep[e] = enough(bound, q_size[q[e]], least[at[e]], percent)
        return keep


_DEALT = "bucket int, kind int, a array<long>, b array<long>, c array<int>"


def _batch(bucket: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> pa.RecordBatch:
    c = np.zeros(len(a), np.int32) if c is None else c.astype(np.int32)
    out = ts.dealt(bucket, {"a": (a, pa.int64()), "b": (b, pa.int64()), "c": (c, pa.int32())})
    return out.append_column("kind", pa.array([kind] * out.num_rows, pa.int32())).select(["bucket", "kind", "a", "b", "c"])


def _exploded(df: DataFrame, kind: int, a: str, b: str, c: str | None = None) -> DataFrame:
    rows = df.where(F.col("kind") == kind).select("bucket", F.explode(F.arrays_zip("a", "b", *(["c"] if c else []))).alias("x"))
    return rows.select("bucket", F.col("x.a").alias(a), F.col("x.b").alias(b), *([F.col("x.c").alias(c)] if c else []))


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is in ``ids``; the ids are broadcast only when few enough."""
    return docs.join(F.broadcast(ids) if fits(ids, BROADCAST_ROWS) else ids, "doc_id", "left_semi")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for lo, hi, buf, offs in ts.slices(batch.column("text")):
            yield batch.column("doc_id")[lo:hi], shingle_sets(buf, offs, size)


def common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What each pair of sets has in common; ``x`` and ``y`` are (values back to back, size of each set)."""
    pair = np.concatenate([np.repeat(np.arange(len(n)), n) for _, n in (x, y)])
    value = np.concatenate([x[0], y[0]])
    order = np.lexsort((value, pair))
    same = (value[order][1:] == value[order][:-1]) & (pair[order][1:] == pair[order][:-1])
    return np.bincount(pair[order][1:][same], minlength=len(x[1]))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _set_table(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(rep, shingles) of some documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, found in _sets(batches, size):
            yield pa.RecordBatch.from_pydict({"rep": doc_ids, "shingles": ts.lists(np.concatenate(found).view(np.int64), np.array([len(x) for x in found]), pa.int64())})

    return _of_ids(docs, ids).mapInArrow(sets, "rep long, shingles array<long>")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The settled ``pairs`` (a, b) that link, by their full sets."""
    ids = settle(_ends(pairs), "ids")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, y = _flat(part.column("x")), _flat(part.column("y"))
                yield part.select(["a", "b"]).filter(pa.array(enough(common(x, y), x[1], y[1], percent)))

    known = settle(_set_table(docs, ids, size), "sets")
    left = known.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = known.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    links = settle(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long").distinct(), "links")
    drop(known, ids)
    return links


def _within_bound(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose group counts may overlap enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                size = np.concatenate([batch.column(k).to_numpy() for k in ("m", "n")]).astype(np.int64)
                both = Sketches(batch.column("x").to_pylist() + batch.column("y").to_pylist(), size)
                yield batch.select(["a", "b"]).filter(pa.array(enough(both.overlap(np.arange(n), np.arange(n, 2 * n)), size[:n], size[n:], percent)))

    left = sketches.select(F.col("rep").alias("a"), F.col("n").alias("m"), F.col("counts").alias("x"))
    right = sketches.select(F.col("rep").alias("b"), "n", F.col("counts").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Set size and component of every document, linked at ``percent`` of Jaccard similarity of shingle sets.

    Null and empty texts, and texts without words, have no shingles and no links. ``doc_id`` names a document:
    rows without it are left out, rows that repeat id and text give one row each. Other columns are ignored. A key
    shared by more than ``block`` candidates is searched in pairs of blocks.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    buckets = deals(source)

    def of(h: np.ndarray) -> np.ndarray:
        return (ts.mix(h.view(np.uint64)) % _U(buckets)).astype(np.int32)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        reps: dict[int, int] = {}  # content -> the document of this chunk that stands for it
        least: dict[int, int] = {}  # content -> its least document in this chunk
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                k = np.concatenate(keys).view(np.int64)
                yield _batch(of(k), 0, k, np.concatenate(nodes))
            if reps:
                f = np.fromiter(reps, np.uint64, len(reps)).view(np.int64)
                yield _batch(of(f), 1, f, np.fromiter(reps.values(), np.int64, len(reps)))
                yield _batch(of(f), 4, f, np.fromiter((least[c] for c in reps), np.int64, len(reps)))

        for ids, found in _sets(batches, size):
            docs_, rep_ = ids.to_numpy(zero_copy_only=False), []
            for d, x in zip(docs_.tolist(), found, strict=True):
                if not len(x):
                    rep_.append(d)
                    continue
                content = int(ts.mix(np.add.reduce(ts.mix(x), keepdims=True) + _U(len(x)))[0])
                rep = reps.get(content)
                if rep is None:
                    rep = reps[content] = least[content] = d
                    k = group_keys(x, percent)
                    keys.append(k)
                    nodes.append(np.full(len(k), d, np.int64))
                    held += len(k) + 1
                elif d < least[content]:
                    least[content] = d
                rep_.append(rep)
            yield _batch(ts.doc_bucket(docs_, buckets), 2, docs_, np.array(rep_, np.int64), np.array([len(x) for x in found]))
            if held >= CHUNK:
                yield from flush()
                keys, nodes, reps, least, held = [], [], {}, {}, 0
        yield from flush()

    def met(table: pa.Table) -> pa.Table:
        """Per bucket: least document of each content, keys of several documents, and their leaders."""
        kind = np.repeat(table.column("kind").to_numpy(), [len(x) for x in table.column("a")])
        a, b, c = ts.gathered(table, "a", np.int64), ts.gathered(table, "b", np.int64), ts.gathered(table, "c", np.int32)
        bucket = table.column("bucket")[0].as_py()
        out = []

        def put(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> None:
            if len(a):
                out.append(_batch(np.full(len(a), bucket, np.int32), kind, a, b, c))

        at = kind == 2
        put(2, a[at], b[at], c[at])
        at = kind == 4
        order = np.lexsort((b[at], a[at]))
        known, first = np.unique(a[at][order], return_index=True)
        low = b[at][order][first]
        at = kind == 1
        put(1, b[at], low[np.searchsorted(known, a[at])])
        at = kind == 0
        order = np.lexsort((b[at], a[at]))
        k, d = a[at][order], b[at][order]
        if len(k):
            fresh = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
            k, d = k[fresh], d[fresh]
            new = np.append(True, k[1:] != k[:-1])
            many = ~new
            many[:-1] |= ~new[1:]
            leader = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
            put(0, k[many], d[many])
            star = many & ~new
            x, y = d[star], leader[star]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            if len(x):
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                put(3, x[first], y[first], np.diff(np.append(first, len(x))))
        return pa.Table.from_batches(out, schema=_batch(np.zeros(1, np.int32), 0, np.zeros(1, np.int64), np.zeros(1, np.int64)).schema)

    dealt = settle(source.mapInArrow(keyed, _DEALT).groupBy("bucket").applyInArrow(met, _DEALT), "met")
    members = settle(_exploded(dealt, 2, "doc_id", "local", "n_shingles").drop("bucket"), "members")
    same = settle(_exploded(dealt, 1, "local", "rep").groupBy("local").agg(F.min("rep").alias("rep")), "same")
    keys = settle(_exploded(dealt, 0, "key", "local").join(same, "local").select("key", "rep").distinct(), "keys")

    # every document against the leader with which it shares most groups
    shared = _exploded(dealt, 3, "local", "leader", "k").groupBy("local", "leader").agg(F.sum("k").alias("k"))
    pairs = shared.join(same.withColumnRenamed("rep", "a"), "local").join(same.select(F.col("local").alias("leader"), F.col("rep").alias("b")), "leader").where("a <> b")
    best = settle(pairs.groupBy("a").agg(F.max(F.struct("k", (-F.col("b")).alias("col2"))).alias("x")).select("a", (-F.col("x.col2")).alias("b")), "best")
    drop(dealt)
    ids = settle(keys.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sketches = settle(_of_ids(source, ids).mapInArrow(lambda batches: _sketched(batches, size), "rep long, n int, counts binary").dropDuplicates(["rep"]), "sketches")
    near = settle(_within_bound(best, sketches, percent), "near")
    links = [_verified(source, near, size, percent)]
    drop(best, ids, near)
    joined = connected_components(links[0])

    # keys whose documents are still in several components: a forest of what the bound lets through
    inside = _open(keys, sketches, joined)
    drop(joined)
    more = settle(_searched(inside, percent, block, True).distinct(), "more")
    drop(inside)
    if not more.isEmpty():
        links.append(_verified(source, more, size, percent))
        joined = connected_components(links[0].union(links[1]))
        # and what is open after that, verified in one place
        inside = _open(keys, sketches, joined)
        left = settle(_searched(inside, percent, block, False), "left")
        drop(inside, joined)
        if not left.isEmpty():
            links.append(_settled(source, left, size, percent))
        drop(left)
    drop(keys, sketches, more)
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    final = connected_components(every)
    out = settle(
        members.join(same, "local", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
        .join(final.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")),
        "found",
    )
    drop(members, same, final, *links)
    return out


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for ids, found in _sets(batches, size):
        yield pa.RecordBatch.from_pydict({"rep": ids, "n": pa.array([len(x) for x in found], pa.int32()), "counts": pa.array([sketch(x) for x in found], pa.binary())})


def _one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Keys; of those that compare the very same documents with each other, one."""
    row = [F.col(c) for c in ("rep", "q", "side")]
    lists = rows.groupBy(key).agg(F.count("*").alias("total"), F.bit_xor(F.xxhash64(*row)).alias("s"), F.bit_xor(F.xxhash64(*row, F.lit(7))).alias("t"))
    return lists.groupBy("total", "s", "t").agg(F.min(key).alias(key))


def _open(keys: DataFrame, sketches: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, total, rep, component, q, n, counts) of the keys whose documents are in several components; ``q`` marks
    documents outside the key's largest component, and of every pair to be searched one is such."""
    where = keys.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = where.groupBy("key", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("t"))
    lists = parts.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("top"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t")).where("parts > 1")
    one = settle(lists.groupBy("total", "s", "t").agg(F.min_by(F.struct("key", "top"), "key").alias("x")).select("x.key", "x.top", "total"), "one")
    rows = where.join(one, "key").select("key", "total", "rep", "component", (F.col("component") != F.col("top")).alias("q"))
    out = settle(rows.join(sketches, "rep"), "open")
    drop(one)
    return out


def _blocks(inside: DataFrame, percent: int, block: int) -> DataFrame:
    """Rows with ``task``, the search that they belong to, and ``side``: 1 and 2 are compared with each other, 0 with all.

    The rows of a large key are cut into blocks by size and by whether they are outside the largest component;
    blocks too different in size to link, and two blocks of the largest component, do not meet.
    """
    tasks = max(1, -(-inside.count() // TASK_ROWS))
    small = inside.where(F.col("total") <= block).withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).withColumn("side", F.lit(0))
    large = inside.where(F.col("total") > block).withColumn("band", F.floor(F.log("n") / (float(np.log(100 / percent)) * 1.001 + 1e-9)))
    counts = large.groupBy("key", "band", "q").agg(F.expr(f"cast(ceil(count(1) / {block}) as int)").alias("chunks"))
    large = large.join(counts, ["key", "band", "q"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    pages = counts.select("key", "band", "q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    x, y = (pages.select("key", F.struct("band", "q", "chunk").alias(name)) for name in ("x", "y"))
    meet = x.join(y, "key").where("x.q and abs(x.band - y.band) <= 1 and (not y.q or x <= y)").withColumn("task", F.xxhash64("key", "x", "y"))
    alone = F.col("x") == F.col("y")
    sides = meet.select("key", "x.*", "task", F.when(alone, 0).otherwise(1).alias("side")).union(meet.where(~alone).select("key", "y.*", "task", F.lit(2)))
    return small.unionByName(large.join(sides, ["key", "band", "q", "chunk"]).select(small.columns))


def cross_pairs(key: np.ndarray, comp: np.ndarray, q: np.ndarray, side: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with one key, in different components, one of them ``q``, whose points let them link."""
    order = np.argsort(key, kind="stable")
    found = [np.empty((2, 0), np.int64)]
    size = points.sum(1)
    few: list[np.ndarray] = []
    for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(at) <= LEAF:  # a tree of one leaf
            i, j = np.triu_indices(len(at), 1)
            few.append(np.array([at[i], at[j]]))
            continue
        left, right = at[q[at] & (side[at] < 2)], at[side[at] != 1]
        if len(left) and len(right):
            a, b = CountTree(points[right]).search(points[left], percent)
            found.append(np.array([left[a], right[b]]))
    if few:
        a, b = np.concatenate(few, axis=1)
        keep = (q[a] | q[b]) & (comp[a] != comp[b]) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[keep], b[keep]
        for lo in range(0, len(a), 1 << 15):
            x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
            keep = enough(np.minimum(points[x], points[y]).sum(1), size[x], size[y], percent)
            found.append(np.array([x[keep], y[keep]]))
    a, b = np.concatenate(found, axis=1)
    keep = (comp[a] != comp[b]) & ((side[a] != side[b]) | ~q[b] | (a < b))
    return a[keep], b[keep]


def _candidates(table: pa.Table, percent: int) -> tuple[np.ndarray, ...]:
    """(a, b, bound, rep, component) of the pairs of rows that the finer bound lets through as well."""
    key, rep, comp, q, side, n = (table.column(k).to_numpy() for k in ("key", "rep", "component", "q", "side", "n"))
    grids = Sketches(table.column("counts").to_pylist(), n.astype(np.int64))
    a, b = cross_pairs(key, comp, q, side, grids.points, percent)
    bound = grids.overlap(a, b)
    keep = enough(bound, n[a], n[b], percent)
    return a[keep], b[keep], bound[keep] / np.maximum(n[a] + n[b] - bound, 1)[keep], rep, comp


def _forest_of(a: np.ndarray, b: np.ndarray, weight: np.ndarray, rep: np.ndarray, comp: np.ndarray) -> pa.Table:
    """(a, b) of a forest over components."""
    node = np.unique(comp, return_inverse=True)[1]
    e = forest(node[a], node[b], weight, int(node.max(initial=-1)) + 1)
    return pa.table({"a": pa.array(rep[a[e]], pa.int64()), "b": pa.array(rep[b[e]], pa.int64())})


def _searched(inside: DataFrame, percent: int, block: int, edges: bool) -> DataFrame:
    """A forest (a, b) of candidates for each search, or (``edges`` false) the rows that have a candidate."""

    def search(table: pa.Table) -> pa.Table:
        a, b, weight, rep, comp = _candidates(table, percent)
        if edges:
            return _forest_of(a, b, weight, rep, comp)
        at = np.unique(np.concatenate([a, b]))
        return table.select(["task", "key", "rep", "component", "q", "side", "n"]).take(pa.array(at))

    return _blocks(inside, percent, block).groupBy("task").applyInArrow(search, "a long, b long" if edges else "task long, key long, rep long, component long, q boolean, side int, n int")


def _settled(docs: DataFrame, left: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the rows that are ``left``, a forest for each search, from full sets."""
    left = left.withColumn("place", F.xxhash64("task", "key"))
    one = _one_of_each(left, "place").select("place")
    rows = settle(left.join(one, "place"), "rest")
    ids = settle(rows.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    known = settle(_set_table(docs, ids, size).dropDuplicates(["rep"]), "sets")
    tasks = max(1, -(-rows.count() // SET_ROWS))

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat, n = _flat(table.column("shingles").chunk(0))
        at = np.cumsum(n) - n
        sets = [flat[x : x + k].view(np.uint64) for x, k in zip(at.tolist(), n.tolist(), strict=True)]
        found = table.drop_columns(["key"]).append_column("key", table.column("place")).append_column("counts", pa.array([sketch(x) for x in sets], pa.binary()))
        a, b, _, rep, comp = _candidates(found, percent)
        keep = np.zeros(len(a), bool)
        for lo in range(0, len(a), 256):
            e = slice(lo, lo + 256)
            x, y = ((np.concatenate([sets[i] for i in s]), n[s]) for s in (a[e], b[e]))
            keep[e] = enough(common(x, y), x[1], y[1], percent)
        return _forest_of(a[keep], b[keep], np.ones(int(keep.sum())), rep, comp)

    joined = rows.join(known, "rep").withColumn("deal", F.pmod("place", F.lit(tasks)))
    links = settle(joined.groupBy("deal").applyInArrow(verify, "a long, b long").distinct(), "last")
    drop(rows, ids, known)
    return links
