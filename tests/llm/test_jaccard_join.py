import random

import numpy as np

from shelfwise.llm import textscan as ts
from shelfwise.llm.jaccard_join import CountTree, Sketches, enough, forest, group_keys, jaccard_components, point, sketch
from tests.llm.helpers import SCHEMA, corpus, frame


def shingles(text):
    words, cur = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            words.append(cur)
            cur = ""
        else:
            cur += ch.lower() if "A" <= ch <= "Z" else ch
    words = [w for w in [*words, cur] if w]
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def plain(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_equals_plain_version(spark):
    rows = corpus(n=150)
    rng = random.Random(1)
    base = (rows[0][1] + " " + rows[10][1] + " " + rows[-1][1][:900]).split(" ")
    for i in range(40):  # a chain of copies that drift apart
        base[rng.randrange(len(base))] = f"drift{i}"
        rows.append((1000 + i, " ".join(base), None, None, 0))
    for i in range(12):  # small sets about the limit
        rows.append((2000 + i, " ".join([*"abcdefghijklmno"[: 9 + i % 3], f"t{i % 4}"]), None, None, 0))
    got = {r.doc_id: tuple(r)[1:] for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == plain(rows)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(rng.integers(1, 90))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        drop, add = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 62, add).astype(np.uint64)])
        inter = n - drop
        if np.array_equal(a, b) or not len(b) or not enough(np.array(inter), np.array(n), np.array(len(b)), 85):
            continue
        assert np.intersect1d(group_keys(np.sort(a)), group_keys(np.sort(b))).size, (n, drop, add)


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(2)
    sets = [ts.mix(rng.integers(0, 400, int(rng.integers(30, 60))).astype(np.uint64)) for _ in range(300)]
    points = np.array([point(x) for x in sets])
    q, p = CountTree(points).search(points, 85)
    size = points.sum(1)
    bound = np.minimum(points[:, None, :], points[None, :, :]).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(enough(bound, size[:, None], size[None, :], 85)), strict=True)}
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == want


def test_odd_rows(spark):
    rows = [(5, "a b c d e f", None, None, 0), (4, "A  b\tc d e f ", None, None, 0), (7, None, None, None, 0), (8, " ", None, None, 0), (None, "a b c d e f", None, None, 0), (5, "a b c d e f", None, None, 0), (9, "one", None, None, 0), (3, "ONE", None, None, 0)]
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows, 3)).collect())
    assert got == [(3, 1, 3), (4, 3, 4), (5, 3, 4), (5, 3, 4), (7, 0, 7), (8, 0, 8), (9, 1, 3)]
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as component", "2 as rep", "3 as a")
    assert jaccard_components(clash).count() == 7


def test_large_keys_are_searched_in_blocks(spark):
    """Near copies of several templates: many documents to a key, in several components."""
    rng = random.Random(4)
    rows = []
    for t in range(3):
        base = [f"t{t}w{i}" for i in range(120)]
        for i in range(60):
            words = base[:]
            for _ in range(rng.randrange(6)):
                words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((t * 100 + i, " ".join(words[: 120 - 12 * (i % 3)]), None, None, 0))
    want = plain(rows)
    assert 3 < len({c for _, c in want.values()}) < 170
    for block in (4, 4096):
        got = {r.doc_id: tuple(r)[1:] for r in jaccard_components(frame(spark, rows), block=block).collect()}
        assert got == want


def test_two_thousand_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(2000):
        words = base[:]
        words[rng.randrange(200)] = f"x{i}"
        words[rng.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(words), None, None, 0))
    sets = {d: shingles(t) for d, t, *_ in rows}
    left, comp = set(sets), {}
    while left:  # flood from the least
        root = min(left)
        todo = [root]
        left.discard(root)
        while todo:
            d = todo.pop()
            comp[d] = root
            near = {o for o in left if 100 * len(sets[d] & sets[o]) >= 85 * len(sets[d] | sets[o])}
            left -= near
            todo += near
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows), block=256).collect()}
    assert got == comp


def test_forest_spans_and_prefers_heavy_edges():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    weight = rng.integers(0, 5, 300) / 4
    e = forest(a, b, weight, 40)

    def joined(edges):
        comp = list(range(40))
        for x, y in edges:
            comp = [comp[x] if c == comp[y] else c for c in comp]
        return len(set(comp))

    assert joined(zip(a[e], b[e], strict=True)) == joined(zip(a, b, strict=True)) == 40 - len(e)
    for t in (1.0, 0.75, 0.5):
        heavy, own = weight >= t, weight[e] >= t
        assert joined(zip(a[e][own], b[e][own], strict=True)) == joined(zip(a[heavy], b[heavy], strict=True))


def test_sketch_bounds_the_overlap():
    rng = np.random.default_rng(9)
    sets = [np.unique(ts.mix(rng.integers(0, 900, int(rng.integers(1, 800))).astype(np.uint64))) for _ in range(60)]
    grids = Sketches([sketch(x) for x in sets], np.array([len(x) for x in sets]))
    a, b = np.triu_indices(60, 1)
    bound = grids.overlap(a, b)
    real = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (bound >= real).all()
    whole = np.sort(ts.mix(np.arange(1000, dtype=np.uint64)))
    other = np.sort(np.concatenate([whole[::5], ts.mix(np.arange(5000, 5800, dtype=np.uint64))]))
    close = np.sort(np.concatenate([whole[whole % np.uint64(20) > 1], ts.mix(np.arange(5000, 5100, dtype=np.uint64))]))
    grids = Sketches([sketch(x) for x in (whole, other, close)], np.array([len(whole), len(other), len(close)]))
    real = np.array([len(np.intersect1d(whole, x)) for x in (other, close)])
    bound = grids.overlap(np.array([0, 0]), np.array([1, 2]))
    assert (bound >= real).all() and bound[1] - real[1] < 40
    full = Sketches([bytes([255] * 64)] * 2, np.array([64 * 255 + 100, 64 * 255 + 30]))
    assert full.overlap(np.array([0]), np.array([1])).tolist() == [64 * 255 + 30]


def test_rows_in_any_order(spark):
    """The component is its least doc_id wherever copies stand, in any partition, block by block too."""
    rows = [(d, "three equal texts of a few words", None, None, 0) for d in (5, 3, 9)]
    rng = random.Random(12)
    texts = [" ".join(f"t{t}w{i}" for i in range(60)) for t in range(4)]
    for i in range(240):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
            words[rng.randrange(60)] = f"x{rng.randrange(8)}"
        rows.append((100 + i, " ".join(words), None, None, 0))
    want = plain(rows)
    rng.shuffle(rows)
    got = {r.doc_id: tuple(r)[1:] for r in jaccard_components(spark.createDataFrame(rows, SCHEMA).coalesce(2), block=8).collect()}
    assert got == want and got[5][1] == 3


def test_keys_of_the_same_rows_in_different_blocks(spark):
    """A search of two blocks doesn't stand for one that compares all the same rows."""
    from shelfwise.llm.jaccard_join import _one_of_each

    whole = [(1, r, True, 0) for r in (10, 11, 12, 13)]
    halves = [(2, r, True, 1 + k // 2) for k, r in enumerate((10, 11, 12, 13))]
    again = [(3, r, True, 0) for r in (13, 12, 11, 10)]
    rows = spark.createDataFrame(whole + halves + again, "place long, rep long, q boolean, side int")
    assert sorted(r.place for r in _one_of_each(rows, "place").collect()) == [1, 2]
