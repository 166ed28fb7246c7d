import hashlib
import math
import random

import numpy as np

from shelfwise.llm.vector_codes import compress, exact_dots, limbs, nearest, reach

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract in whole numbers, one vector after the other."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = {(n, p): v[p * width : (p + 1) * width] for n, (_, v, _) in enumerate(kept) for p in range(parts)}
    first = sorted(range(len(kept)), key=lambda n: kept[n][0])[:entries]
    books = [[cut[n, p] for n in first] for p in range(parts)]

    def best(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for n in range(len(kept)):
                own[best(cut[n, p], books[p])[0]].append(cut[n, p])
            books[p] = [[sum(c) // len(some) for c in zip(*some, strict=True)] if some else old for some, old in zip(own, books[p], strict=True)]
    out = {}
    for n, (i, _, g) in enumerate(kept):
        found = [best(cut[n, p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), g)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, sum(x[1] for x in out.values() if x[2] == g), digest) for i, (c, e, g) in out.items()}


def test_equals_plain_version(spark):
    rng = random.Random(3)
    rows = [(i * 5, [rng.uniform(-1, 1) for _ in range(32)], rng.choice([0, 1, None])) for i in range(150)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(5)]  # ties
    rows += [(2, None, 1), (3, [None] + [0.1] * 31, 1), (4, [float("nan")] + [0.1] * 31, 1), (6, [float("inf")] * 32, None)]
    rng.shuffle(rows)
    got = {r.vec_id: tuple(r)[1:] for r in compress(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == plain(rows)


def test_limbs_are_exact():
    rng = np.random.default_rng(1)
    for top in (200, 1 << 14, 1 << 27):
        x, y = (rng.integers(-top, top, (40, 4)) for _ in range(2))
        want = np.array([[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in y] for p in x])
        for bits in (None, 5, 9):
            assert np.array_equal(exact_dots(x, y, bits), want)
    x = rng.integers(-(1 << 40), 1 << 40, 50)
    parts = limbs(x, 11)
    assert all(np.abs(p).max() <= 1 << 10 for p in parts) and np.array_equal(sum(p.astype(np.int64) << (11 * k) for k, p in enumerate(parts)), x)
    assert nearest(np.array([[5, 5]]), np.array([[9, 9], [1, 1], [1, 1]]))[0].tolist() == [0]


def test_odd_rows(spark):
    few = [(7, [0.5] * 16, 1), (7, [0.5] * 16, 1), (None, [0.25] * 16, None), (9, [0.5] * 32, 1), (8, [0.5] * 5, 1), (1, [], 1), (2, [3e38] * 16, 2)]
    got = compress(spark.createDataFrame(few, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 2), (False, 7), (False, 7), (False, 9), (True, 0)]
    assert all(r.error >= 0 and len(r.code) == 32 for r in got)
    assert compress(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(few, SCHEMA).selectExpr("*", "1 as dim", "2 as code", "3 as `of`")
    assert compress(clash).count() == 5
    assert reach(64) == 1 << 27
