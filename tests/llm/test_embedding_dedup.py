import numpy as np

from shelfwise.llm.embedding_dedup import near_duplicates, recall


def vectors(n=900, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    x = [*base, *(base + 0.25 * rng.standard_normal(base.shape)), *(base[: n // 9] * 2.0), *base[: n // 9]]
    x += list(base[0] + 0.02 * rng.standard_normal((300, dim)))  # a dense cluster
    return [(i * 2, [float(v) for v in np.float32(r)], i % 5) for i, r in enumerate(x)]


def plain(rows):
    ids = [i for i, _, _ in rows]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(x)).min(1))
        if (new == label).all():
            return {i: (int(link[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
        label = new


def test_links_against_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    result = near_duplicates(df, shared=1)
    got, want = {r.vec_id: r for r in result.collect()}, plain(rows)
    assert set(got) == set(want) and all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert recall(df, result) >= 0.9
    two = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    assert sum(two.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, nan], 0), (6, [1.0, None], 0), (7, [], 0), (8, [1.0], 0), (9, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (10, [3.0], 1), (11, [-1.0, -0.0], 0), (12, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as size", "2 as rep", "3 as n")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 2, 1, False), (10, 1, 8, False), (11, 1, 11, True), (12, 1, 11, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_many_lengths(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for dim in range(1, 41):
        for k in range(3):
            x = rng.standard_normal(dim) if k < 2 else np.array(rows[-2][1]) * 2.5
            rows.append((dim * 10 + k, [float(v) for v in x], 0))
    for i, a, _ in rows:
        x = np.array(a) / np.linalg.norm(a)
        want[i] = sum(1 for j, b, _ in rows if j != i and len(b) == len(a) and x @ (np.array(b) / np.linalg.norm(b)) >= 0.95)
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == want
