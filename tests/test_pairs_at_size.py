"""Pair joins where cells don't keep vectors apart, where many videos are the same, and random projections."""

import math
import random

import numpy as np
import pyarrow as pa

from shelfwise.operators import pairs
from shelfwise.operators.components import connected_components

PRINTS = "library_id string, asset_id long, vec array<double>"


def sphere(n, dim=64, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.sqrt((x * x).sum(1))[:, None]


def test_tiles_lose_no_candidate(monkeypatch):
    monkeypatch.setattr(pairs, "TILE", (7, 19))
    for scale, dim in ((1, 64), (1, 3), (1e-9, 20), (1e9, 20), (1, 40)):
        x = sphere(90, dim) * scale
        y = np.vstack([x[:30] + sphere(30, dim, 2) * 0.1 * scale, sphere(40, dim, 3) * scale])
        if dim == 40:
            y[50] = np.nan  # hides no pair of other vectors
            y[51] = np.inf
        for z, within in ((y, False), (x, True)):
            want = {(i, j) for i in range(len(x)) for j in range(len(z)) if math.dist(x[i], z[j]) < 0.3 * scale and (j > i or not within)}
            got = {(i, j) for e, f in pairs._candidates(x, z, 0.3 * scale, within) for i, j in zip(e.tolist(), f.tolist(), strict=True)}
            assert want <= got and (within or len(want) >= 30)


def test_cells_are_made_only_where_they_pay(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    grid = sphere(600, 16)
    frame = lambda grid: pairs.vectors(spark.createDataFrame([("L", i, v.tolist()) for i, v in enumerate(grid)], PRINTS))
    assert pairs.choose_pivots(frame(grid), 600, 0.3) == {}
    apart = grid * 0.001 + 50 * np.eye(16)[np.arange(600) % 16]
    assert len(pairs.choose_pivots(frame(apart), 600, 0.01)[16]) > 8


def test_a_large_cell_is_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    grid = sphere(400, 8)
    rows = spark.createDataFrame([("L", i, v.tolist()) for i, v in enumerate(grid)], PRINTS)
    homes = pairs.in_cells(pairs.vectors(rows), {}, 0.5)
    found = pairs.cell_pairs(homes, 0.5, ["library_id"])
    want = sorted((i, j) for i in range(400) for j in range(i + 1, 400) if math.dist(grid[i], grid[j]) < 0.5)
    assert sorted((r.a, r.b) for r in found.collect()) == want
    sizes = homes.groupBy("dim").count().first()[1]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sizes == 400 and f"/ {pairs.BLOCKS}" in plan.replace("cast(", "").replace(".0", "")  # 12 blocks and not 100, so 12 copies of a vector


def test_projections_tell_vectors_apart_and_find_close_ones(spark):
    grid = sphere(4_000)
    batch = pa.RecordBatch.from_pydict({"vec": pa.array(grid.tolist(), pa.list_(pa.float64())), "dim": pa.array([64] * 4_000, pa.int32())})
    keys = [k for out in pairs._signed(6, 0.5, 3, 0.12)([batch]) for k in out.column("keys").to_pylist()]
    shared = sum(4_000 - len({k[t] for k in keys}) for t in range(6))
    assert shared < 600  # of 24 000 keys; with one projection a table nearly all were shared
    base, step = sphere(500, seed=4), sphere(500, seed=5) * 0.115
    rows = [("L", i, v.tolist()) for i, v in enumerate(np.vstack([base, base + step]))] + [("M", 5_000, base[0].tolist()), ("L", 5_001, None), ("L", 5_002, [])]
    got = {(r.a, r.b) for r in pairs.lsh_pairs(spark.createDataFrame(rows, PRINTS), 0.12).collect()}
    assert got <= {(i, i + 500) for i in range(500)} and len(got) > 450


def test_same_videos_are_a_star_and_join_what_all_pairs_join(spark):
    pick = random.Random(5)
    kinds = [[[pick.gauss(0, 1) for _ in range(4)] for _ in range(2)] for _ in range(6)]
    kinds += [[[x + 0.1 for x in v] for v in k] for k in kinds[:3]]
    rows = [(pick.choice("LM"), i, f, v) for i in range(120) for f, v in enumerate(pick.choice(kinds)[: pick.choice([1, 2])])]
    rows += [("L", i, 0, v) for i in (200, 201) for v in ([0.0] * 4, [9.0] * 4)]  # an index that repeats
    rows += [("L", i, 0, [math.nan, 0.0, 0.0, 0.0]) for i in (210, 211)] + [("L", i, 0, None) for i in (220, 221)] + [("L", i, 0, [math.inf, 0.0, 0.0, 0.0]) for i in (230, 231)]
    frames = spark.createDataFrame(rows, "library_id string, asset_id long, frame_idx int, vec array<double>")
    parts = lambda df: sorted(map(tuple, connected_components(df).collect()))
    links = pairs.keyframe_links(frames, connected_components)
    want = pairs.keyframe_pairs(frames)
    assert parts(links) == parts(want)
    assert 2 * links.count() < want.count()
