"""Groups that grow batch by batch equal a scan of everything."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import incremental, pairs
from shelfwise.operators.components import connected_components, extend_components

T0 = dt.datetime(2024, 5, 1)
PRINTS = "library_id string, asset_id long, creation_date timestamp_ntz, vec array<float>"


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def parts(pairs_):
    """Components of pairs, plainly."""
    name = {x: x for p in pairs_ for x in p}
    for _ in name:
        for a, b in pairs_:
            name[a] = name[b] = min(name[a], name[b])
    return name


def table(spark, path):
    return {r.asset_id: r.component for r in incremental.labels(spark, path).collect()}


def test_components_grow(spark):
    rng = random.Random(8)
    every = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(45)]
    known = spark.createDataFrame([], "id long, component long")
    for k in range(0, 45, 23):
        add = extend_components(known, spark.createDataFrame([*every[k : k + 23], (None, 3)], "a long, b long"))
        known = known.union(add)
        got = {r.id: r.component for r in known.groupBy("id").agg(F.min("component").alias("component")).collect()}
        assert got == parts(every[: k + 23])
    assert extend_components(known, spark.createDataFrame(every, "a long, b long")).count() == 0  # nothing new, nothing written


def test_only_touched_components_are_written(spark):
    known = spark.createDataFrame([(i, i - i % 10) for i in range(100)], "id long, component long")
    got = extend_components(known, spark.createDataFrame([(27, 200), (200, 45)], "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(200, 20), *[(i, 20) for i in range(40, 50)]}
    got = extend_components(known, spark.createDataFrame([(33, -1)], "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(-1, -1), *[(i, -1) for i in range(30, 40)]}


def prints(rng, n):
    """Chains of close vectors in two libraries, some of equal vectors, with odd rows."""
    rows = []
    for i in range(n):
        at = [rng.randint(0, 12) * 0.12, rng.choice([0.0, 5.0]), 0.0]
        rows.append((rng.choice("LM"), i, T0 + dt.timedelta(minutes=rng.randint(0, 90)), at))
    return [*rows, ("L", n, None, None), ("L", n + 1, T0, []), ("M", n + 2, T0, [0.0, None, 0.0]), (None, n + 3, T0, [0.0, 5.0, 0.0]), ("L", n + 4, T0, [1.0])]


@pytest.mark.parametrize("seed", [2])
def test_any_split_equals_the_full_scan(spark, monkeypatch, seed):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    rng = random.Random(seed)
    rows = prints(rng, 60)
    rng.shuffle(rows)
    cuts = sorted(rng.choices(range(len(rows) + 1), k=2))
    path, other = folder(), folder()
    for no, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        new = spark.createDataFrame(rows[lo:hi], PRINTS)
        incremental.near_step(new, path, no, 0.15)
        incremental.similar_step(new.where("size(vec) = 3"), other, no, 0.15)
    every = spark.createDataFrame(rows, PRINTS)
    near = {r.id: r.component for r in connected_components(pairs.pivot_pairs(every, 0.15)).collect()}
    assert near and table(spark, path) == near
    similar = {r.id: r.component for r in connected_components(pairs.bucket_pairs(every.where("size(vec) = 3"), 0.15)).collect()}
    assert similar and table(spark, other) == similar


def test_a_late_picture_bridges_two_groups(spark):
    at = lambda i, x: ("L", i, T0, [x, 0.0])
    path = folder()
    incremental.near_step(spark.createDataFrame([at(1, 0.0), at(2, 0.1), at(5, 0.4), at(6, 0.5), at(9, 7.0), at(10, 7.1)], PRINTS), path, 0, 0.16)
    assert table(spark, path) == {1: 1, 2: 1, 5: 5, 6: 5, 9: 9, 10: 9}
    late = spark.createDataFrame([at(20, 0.25)], PRINTS)
    incremental.near_step(late, path, 1, 0.16)
    want = {1: 1, 2: 1, 5: 1, 6: 1, 20: 1, 9: 9, 10: 9}
    assert table(spark, path) == want
    incremental.near_step(late, path, 1, 0.16)  # a batch done again
    assert table(spark, path) == want
    incremental.near_step(spark.createDataFrame([], PRINTS), path, 2, 0.16)
    assert table(spark, path) == want


def test_cells_that_nothing_reaches_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    path = folder()
    rows = [("L", i, T0, [float(100 * (i % 20)), i * 1e-4]) for i in range(160)]
    incremental.near_step(spark.createDataFrame(rows, PRINTS), path, 0, 0.1)
    new = pairs.vectors(spark.createDataFrame([("L", 900, T0, [300.0, 0.0])], PRINTS))
    _, dealt, pivots = incremental._generation(spark, path, 1)
    known = spark.read.parquet(f"{path}/cells/gen=0")
    near = incremental.reached(known, pairs.in_cells(new, pivots, 0.1, every=True).where("guest"))
    assert dealt == 160 and sum(map(len, pivots.values())) > 5
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString()
    assert 8 <= near.count() < 80 and near.where("vec[0] = 300").count() == 8
