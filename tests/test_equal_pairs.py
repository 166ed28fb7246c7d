"""Joins of a table with itself, whose hot keys are dealt in pairs of blocks."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from shelfwise.operators import contacts, pairs


def plain(rows):
    by_key = {}
    for key, item in rows:
        if key is not None and item is not None:
            by_key.setdefault(key, set()).add(item)
    return sorted((k, a, b) for k, items in by_key.items() for a, b in combinations(sorted(items), 2))


def test_hot_keys_give_the_same_pairs_once(spark):
    pick = random.Random(3)
    rows = [("hot", i) for i in range(150)] + [("warm", i) for i in range(40, 57)] + [(f"k{pick.randrange(30)}", i) for i in range(100)]
    rows = list(dict.fromkeys(rows)) + [("hot", None), (None, 1), (None, 2), ("alone", 5)]
    df = spark.createDataFrame(pick.sample(rows, len(rows)), "k string, item long")
    for block in (4, 16, 4_096):
        assert sorted(map(tuple, pairs.equal_pairs(df, ["k"], "item", block).collect())) == plain(rows)
    assert pairs.equal_pairs(df.where("false"), ["k"], "item", 4).count() == 0


def test_structs_are_items_too(spark):
    rows = [("L", (i, -i)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, item struct<id: long, h: long>")
    got = pairs.equal_pairs(df, ["k"], "item", 4).select("a.id", "b.id").collect()
    assert sorted(map(tuple, got)) == list(combinations(range(30), 2))


def test_a_number_that_many_share_is_many_even_tasks(spark):
    df = spark.range(20_000).select(F.lit("L").alias("k"), F.col("id").alias("item"))
    found = pairs.equal_pairs(df, ["k"], "item", 2_000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "i_" in plan and "j_" in plan  # pairs of blocks are keys of the join
    sizes = [r.n for r in found.withColumn("cell", F.array_sort(F.array(F.pmod(F.xxhash64("a"), F.lit(10)), F.pmod(F.xxhash64("b"), F.lit(10))))).groupBy("cell").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_000 * 19_999 // 2 and len(sizes) == 55
    assert max(sizes) < 0.03 * sum(sizes)


def test_shared_numbers(spark):
    rows = [("L", 1, ["5", "6"]), ("L", 2, ["6", "5"]), ("L", 3, ["6"]), ("M", 4, ["6"]), ("L", 5, []), ("L", 6, None)]
    df = spark.createDataFrame(rows, "library_id string, contact_id long, phones array<string>")
    assert sorted(map(tuple, contacts.phone_pairs(df).collect())) == [("L", 1, 2), ("L", 1, 3), ("L", 2, 3)]


def test_hashes_against_all_pairs(spark):
    pick = random.Random(4)
    base = [pick.getrandbits(63) for _ in range(4)]
    rows = []
    for i in range(120):
        h = pick.choice(base)
        for _ in range(pick.randrange(5)):
            h ^= 1 << pick.randrange(63)
        rows.append((pick.choice("LM"), i, h))
    rows += [("L", 200, None), ("L", 3, rows[3][2])]
    df = spark.createDataFrame(rows, "library_id string, asset_id long, dhash long")
    seen = {(r[0], r[1]): r[2] for r in rows if r[2] is not None}
    want = sorted({(p[0], a, b) for (p, x), (q, y) in combinations(sorted(seen.items(), key=lambda e: e[0][1]), 2) if p[0] == q[0] and bin(x ^ y).count("1") <= 3 for a, b in [sorted((p[1], q[1]))]})
    assert sorted(set(map(tuple, pairs.all_hash_pairs(df).collect()))) == want
