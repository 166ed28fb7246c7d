import random
from collections import Counter
from fractions import Fraction

import pytest

from shelfwise.llm.mixing import one_period, runs, schedule, shares, tempered, timetable
from tests.llm.helpers import SCHEMA, frame


@pytest.mark.parametrize("seed", range(5))
def test_no_source_is_a_block_away(seed):
    rng = random.Random(seed)
    share = shares({f"s{i}": rng.random() + 0.01 for i in range(rng.randint(1, 30))}, 500)
    plan = sorted(one_period(share), key=lambda x: x[4])
    assert [x[4] for x in plan] == list(range(500)) and all(r <= t < d for _, _, r, d, t in plan)
    done = Counter()
    for t, (s, *_) in enumerate(plan, 1):
        done[s] += 1
        assert all(abs(done[k] - share[k] * t / 500) < 1 for k in share)


def test_every_document_has_its_place(spark):
    rng = random.Random(0)
    rows = [(i, "t", None, rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(900)]
    got = schedule(frame(spark, rows), {"a": 0.5, "b": 0.25, "c": 0.15, "": 0.1}, block=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    assert len({r.position for r in got}) == 900
    assert all(r.release <= r.slot < r.deadline and r.slot == r.position // 4 for r in got)
    mix = [r for r in got if r.in_mix]
    last = max(r.slot for r in mix) + 1
    blocks = Counter((r.source) for r in {(r.source, r.slot): r for r in mix}.values())
    share = shares({"a": 0.5, "b": 0.25, "c": 0.15, "": 0.1})
    assert sum(blocks.values()) == last
    assert all(abs(blocks[s] - share[s] * last / 1000) < 1 for s in share)


def test_odd_rows(spark):
    assert schedule(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "t", None, None, 1), (1, "t", None, None, 1), (None, None, None, "x", 1)]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as j", "3 as h", "4 as run")
    got = schedule(clash).collect()
    assert len(got) == 3 and len({r.position for r in got}) == 3


def test_more_sources_than_slots(spark):
    rows = [(i, "t", None, f"s{i % 1500}", 1) for i in range(3_000)]
    got = schedule(frame(spark, rows)).collect()
    assert len({r.position for r in got}) == 3_000


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"hot": 0.5} | {f"s{i}": 0.5 / 19 for i in range(19)}, {"a": 0.9997, "rare": 0.0003}])
def test_given_weights_hold_over_many_slots(spark, weights):
    n = 20_000
    rows = [(i, "t", None, s, 1) for i, s in enumerate(s for s, w in weights.items() for _ in range(round(n * w) or 1))]
    got = schedule(frame(spark, rows), weights, block=1).collect()
    assert sorted(r.slot for r in got) == list(range(len(rows)))
    total, done = sum(Fraction(str(w)) for w in weights.values()), Counter()
    for t, r in enumerate(sorted((r for r in got if r.in_mix), key=lambda r: r.slot), 1):
        done[r.source] += 1
        assert abs(done[r.source] - Fraction(str(weights[r.source])) / total * t) < 1
    assert t > n * 0.9 and all(abs(done[s] - Fraction(str(w)) / total * t) < 1 for s, w in weights.items())


@pytest.mark.parametrize("seed", range(4))
def test_weights_of_those_left_hold_after_a_source_runs_out(seed):
    rng = random.Random(seed)
    blocks = {f"s{i}": rng.randint(1, 400) for i in range(rng.randint(2, 9))} | {"tiny": 1}
    weights = {s: rng.choice([0.1, 0.25, 1.5, 3]) for s in blocks}
    fluid, at, left = dict.fromkeys(blocks, Fraction(0)), Fraction(0), dict(blocks)
    plan = list(timetable(blocks, weights))
    assert [x[4] for x in plan] == list(range(sum(blocks.values()))) and Counter(x[0] for x in plan) == blocks
    done = Counter()
    for t, (s, j, release, deadline, slot) in enumerate(plan, 1):
        assert j == done[s] and release <= slot < deadline
        done[s] += 1
        while at < t:  # the even share, source by source until the next one runs out
            active = {k: Fraction(str(weights[k])) for k in left if fluid[k] < blocks[k]}
            total = sum(active.values())
            step = min([t - at, *((blocks[k] - fluid[k]) * total / w for k, w in active.items())])
            for k, w in active.items():
                fluid[k] += step * w / total
            at += step
        assert all(abs(done[k] - fluid[k]) < 1 for k in blocks)


def plain_timetable(blocks, weights):
    """Shares flow evenly, block by block; every slot goes to the waiting block whose time is up first."""
    times = {}
    left, clock, had = {s: Fraction(n) for s, n in blocks.items() if n}, Fraction(0), {s: Fraction(0) for s in blocks}
    while left:
        total = sum(Fraction(str(weights[s])) for s in left)
        rate = {s: Fraction(str(weights[s])) / total for s in left}
        step = min(left[s] / rate[s] for s in left)
        for s in left:
            j = had[s].__ceil__()
            while j <= had[s] + step * rate[s]:
                times.setdefault((s, j), clock + (j - had[s]) / rate[s])
                j += 1
            had[s] += step * rate[s]
        left = {s: left[s] - step * rate[s] for s in left}
        left = {s: x for s, x in left.items() if x > 0}
        clock += step
    todo = {s: 0 for s in blocks if blocks[s]}
    out = []
    for slot in range(sum(blocks.values())):
        able = [(times[s, j + 1].__ceil__(), s, j) for s, j in todo.items() if times[s, j].__floor__() <= slot]
        deadline, s, j = min(able)
        out.append((s, j, times[s, j].__floor__(), deadline, slot))
        todo[s] += 1
        if todo[s] == blocks[s]:
            del todo[s]
    return out


def test_timetable_equals_plain_version():
    rng = random.Random(3)
    for _ in range(60):
        names = [f"s{i}" for i in range(rng.randint(1, 7))]
        blocks = {s: rng.randint(1, 30) for s in names}
        weights = {s: rng.choice([0.1, 0.25, 1, 2, 3.5, 7]) for s in names}
        assert list(timetable(blocks, weights)) == plain_timetable(blocks, weights)


def test_weights_that_are_zero_or_missing(spark):
    blocks = {"a": 4, "b": 4, "c": 3, "d": 2}
    rows = list(timetable(blocks, {"a": 1, "b": 3, "c": 0}))
    assert [r[4] for r in rows] == list(range(13)) and {r[0] for r in rows[:8]} == {"a", "b"} and {r[0] for r in rows[8:]} == {"c", "d"}
    assert all(release <= slot < deadline for _, _, release, deadline, slot in rows)
    with pytest.raises(ValueError):
        list(timetable(blocks, {"a": -1, "b": 1}))
    docs = spark.createDataFrame([(i, "x", None, "abcd"[i % 4], 1) for i in range(200)], SCHEMA)
    got = schedule(docs, {"a": 1, "b": 3, "c": 0}, block=4).collect()
    assert len(got) == 200 and max(r.position for r in got if r.source in "ab") < min(r.position for r in got if r.source in "cd")
    assert not any(r.in_mix for r in got if r.source in "cd")
    assert schedule(docs, {}, block=4).count() == 200


def test_very_many_sources_share_pools(spark):
    rng = random.Random(5)
    rows = [(i, "t", None, rng.choice(["big", "large"]) if i % 2 else f"s{rng.randrange(300)}", 1) for i in range(2_000)]
    for weights in (None, {"big": 2.0, "large": 1.0, "s3": 0.5}):
        got = schedule(frame(spark, rows), weights, block=4, most=20).collect()
        assert sorted((r.doc_id, r.source) for r in got) == [(r[0], r[3]) for r in rows]
        assert len({r.position for r in got}) == len(rows)
        assert all(r.release <= r.slot < r.deadline for r in got)
    mix = [r.source for r in schedule(frame(spark, rows), None, block=1, most=20).collect() if r.in_mix]
    assert len({s for s in mix if s not in ("big", "large")}) > 200


def test_classes_have_the_bounds_of_their_members():
    rng = random.Random(8)
    for _ in range(60):
        names = [f"s{i}" for i in range(rng.randint(1, 6))]
        blocks, members = {s: rng.randint(1, 12) for s in names}, {s: rng.randint(1, 9) for s in names}
        weights = {s: rng.choice([0, 0.1, 0.25, 1, 2, 3.5, 7]) for s in names}
        each = [(s, m) for s in names for m in range(members[s])]
        want = {(s, m, j): (r, d) for (s, m), j, r, d, _ in timetable({k: blocks[k[0]] for k in each}, {k: weights[k[0]] for k in each})}
        got = [(s, member + i, j, r, d, slot + i) for s, j, r, d, slot, member, count in runs(blocks, weights, members) for i in range(count)]
        assert {(s, m, j): (r, d) for s, m, j, r, d, _ in got} == want and len(got) == len(want)
        assert [x[5] for x in got] == list(range(len(got))) and all(r <= slot < d for *_, r, d, slot in got)


def test_very_many_sources_have_their_own_shares(spark):
    rng = random.Random(6)
    rows = [(i, "t", None, rng.choice(["big", "large"]) if i % 2 else f"s{rng.randrange(300)}", 1) for i in range(2_000)]
    supply = Counter(r[3] for r in rows)
    for weights in (None, {"big": 2.0, "large": 1.0, "s3": 0.5} | {f"s{i}": 0.25 for i in range(100, 200)}):
        got = schedule(frame(spark, rows), weights, block=4, most=20).collect()
        blocks, given = {s: -(-n // 4) for s, n in supply.items()}, tempered(supply) if weights is None else weights
        bounds = {(s, j): (r, d) for s, j, r, d, _ in timetable(blocks, given)}
        assert sorted((r.doc_id, r.source) for r in got) == [(r[0], r[3]) for r in rows]
        assert len({r.position for r in got}) == len(rows) and {r.slot for r in got} == set(range(sum(blocks.values())))
        assert all((r.release, r.deadline) == bounds[r.source, r.block] and r.release <= r.slot < r.deadline for r in got)
        assert {r.slot: (r.source, r.block) for r in got}.keys() == {r.slot for r in got} and len({(r.slot, r.source, r.block) for r in got}) == sum(blocks.values())
        one = schedule(frame(spark, rows), weights, block=4).collect()
        assert sum(r.in_mix for r in one) > 0 and {(r.source, r.release, r.deadline, r.block) for r in one} == {(r.source, r.release, r.deadline, r.block) for r in got}
