import random
import re

import pytest

from shelfwise.llm import decontaminate as D
from tests.llm.helpers import SCHEMA, corpus, frame


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(rows, items):
    windows = [(i, words(t)) for i, t in items if t is not None and i is not None]
    windows = [(i, w[k : k + 13]) for i, w in windows if w for k in range(max(1, len(w) - 12))]
    out = {}
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for i, win in windows:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(i))
        out[d] = (len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def data():
    rng = random.Random(3)
    rows = corpus()
    items = [(i, r[1][:200]) for i, r in enumerate(rows) if r[1] and len(r[1]) > 100][:12]
    items += [(100, "Short One!"), (101, "short one"), (102, ""), (103, None), (None, "short one"), (100, "Short One!"), (104, rows[-1][1][500:700])]
    rows += [(9_000 + i, f"{rng.random()} short, ONE; {t[:90]} ünd mehr", None, None, 0) for i, (_, t) in enumerate(items[:4])]
    rows += [(9_100, rows[-1][1] + " x" * 900, None, None, 0)]
    return rows, items


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 700])
def test_equals_plain_version(spark, limit):
    rows, items = data()
    got = D.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    want = plain(rows, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == want
    assert any(v[3] for v in want.values()) and any(v[1] and not v[3] for v in want.values())


def test_removal(spark):
    rows, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, v in plain(rows, items).items() if v[3]}
    kept = D.decontaminate(frame(spark, rows), bench)
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] not in bad}
    cut = {r.doc_id: r.text for r in D.decontaminate(frame(spark, rows), bench, remove="spans").collect()}
    assert len(cut) == len(rows) and all(cut[r[0]] == r[1] for r in rows if r[0] not in bad)
    again = plain([(d, t) for d, t in cut.items() if d in bad], items)
    assert sum(v[1] for v in again.values()) < sum(v[1] for d, v in plain(rows, items).items() if d in bad)


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    rows = [(1, "Alpha, beta", None, None, 0), (1, "Alpha, beta", None, None, 0), (None, "alpha beta", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0)]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as hits", "2 as items", "3 as n_words")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in D.contamination(clash, bench).collect())
    assert got == [(0, 2, 2, True), (1, 2, 2, True), (1, 2, 2, True), (2, 0, 0, False), (3, 0, 0, False)]
    assert D.contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert D.contamination(clash, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 200])
def test_slices_are_judged_together(spark, limit):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bcdfg", k=9))
    items = [(i, " ".join(word() for _ in range(13))) for i in range(12)]
    far = [" ".join(word() for _ in range(200)) for _ in range(3)]
    rows = [(i, f"{far[0]} {items[i][1]} {far[1]} {items[i + 6][1]} {far[2][:190]}", "en", "s", 1) for i in range(6)]  # 13 words are too few alone, 26 are enough
    rows += [rows[0], (None, rows[1][1], "en", "s", 1), (50, far[0] + " " + items[3][1] + " " + far[1], "en", "s", 1), (51, None, "en", "s", 1), (52, items[0][1] + " x", "en", "s", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain([(i, r[1]) for i, r in enumerate(rows)], items)
    assert want[0][3] and not want[8][3]
    got = D.contamination(frame(spark, rows), bench, limit=limit).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == sorted((str(r[0]), *want[i]) for i, r in enumerate(rows))
    kept = D.decontaminate(frame(spark, rows), bench, limit=limit)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for i, r in enumerate(rows) if not want[i][3]), key=str)
    cut = D.decontaminate(frame(spark, rows), bench, remove="spans", limit=limit)

    def without(i, text):
        for _, t in items if want[i][3] else []:
            text = text.replace(t, " " * 12)
        return text

    assert sorted(map(tuple, cut.collect()), key=str) == sorted(((r[0], without(i, r[1]), *r[2:]) for i, r in enumerate(rows)), key=str)
