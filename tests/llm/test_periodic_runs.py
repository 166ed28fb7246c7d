import hashlib
import random
import zlib

import numpy as np

from shelfwise.llm.periodic_runs import collapse_runs, find_runs, runs, seeds, unite
from tests.llm.helpers import SCHEMA, corpus, frame


def plain_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(doc_id, text, edit=True):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if edit and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_equals_plain_version(spark):
    rows = [r for r in corpus(n=120) if len(r[1] or "") < 4000]
    rows += [(9000 + i, " ".join(random.Random(i).choices("ab" if i % 2 else "abc", k=60)), None, None, 0) for i in range(40)]
    got = {r.doc_id: r for r in find_runs(frame(spark, rows), edit=True).collect()}
    many = 0
    for d, t, *_ in rows:
        w = words_of(d, t)
        found = plain_runs(w)
        many += len(found)
        dropped = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == digest(" ".join(x for k, x in enumerate(w) if k not in dropped))
    assert many > 40


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 5, 30, 90]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 4) if n > 10 else 0):
                s, p = rng.randrange(n), rng.randint(1, 12)
                for x in range(s + p, min(n, s + rng.randint(2, 50))):
                    w[x] = w[x - p]
            rows.append(w)
        least = rng.choice([2, 5, 7, 12])
        found = runs(np.array([x for w in rows for x in w], np.int64), np.cumsum([0] + [len(w) for w in rows]), least)
        got = list(zip(*(x.tolist() for x in found), strict=True))
        assert got == [(k, *r) for k, w in enumerate(rows) for r in plain_runs(w, least)]


def test_new_neighbours_of_classes():
    big = [1, 5, 9]
    assert set(unite(big, [2, 3, 7, 12])) == {(1, 2), (3, 5), (5, 7), (7, 9), (9, 12)} and big == [1, 2, 3, 5, 7, 9, 12]
    assert seeds(np.array([0, 2]), np.array([2, 4]), np.array([4, 2])).tolist() == [[0, 2, 4], [2, 4, 2]]


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", None, None, 0), (3, " \n\t", None, None, 0), (None, "a b " * 20, None, None, 0), (4, "a b " * 20, None, None, 0), (4, "a b " * 20, None, None, 0), (5, "x " * 200_000, None, None, 0)]
    got = find_runs(frame(spark, rows, 3)).collect()
    assert sorted((r.n_runs, r.length or 0, r.period or 0) for r in got) == [(0, 0, 0)] * 3 + [(1, 40, 2)] * 3 + [(1, 200_000, 1)]
    assert find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as start", "2 as n_runs", "3 as period")
    assert find_runs(clash).count() == 7
    kept = {r.doc_id: r.text for r in collapse_runs(spark.createDataFrame(rows[:2] + rows[4:], SCHEMA)).collect()}
    assert kept == {1: None, 2: "", 4: "a b", 5: "x"}
