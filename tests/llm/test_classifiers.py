import math
import random
import zlib
from collections import Counter

import numpy as np

from shelfwise.llm import language_crf as L
from shelfwise.llm import quality_knn as Q
from tests.llm.helpers import SCHEMA

STEMS = {"aa": "th er on an re he in ed", "bb": "ung ich sch ver ge ein", "cc": "ción que los ar ado mente"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang].split(), k=rng.randint(1, 4))) for _ in range(n))


def docs(n=900, seed=2):
    rng = random.Random(seed)
    langs = sorted(STEMS)
    return [(i, prose(rng, langs[i % 3], rng.randint(3, 120)), langs[i % 3] if i % 11 else None, "s", 0) for i in range(n)]


def held(i, mod=4, rest=2):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_languages_of_held_out_rows(spark):
    rows = docs()
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    out = [(r[2], got[r[0]].lang_pred) for r in rows if held(r[0]) and r[2]]
    assert np.mean([a == b for a, b in out]) > 0.97


def test_switches_inside_a_text(spark):
    import pyarrow as pa

    from shelfwise.llm import textscan as ts

    model = L.train(spark.createDataFrame(docs(), SCHEMA))
    rng = random.Random(8)
    text = prose(rng, "aa", 20) + " " + prose(rng, "cc", 20)
    p, *_ = L.label_words(model, *ts.text_parts(pa.array([text])))
    names = [model.langs[k] for k in p.argmax(1)]
    assert np.mean([n == "aa" for n in names[:20]]) > 0.85 and np.mean([n == "cc" for n in names[20:]]) > 0.85


def test_forward_backward_equals_all_labelings():
    rng = np.random.default_rng(0)
    e, t, s = rng.standard_normal((2, 4, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    inside = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    gamma, pairs, log_z = L.forward_backward(e, inside, t, s)
    want_pairs = np.zeros((3, 3))
    for c, n in ((0, 4), (1, 2)):
        marginal, total = np.zeros((n, 3)), 0.0
        moves = np.zeros((3, 3))
        for code in range(3**n):
            y = [code // 3**k % 3 for k in range(n)]
            w = math.exp(s[y[0]] + sum(e[c, k, y[k]] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            for k in range(n):
                marginal[k, y[k]] += w
            for k in range(n - 1):
                moves[y[k], y[k + 1]] += w
        assert np.allclose(gamma[c, :n], marginal / total)
        assert np.isclose(log_z[c], math.log(total))
        want_pairs += moves / total
    assert np.allclose(pairs, want_pairs)


def test_odd_languages(spark):
    rows = [*docs(200), (9_001, None, "aa", None, 0), (9_002, "", None, None, 0), (9_003, "12 34 !!", "bb", None, 0), (None, "ther on", "aa", None, 0), (9_004, "中文字", None, None, 0), (9_005, "»… “", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as held_out", "2 as score")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9_001, 9_002, 9_003, 9_005)) and got[None].held_out and got[9_004].lang_pred != "und"
    assert L.identify(df.limit(0)).count() == 0
    none = L.identify(df.withColumn("lang", df.lang.substr(1, 0)).where("false").unionByName(df.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars", "held_out", "score")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    kept = {r.doc_id for r in L.keep_known(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept & {9_001, 9_002, 9_003, 9_005} and len(kept) >= 195


def test_quality_of_held_out_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i, r in enumerate(docs(1_200)):
        bad = i % 6 == 0
        rows.append((i, " ".join(w + "***" for w in r[1].split()) if bad and i % 12 else r[1].upper() + "!!" if bad else r[1], None, None, 0))
        if rng.random() < 0.6:
            labels.append((i, 0 if bad else 1))
    d, l = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classify(d, l).collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    assert np.mean([got[i].predicted == q for i, q in labels if held(i)]) > 0.95


def test_odd_quality(spark):
    rows = [*docs(60), (9_001, None, None, None, 0), (9_002, "", None, None, 0), (None, "x", None, None, 0)]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as quality", "2 as bag")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 7), (4, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classify(d, labels).collect()}
    assert len(got) == 63 and got[9_001].score == got[9_002].score and 0 < got[9_001].score < 1 and got[None].held_out
    assert {r.score for r in Q.classify(d, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(d.limit(0), labels).count() == 0


def test_all_languages_are_learned(spark):
    rng = random.Random(6)
    n = 70
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(8)] for k in range(n)}
    rows = [(i, " ".join(rng.choices(words[f"l{i % n:02}"], k=12)), f"l{i % n:02}", None, 0) for i in range(n * 14)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    right = Counter(r[2] for r in rows if got[r[0]].lang_pred == r[2])
    assert len(got) == len(rows) and len(right) == n and sum(right.values()) > 0.95 * len(rows)


def test_known_documents_stay(spark):
    mixed = [(9_000 + i, " ".join(w for r in docs(40)[i : i + 4] for w in r[1].split()[:9]), None, None, 0) for i in range(9)]
    rows = [*docs(200), *mixed, (9_100, "qqq zzz xxx", None, None, 0), (9_101, "1 2", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    known = {r.doc_id for r in L.identify(df).collect() if r.lang_pred != "und"}
    assert {r.doc_id for r in L.keep_known(df).collect()} == known == {r[0] for r in rows} - {9_101}
    nothing = df.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert L.keep_known(nothing).count() == len(rows)


def test_votes_equal_plain_version_with_ties():
    rng = np.random.default_rng(4)
    base = np.eye(Q.WIDTH, Q.RANK, dtype=np.float32)
    bag = np.zeros((120, Q.WIDTH), np.float32)
    bag[:, : Q.RANK] = rng.integers(0, 2, (120, Q.RANK))
    bag[60:] = bag[:60]  # every voter has a twin, often with another label
    bag[:, 0] += 1
    voters = Q.Voters(np.ones(Q.WIDTH, np.float32), base, np.empty((0, Q.RANK), np.float32), rng.integers(0, 2, 120).astype(float), rng.random(120), 0.3)
    voters.vectors = voters.latent(bag)
    texts = np.zeros((50, Q.WIDTH), np.float32)
    texts[:, : Q.RANK] = rng.integers(0, 2, (50, Q.RANK))
    texts[7] = 0
    got = voters.score(texts)
    cosine = np.round(voters.latent(texts) @ voters.vectors.T, 5)
    for i in range(50):
        if not texts[i].any():
            assert got[i] == 0.3
            continue
        near = sorted(range(120), key=lambda j: (-cosine[i, j], j))[: Q.NEIGHBOURS]
        vote = [max(float(cosine[i, j]), 1e-6) ** Q.SHARPNESS * voters.weight[j] for j in near]
        assert math.isclose(got[i], sum(v * voters.labels[j] for v, j in zip(vote, near, strict=True)) / sum(vote), rel_tol=1e-5)


def test_very_long_texts(spark):
    rng = random.Random(12)
    rows = [*docs(150), (9_500, prose(rng, "bb", 60_000), "bb", None, 0), (9_501, "x" * 2_000_000, None, None, 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in L.identify(d).collect()}
    assert got[9_500].lang_pred == "bb" and 0 <= got[9_501].score <= 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.classify(d, labels).collect())


def test_predictions_equal_plain_version(spark):
    """Word by word, chains of at most CHAIN words, sums over labelings in logarithms."""
    import pyarrow as pa

    from shelfwise.llm import textscan as ts

    rows = docs(240, seed=9)
    rng = random.Random(14)
    rows += [(5_000 + i, " ".join(prose(rng, x, rng.randint(1, 50)) for x in rng.choices(sorted(STEMS), k=4)), None, None, 0) for i in range(25)] + [(6_000, "42 !", None, None, 0), (6_001, "ther", None, None, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = L.train(frame)
    got = {r.doc_id: r for r in L.predict(frame.repartition(3), model).collect()}
    k, total = len(model.langs), lambda x: max(x) + math.log(sum(math.exp(v - max(x)) for v in x))

    def posteriors(e):
        t, s = model.transition.astype(float), model.start.astype(float)
        ahead = [[s[j] + e[0][j] for j in range(k)]]
        for x in e[1:]:
            ahead.append([total([ahead[-1][i] + t[i, j] for i in range(k)]) + x[j] for j in range(k)])
        back = [[0.0] * k]
        for x in e[:0:-1]:
            back.insert(0, [total([t[i, j] + x[j] + back[0][j] for j in range(k)]) for i in range(k)])
        z = total(ahead[-1])
        return [[math.exp(a + b - z) for a, b in zip(p, q, strict=True)] for p, q in zip(ahead, back, strict=True)]

    for d, text, *_ in rows[:40] + rows[240:]:
        buf, offs = ts.text_parts(pa.array([text]))
        starts, ends, _ = ts.words(buf, offs, L.LETTERS)
        if not any(c.isalpha() for c in text):
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
            continue
        sums = ts.prefix_sums(buf)
        each = [model.emissions(*L.features(buf, sums, starts[i : i + 1], ends[i : i + 1]))[0].astype(float).tolist() for i in range(len(starts))]
        every = [p for a in range(0, len(each), L.CHAIN) for p in posteriors(each[a : a + L.CHAIN])]
        mean = [sum(p[j] for p in every) / len(every) for j in range(k)]
        assert got[d].lang_pred == model.langs[mean.index(max(mean))] and abs(got[d].score - max(mean)) < 1e-3
