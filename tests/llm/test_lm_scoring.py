import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from shelfwise.llm import attention as net
from shelfwise.llm.lm_scoring import PIECE_WINDOWS, _cut, _windows, decoded, lm_scores, score_ids
from shelfwise.llm.subwords import subwords
from tests.llm.helpers import SCHEMA, corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(rows):
    counts = Counter(w for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 10 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {d: (zlib.crc32(str(d).encode()) % 10 == 0, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for d, t, *_ in rows if d is not None}


def test_base_score_equals_plain_version(spark):
    rows = corpus(n=90)
    got = {r.doc_id: r for r in lm_scores(frame(spark, rows), PATH).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for d, w in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def small(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 6_000)
    voc = net.vocabulary(counts, net.cluster(counts, rng.random((net.TOP, 8)), rng.random((net.TOP, 8))), 7)
    net.set_pairs(voc, rng.integers(0, 3, (net.TOP, net.BEFORE)))
    net.set_fine(voc, rng.integers(0, 3, (net.NEXT, net.LAST * net.EARLIER)))
    there = np.bincount(voc.cls, minlength=net.CLASSES) > 0
    net.set_after(voc, rng.integers(0, 9, (net.CONTEXTS, net.CLASSES)) * there)
    return voc, net.fresh(seed), rng


def test_probabilities_sum_to_one():
    voc, w, rng = small()
    ids = rng.integers(0, 6_000, (1, net.WINDOW))
    every = np.repeat(ids, 6_000, 0)
    targets = np.repeat(np.arange(6_000)[:, None], net.SCORED, 1)
    p = net.log_probs(net.prepared(w, voc), voc, every, targets, np.ones(every.shape, bool))
    assert np.allclose(np.exp(p.astype(np.float64)).sum(0), 1, atol=1e-3)


def test_each_id_is_scored_once_from_what_is_before():
    voc, w, rng = small(1)
    count = np.array([1, 5, 24, 25, 100])
    ids = rng.integers(0, 6_000, int(count.sum()))
    w = net.prepared(w, voc)
    scores = score_ids(w, voc, ids, count)
    at = np.append(0, np.cumsum(count))
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        assert np.isclose(score_ids(w, voc, ids[a:b], count[k : k + 1])[0], scores[k], rtol=1e-4)
        total = 0.0
        for i in range(a, b):  # one window that ends at the id
            base = (i - a) // net.SCORED * net.SCORED - net.CONTEXT
            place = base + np.arange(net.WINDOW)
            there = (place >= 0) & (place <= i - a)
            x = np.where(place > 0, ids[np.clip(a + place - 1, 0, len(ids) - 1)], 7)
            j = i - a - base - net.CONTEXT
            t = np.zeros((1, net.SCORED), int)
            t[0, j] = ids[i]
            total += net.log_probs(w, voc, np.where(there, x, 0)[None], t, there[None])[0, j]
        assert np.isclose(total / math.log(10), scores[k], rtol=1e-4)


def test_prepared_weights_give_the_same_state():
    voc, w, rng = small(3)
    ids, targets = rng.integers(0, 6_000, (4, net.WINDOW)), rng.integers(0, 6_000, (4, net.SCORED))
    there = np.ones(ids.shape, bool)
    there[1, :14] = False
    loss, _ = net.gradients(w, voc, ids, targets, there, there[:, net.CONTEXT :])
    whole = net.log_probs(net.prepared(w, voc), voc, ids, targets, there)
    share = net.shares(voc, targets.ravel(), ids[:, net.CONTEXT :].ravel(), net.earlier(voc, ids, there).ravel()).reshape(targets.shape)
    own = there[:, net.CONTEXT :]
    assert np.isclose(-(whole - share)[own].mean(), loss, rtol=1e-4)


def test_gradients():
    voc, w, rng = small(2)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    ids, targets = rng.integers(0, 6_000, (2, net.WINDOW)), rng.integers(0, 6_000, (2, net.SCORED))
    there = np.ones(ids.shape, bool)
    there[0, :12] = False
    args = (voc, ids, targets, there, there[:, net.CONTEXT :])
    _, g = net.gradients(w, *args)
    for name in "epkvqrobcd":
        i = tuple(rng.integers(0, n) for n in w[name].shape) if name != "e" else (int(voc.row[ids[1, 20]]), 3)
        old = w[name][i]
        w[name][i] = old + 1e-5
        up = net.gradients(w, *args)[0]
        w[name][i] = old - 1e-5
        down = net.gradients(w, *args)[0]
        w[name][i] = old
        assert np.isclose((up - down) / 2e-5, g[name][i], rtol=2e-2, atol=1e-6), name


def test_gradients_of_many_windows():
    voc, w, rng = small(6)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    n = net.BLOCK + 7
    ids, targets = rng.integers(0, 6_000, (n, net.WINDOW)), rng.integers(0, 6_000, (n, net.SCORED))
    there = np.arange(net.WINDOW)[None, :] >= rng.integers(0, 12, n)[:, None]
    scored = there[:, net.CONTEXT :] & (rng.random((n, net.SCORED)) < 0.9)
    loss, g = net.gradients(w, voc, ids, targets, there, scored)
    each = [(scored[i].sum() / scored.sum(), net.gradients(w, voc, *(x[i : i + 1] for x in (ids, targets, there, scored)))) for i in range(n)]
    assert np.isclose(sum(share * part[0] for share, part in each), loss)
    for name in g:
        assert np.allclose(sum(share * part[1][name] for share, part in each), g[name], rtol=1e-6, atol=1e-9), name


def test_arrays_of_a_training_step_do_not_grow_with_it():
    import tracemalloc

    voc, w, rng = small(7)
    windows = rng.integers(0, 6_000, (2_048, net.WINDOW + 1)).astype(np.int32)
    peak = []
    for n in (256, 2_048):
        tracemalloc.start()
        net.fit(w, voc, windows[:n], 0.002, 1, n)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] - peak[0] < 12e6, peak  # not each of the many arrays of all places


def test_long_entries_are_looked_up_where_they_may_start(monkeypatch):
    from shelfwise.llm import textscan as ts

    match, looked, plain_hash = subwords(PATH)._pieces, [], ts.range_hash
    monkeypatch.setattr(ts, "range_hash", lambda sums, starts, ends: looked.append(len(starts)) or plain_hash(sums, starts, ends))
    rng = np.random.default_rng(8)
    junk = rng.choice(np.frombuffer(b"qxzjkvw0123456789", np.uint8), 40_000)
    ids, _ = match(junk, np.arange(0, 40_000, 20), np.arange(20, 40_001, 20))
    assert sum(looked) < 5 * len(ids), (sum(looked), len(ids))
    entries = {subwords(PATH).bytes[a:b].tobytes(): i for i, (a, b) in enumerate(zip(subwords(PATH).offsets[:-1], subwords(PATH).offsets[1:], strict=True))}
    at, want = 0, []
    for start in range(0, 4_000, 20):
        at = start
        while at < start + 20:
            size = next(n for n in range(min(16, start + 20 - at), 0, -1) if junk[at : at + n].tobytes() in entries)
            want.append(entries[junk[at : at + size].tobytes()])
            at += size
    assert ids[: len(want)].tolist() == want


def test_every_id_is_a_training_target_once():
    rng = np.random.default_rng(4)
    each = PIECE_WINDOWS * net.SCORED
    count = np.array([1, 24, 25, 700, each, each + 1, 3 * each + 50])
    ids = rng.permutation(int(count.sum()))
    first, end, lead, h = _cut(ids, count, np.arange(len(count)))
    assert len(set(h.tolist())) == len(h) == 11
    flat = np.concatenate([ids[a:b] for a, b in zip(first, end, strict=True)])
    grid = _windows(flat, end - first, lead, 10**6)
    there, targets = grid[:, net.CONTEXT : -1] >= 0, grid[:, net.CONTEXT + 1 :]
    assert sorted(targets[there & (targets >= 0)].tolist()) == sorted(ids.tolist())
    before = dict(zip(ids[1:].tolist(), ids[:-1].tolist(), strict=True)) | {int(ids[a]): 10**6 for a in np.cumsum(count) - count}
    for row in grid.tolist():  # ids of a window follow one another in the text
        row = row[next(i for i, x in enumerate(row) if x >= 0) :]
        row = row[: next((i for i, x in enumerate(row) if x < 0), len(row))]
        assert all(before[b] == a for a, b in zip(row, row[1:], strict=False))
    # as the windows that are scored
    inputs, scored_ids, _, scored, _ = net.document_windows(ids, count, 10**6)
    pairs = lambda a, b, m: sorted(zip(a[m].tolist(), b[m].tolist(), strict=True))
    assert pairs(inputs[:, net.CONTEXT :], scored_ids, scored) == pairs(grid[:, net.CONTEXT : -1], targets, there & (targets >= 0))


def test_ids_give_back_the_text():
    import pyarrow as pa

    from shelfwise.llm import textscan as ts

    texts = ["a b  c", "", "ñandú <|endoftext|> 中", "\x00\x01 x\n"]
    buf, offs = ts.text_parts(pa.array(texts))
    ids, count = subwords(PATH)(buf, offs, subwords(PATH).size - 1)
    back, at = decoded(PATH, ids.astype(np.int64), count)
    assert [back[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == texts


def test_odd_rows(spark):
    rows = [(1, "a b", None, None, 0), (1, "a b", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (None, "x", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bucket", "2 as n", "3 as h", "4 as unit")
    got = sorted((r.doc_id, r.n_tokens) for r in lm_scores(df, PATH).collect())
    assert got == [(1, 3), (1, 3), (2, 1), (3, 1)]
    assert lm_scores(df.limit(0), PATH).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = lm_scores(spark.createDataFrame([(held, "a b", None, None, 0)], SCHEMA), PATH).first()
    assert only.base_score == 0 and only.n_known == 0 and only.train_tokens == 0
