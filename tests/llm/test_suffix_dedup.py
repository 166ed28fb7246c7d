import hashlib
import random

import numpy as np
import pytest

from shelfwise.llm.suffix_dedup import common_prefixes, dedup_substrings, suffix_array
from tests.llm.helpers import SCHEMA, corpus, frame


def plain(rows, length=100):
    seen, out = {}, {}
    for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if seen.setdefault(w, (d, p)) != (d, p):
                gone[p : p + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_orders_all_suffixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choices([1, 2, 3, 200], k=rng.randint(1, 30))) for _ in range(20)] + [b"\x02" * 20] * 2
    text = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
    order = suffix_array(text, 31)
    assert sorted(order.tolist()) == list(range(len(text)))
    raw = text.tobytes()
    tails = [raw[i : raw.index(0, i)] for i in order.tolist()]
    assert tails == sorted(tails)
    shared = common_prefixes(text, order, 5)
    for a, b, k in zip(tails, tails[1:], shared.tolist()[1:], strict=False):
        assert a[: min(k, len(a))] == b[: min(k, len(b))]


def test_equals_plain_version(spark):
    rows = corpus()
    got = {r.doc_id: tuple(r)[1:] for r in dedup_substrings(frame(spark, rows)).collect()}
    assert got == plain(rows)
    assert sum(v[1] for v in got.values()) > 0


def test_short_strings_and_pieces(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 300))), None, None, 0) for i in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in dedup_substrings(frame(spark, rows), length=30, gram=8).collect()}
    assert got == plain(rows, 30)


def test_odd_rows(spark):
    long = "wörter und mehr " * 20
    rows = [(1, long, None, None, 0), (1, long, None, None, 0), (None, long, None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0)]
    got = sorted(tuple(r) for r in dedup_substrings(frame(spark, rows, 2)).collect())
    assert [r[0] for r in got] == [1, 1, 2, 3]
    assert got[0] == got[1] and got[0][1:] == plain(rows[:1])[1]
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bucket", "2 as lo", "3 as h")
    assert dedup_substrings(clash).count() == 4


def test_passage_in_very_many_surroundings(spark):
    """One anchor with very many different runs: its pieces are dealt in parts and meet again."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefghij klmnop", k=130))
    word = lambda k: "".join(rng.choices("qrstuvwxyz ", k=k))
    rows = [(i * 7 % 1501, word(rng.randint(0, 40)) + passage[rng.randrange(9) : 130 - rng.randrange(9)] + word(rng.randint(0, 40)), None, None, 0) for i in range(1500)]
    want = plain(rows)
    assert sum(v[1] > 0 for v in want.values()) > 1400
    for most in (16, 4096):
        got = {r.doc_id: tuple(r)[1:] for r in dedup_substrings(frame(spark, rows), most=most).collect()}
        assert got == want
