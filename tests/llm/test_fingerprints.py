import hashlib
import re

from shelfwise.llm.fingerprints import ANCHORS, fingerprint_edits, signatures
from shelfwise.llm.queries import SQL
from tests.llm.helpers import SCHEMA, corpus, frame


def signed(text):
    """Signatures by a plain loop over words."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    anchor = [w in ANCHORS or len(w) % 7 == 0 for w in words]
    out = set()
    for i in range(len(words)):
        chain = [w for w, a in zip(words[i + 1 :], anchor[i + 1 :], strict=True) if not a][:3]
        if anchor[i] and chain:
            out.add(hashlib.md5(" ".join(chain).encode()).hexdigest()[:8])
    return sorted(out or ({hashlib.md5(text.lower().encode()).hexdigest()[:8]} if text else set()))


def test_equals_plain_version(spark):
    rows = [(d, t, *rest) for d, t, *rest in corpus(n=80)]
    got = {r.doc_id: r for r in fingerprint_edits(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for (d, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, after, r = t or "", after or "", got[d]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        sets = [set(signed(x)) for x in (t, edited, after)]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(sorted(sets[0])), "".join(sorted(sets[1])))
        for value, other in ((r.near_edited, sets[1]), (r.near_next, sets[2])):
            want = 1.0 if sets[0] == other else len(sets[0] & other) / len(sets[0] | other)
            assert abs(value - want) < 1e-12 or value == 0.0 and want <= 0.02


def test_odd_rows(spark):
    rows = [(5, "the cat sat", None, None, 0), (5, "the cat sat", None, None, 0), (4, None, None, None, 0), (3, "", None, None, 0), (None, "of a thing", None, None, 0), (9, "x" * 300_000 + " the end here", None, None, 0), (7, "\U0001f600é of the sea", None, None, 0)]
    got = fingerprint_edits(frame(spark, rows, 3)).collect()
    assert sorted(((r.doc_id is None, r.doc_id), r.n_chars) for r in got if r.doc_id is not None) == [((False, 3), 0), ((False, 4), 0), ((False, 5), 11), ((False, 5), 11), ((False, 7), 13), ((False, 9), 300_013)]
    assert [r.near_next for r in got if r.doc_id == 4] == [1.0]
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    assert fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprint_edits(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert one[0].near_next == 1.0
    assert fingerprint_edits(spark.createDataFrame(rows[4:5], SCHEMA)).count() == 1
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "true as guest", "2 as signatures", "3 as next_text")
    assert fingerprint_edits(clash).count() == 7


def test_every_document_meets_its_next(spark):
    rows = [((i * 7919) % 10007 - 5000, f"the word{i} sits by itself number{i}", None, None, 0) for i in range(900)]
    docs = frame(spark, rows, 7)
    got = {r.doc_id: r.edited_sha256 for r in fingerprint_edits(docs).collect()}
    order = sorted(rows, reverse=True)
    for (d, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        assert got[d] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    plan = fingerprint_edits(frame(spark, corpus(n=10)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "op11_fingerprints" in SQL and signatures() is not None
