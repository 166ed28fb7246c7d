import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfwise.llm.mixing import schedule
from tests.llm.helpers import frame
from tests.llm.test_decontaminate import plain as contaminated
from tests.llm.test_jaccard_join import plain as components

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: tuple(r) for r in df.collect()}


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in P.STAGES][0] == "language ID" and len(P.STAGES) == 5
    before = rows(docs)
    one = P.language_id(spark, docs, SF)
    got = rows(one)
    assert one.columns == docs.columns and set(got.values()) <= set(before.values()) and len(got) >= 0.97 * len(before)
    two = P.jaccard_join(spark, one, SF)
    want = {d for d, (_, c) in components([(d, r[1]) for d, r in got.items()]).items() if d == c}
    assert set(rows(two)) == want and two.columns == docs.columns
    three = P.decontamination(spark, two, SF)
    bad = {d for d, v in contaminated([(d, r[1]) for d, r in rows(two).items()], bench).items() if v[3]}
    assert set(rows(three)) == want - bad and three.columns == docs.columns
    four = P.mixing(spark, three, SF)
    kept = rows(four)
    assert four.columns == docs.columns and set(kept.values()) <= set(rows(three).values())
    five = {r.doc_id: r for r in P.token_output(spark, four, SF).collect()}
    plain, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for d in sorted(kept):
        n = len(plain.encode(kept[d][1] or "", add_special_tokens=False).ids) + 1
        assert (five[d].start, five[d].n_tokens) == (at, n)
        at += n
    assert len(five) == len(kept)


def test_run_applies_all_stages(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert np.diff(sorted(r.start for r in out.collect())).min() > 0


def test_token_files_are_in_the_order_of_the_mix(spark):
    got = [r.doc_id for r in P.run(spark, SF).orderBy("start").collect()]
    kept = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id in ({','.join(map(str, got))})")
    assert got == [r.doc_id for r in schedule(kept).orderBy("position").collect()] and got != sorted(got)


def test_mixing_is_an_order_that_keeps_every_row(spark):
    rows = [(i, f"t{i}", None, f"s{i % 20}", 1) for i in range(40_000)] + [(90_000, "t", None, None, 1), (None, "u", None, "s1", 1), (None, "v", None, "s2", 1), (7, "w", None, "s3", 1)]
    docs = frame(spark, rows)
    got = [tuple(r) for r in P.mixing(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    at = {}
    for r in schedule(docs).collect():
        at[r.doc_id] = min(r.position, at.get(r.doc_id, r.position))
    order = [at[r[0]] for r in got]
    assert order == sorted(order)


ODD = [
    (1, None, "en", "s", 0), (2, "", None, None, None), (3, "  \n ", "en", "s", 1), (4, "12 34 !!", "en", "s", 1), (None, "the words of a text", "en", "s", 1), (None, None, None, None, None),
    (5, "the words of a text that is here twice", "en", "s", 1), (5, "the words of a text that is here twice", "en", "s", 1), (6, "The words of a text that is here TWICE", "fr", "t", 1), (7, "le mot " * 30_000, "fr", None, 1), (8, "x" * 300_000, "en", "s", 1),
    *((100 + i, f"the words of text number {i} are these and a few others", "en", f"s{i % 3}", 1) for i in range(30)), *((200 + i, f"les mots du texte {i} sont ici et la avec le reste", "fr", "t", 1) for i in range(30)),
]


def test_odd_rows_in_every_stage(spark):
    docs = frame(spark, ODD).selectExpr("*", "1 as position", "2 as rep", "3 as at", "4 as lang_pred")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    one = P.language_id(spark, docs, SF)
    assert one.columns == docs.columns and {r[0] for r in ODD} - {r.doc_id for r in one.collect()} <= {1, 2, 3, 4}
    two = P.jaccard_join(spark, docs, SF)
    kept = [r.doc_id for r in two.collect()]
    assert two.columns == docs.columns and kept.count(5) == 1 and 6 not in kept and kept.count(None) == sum(r[0] is None for r in ODD) and {1, 2, 3, 4, 7, 8} <= set(kept)
    three = P.decontamination(spark, docs, SF)
    assert three.columns == docs.columns and key(three) == key(docs)
    four = P.mixing(spark, docs, SF)
    assert four.columns == docs.columns and key(four) == key(docs)
    five = P.token_output(spark, docs, SF).collect()
    assert len(five) == len(ODD) and {r.n_tokens for r in five if r.doc_id in (1, 2)} == {1}


def test_empty_tables_in_every_stage(spark):
    none = frame(spark, ODD).limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, none, SF)
        assert out.columns == none.columns and out.count() == 0, name
    assert P.STAGES[-1][1](spark, none, SF).count() == 0
