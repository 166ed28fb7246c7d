import tempfile
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfwise.llm import textscan as ts
from shelfwise.llm.token_files import Encoder, lookup, read_token_files, token_index, write_token_files
from tests.llm.helpers import SCHEMA, corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", " lead", "trail ", "x  y", "a 　b", "  q r", "né à", "don't we'll  go", "<|endoftext|> x <|endoftext|>", "tab\t x\n y  \n\nz", "中文 字 符", "🙂 🙂🙂", "\x7f x \x01 y", "a\u0085 b", "", "   ", "12 34 5a"]


def test_encoder_equals_the_library():
    import pyarrow as pa

    texts = ODD + [t for _, t, *_ in corpus() if t]
    buf, offs = ts.text_parts(pa.array(texts))
    ids, count = Encoder(PATH)(buf, offs)
    want = [[*e.ids, 0] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    at = np.append(0, np.cumsum(count))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


def test_round_trip(spark):
    rows = [*corpus(), *[(10_000 + i, t, None, None, 0) for i, t in enumerate(ODD)], (20_000, None, None, None, 0)]
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    write_token_files(frame(spark, rows), path, PATH)
    plain = Tokenizer.from_file(PATH)
    at, want = 0, {}
    for d, t, *_ in sorted(rows):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want[d] = (at, ids)
        at += len(ids)
    assert {r.doc_id: (r.start, r.ids) for r in read_token_files(spark, path).collect()} == want
    index = {d: (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, (s, x) in want.items()}
    assert {r.doc_id: tuple(r)[1:] for r in token_index(spark, path).collect()} == index
    assert {r.doc_id: (r.start, r.ids) for r in lookup(spark, path, [3, 10_002]).collect()} == {d: want[d] for d in (3, 10_002)}


def test_odd_rows(spark):
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    write_token_files(spark.createDataFrame([], SCHEMA), path, PATH)
    assert token_index(spark, path).count() == 0
    rows = [(1, "a b", None, None, 0), (1, "a b", None, None, 0), (None, "x", None, None, 0)]
    write_token_files(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as data"), path + "2", PATH)
    got = sorted((r.doc_id or 0, r.start, r.n_tokens) for r in token_index(spark, path + "2").collect())
    assert got == [(0, 0, 2), (1, 2, 3), (1, 5, 3)]
