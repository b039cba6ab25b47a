import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wallscope.llm import op3_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "",
    "a" * 3000,
    " " * 999 + "x",
    "<|endoftext|>hi<|endoftext|><|endoftext|> x",
    "it's we'LL  \n\n a\t\tb\x1c\x85 　",
    *("".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 64)),
    *("a" + chr(c) + " b  " + chr(c) * 2 + "1" for c in range(0x3100)),
]


def test_ids_and_texts_equal_the_library():
    bpe, library = op3_bpe.load(PATH), Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    ids, lengths = bpe.encode(TEXTS)
    ends = np.cumsum(np.r_[0, lengths])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    assert bpe.decode(ids, lengths) == [library.decode(w, skip_special_tokens=False) for w in want]
    broken = np.array([want[8][0], bpe.first[0xC3], want[8][0]])
    assert bpe.decode(broken, np.array([3])) == [library.decode(broken.tolist(), skip_special_tokens=False)]


@pytest.mark.parametrize("rows", [[], [(1, None, "x"), (2, "", "y"), (None, "a b", None), (2, "", "y"), (5, "é" * 200_000, "z")]])
def test_operator_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = op3_bpe.decode(op3_bpe.encode(docs, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t or "") for i, t, _ in rows)


@pytest.mark.parametrize("rows", [[], [(i, t) for i, t in enumerate([None, *TEXTS, "é" * 200_000])]])
def test_one_function_equals_both_steps(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    together, apart = op3_bpe.encode_decode(docs, PATH), op3_bpe.decode(op3_bpe.encode(docs, PATH), PATH)
    assert together.schema == apart.schema
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))


def test_a_task_needs_one_worker(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (queries.QUERIES["op3_bpe"](spark, sf_dir), corpus_pipeline.tokens(spark, docs, sf_dir)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in queries.QUERIES["op3_bpe"](spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
