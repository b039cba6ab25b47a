import os
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_op5_minhash, test_op10_repeats
from wallscope.llm import op2_mixture, op4_quality
from wallscope.llm.queries import TOKENIZER
from wallscope.session import scratch_root

SF_DIR = "/root/testdata/sf0.001"


def removed(rows):
    """Kept bytes of each text by brute force."""
    length = test_op10_repeats.L
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = {q for p in range(len(t) - length + 1) if count[t[p : p + length]] > 1 for q in range(p, p + length)}
        yield bytes(b for q, b in enumerate(t) if q not in gone)


def test_each_stage_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert len(stages) == 5

    before, after = out["quality classifier"]
    scored = op4_quality.classify(before, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.doc_id for r in scored if r.kept} and 0 < len(kept) < len(scored)

    before, after = out["MinHash near-dedup"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    want = {line for line in test_op5_minhash.expected(rows) if line.endswith("True)")}
    assert {r.doc_id for r in after.collect()} == {int(line[1:].split(",")[0]) for line in want}

    before, after = out["suffix-array dedup"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    want = {i: raw.decode("utf-8", "ignore") for (i, _), raw in zip(rows, removed(rows))}
    assert {r.doc_id: r.text or "" for r in after.collect()} == want
    assert all(r.n_chars == len(r.text or "") for r in after.collect())

    before, after = out["source mixture"]
    counts = {r.row.doc_id: r.n_copies for r in op2_mixture.copies(before, op2_mixture.rates(before)).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in counts.items() if n})

    before, after = out["BPE tokens"]
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in after.collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rate string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns[-1] == "rate"
    assert corpus_pipeline.tokens(spark, docs, SF_DIR).count() <= 2 * len(rows) + 5


def test_run_leaves_its_result_only(spark, monkeypatch):
    made = []
    path = corpus_pipeline.scratch_path
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda *a: made.append(path(*a)) or made[-1])
    before = set(os.listdir(scratch_root(spark)))
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 0 and rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"]
    assert set(os.listdir(scratch_root(spark))) - before == {made[-1].rsplit("/", 1)[1]}
