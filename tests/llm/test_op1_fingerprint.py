import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from wallscope.llm import op1_fingerprint as op
from wallscope.llm import queries


def hashes(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def sketch(text):
    return sorted(hashes(text))[: op.SIZE]


def like(a, b):
    union = sorted({*a, *b})[: op.SIZE]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[1])
    rows.sort(key=lambda r: r[0] if r[0] is not None else -(1 << 64), reverse=True)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        yield (
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch(text), sketch(edited),
            like(sketch(text), sketch(edited)), like(sketch(text), sketch(after)),
        )


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {w[0]: w for w in expected(rows)}
    result = queries.QUERIES["op1_fingerprint"](spark, sf_dir)
    got = {r.doc_id: r for r in result.collect()}
    assert got.keys() == want.keys()
    code = lambda f: " ".join(f"{h & (1 << 64) - 1:x}" for h in f)
    for i, (_, n, sha, own, edited, near_edited, near_next) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, code(own), code(edited))
        assert (r.near_edited, r.near_next) == pytest.approx((near_edited, near_next))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows", [[], [(7, None)], [(1, "a b"), (1, "a b"), (-5, ""), (None, "x y z " * 60_000), (9, "a\x0bb c d e f"), (9, None)]])
@pytest.mark.parametrize("parts", [1, 3, 50])
def test_odd_rows(spark, rows, parts):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, run string")
    got = sorted(map(str, ((r.doc_id, r.text, r.next_text) for r in op.with_next(docs, parts).collect())))
    if None not in [i for i, _ in rows]:
        ordered = sorted(sorted(rows, key=lambda r: r[1] or ""), key=lambda r: -r[0])
        want = [(i, t or "", n or "") for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1])]
        assert got == sorted(map(str, want))
    assert len(got) == len(rows)


def test_merge_containment_and_counts(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    part = " ".join(f"w{i}" for i in range(2500))
    rows = spark.createDataFrame([(1, part), (2, text)], "doc_id long, text string")
    found = op.fingerprints(rows)
    merged = found.agg(op.merge_all(F.col("fingerprint")).alias("m")).first().m
    assert merged == sketch(text)
    both = found.alias("a").join(found.alias("b"), F.expr("a.doc_id = 1 AND b.doc_id = 2")).select(
        op.containment(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("c"),
        op.containment(F.col("b.fingerprint"), F.col("a.fingerprint")).alias("d"),
        op.distinct_count(F.col("b.fingerprint")).alias("n"),
    ).first()
    assert both.c == 1 and both.d == pytest.approx(0.5, abs=0.15) and both.n == pytest.approx(4996, rel=0.3)
