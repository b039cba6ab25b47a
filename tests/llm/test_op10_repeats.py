import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wallscope.llm import op10_repeats as op
from wallscope.llm import queries

L = op.LENGTH


def expected(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[p : p + L] for _, t in texts for p in range(len(t) - L + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int32)
        for p in range(len(t) - L + 1):
            if count[t[p : p + L]] > 1:
                gone[p] += 1
                gone[p + L] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum())
        out.append(str((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def result(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op10_repeats"](spark, sf_dir)) == expected(rows)


def noise(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


@pytest.mark.parametrize("group", [2, 256])
def test_passages_of_all_lengths_and_edits(spark, monkeypatch, group):
    monkeypatch.setattr(op, "GROUP", group)
    monkeypatch.setattr(op, "TASK", 30)
    rng = random.Random(group)
    passages = [noise(rng, n) for n in (390, 399, 400, 401, 500, 900, 1500)]
    rows = []
    for k in range(90):
        parts = [noise(rng, rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(40)
            p = p[cut:] if rng.random() < 0.3 else p
            if rng.random() < 0.3:
                at = rng.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            parts += [p, noise(rng, rng.choice([0, 1, 200]))]
        rows.append((k, "".join(parts)))
    rows += [(200, "ab" * 700), (201, "x" * 401), (202, "y" * 400), (203, noise(rng, 450) * 2), (204, "é" * 150 + "ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(queries.digest(op.cut(docs))) == expected(rows)


def test_planted_passages_on_both_sides_of_the_length(spark):
    """Passages of over 50 words, 300 to 800 bytes, in documents of the given table: only 400 bytes or more count."""
    rng = random.Random(12)
    sf_dir = "/root/testdata/sf0.001"
    rows = [list(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for size in (300, 323, 360, 398, 399, 400, 401, 402, 440, 520, 640, 800):
        passage = ""
        while len(passage) < size:
            passage += noise(rng, rng.randint(3, 7)).replace(" ", "x") + " "
        passage = passage[: size - 1] + "."
        for own in rng.sample(rows, 3):
            text, at = own[1] or "", rng.randrange(len(own[1] or "") + 1)
            own[1] = text[:at] + "|" + passage + "|" + text[at:]
            planted.setdefault(size, []).append(own[0])
    rows = [tuple(r) for r in rows]
    found = queries.digest(op.cut(spark.createDataFrame(rows, "doc_id long, text string"))).cache()
    assert result(found) == expected(rows)
    removed = {r.doc_id: r.n_removed for r in found.collect()}
    assert all(removed[i] >= 400 for size, ids in planted.items() if size >= 400 for i in ids)


def test_odd_rows(spark):
    rng = random.Random(9)
    same = noise(rng, 1000)
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (4, same), (4, same), (5, "ü" + noise(rng, 30_000)), (None, noise(rng, 600))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    assert result(queries.digest(op.cut(docs))) == expected(rows)
    kept = op.remove(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.spans) for r in kept.collect()) == Counter((i, "" if i == 4 else t, "x") for i, t in rows)
    assert op.cut(docs.limit(0)).count() == 0


def test_texts_that_repeat_themselves_at_a_short_distance(spark):
    """One phrase over and over: exact, and without rows for every period."""
    rng = random.Random(4)
    rows = []
    for k, period in enumerate((1, 2, 5, 9, 10, 23, 24, 25, 60, 158, 159, 160, 161, 319, 320, 321, 399, 400)):
        phrase = noise(rng, period)
        many = phrase * (3000 // period + 2)
        # A long run, one of another phase behind other text, and runs of just one string and around it.
        sizes = (3000, 2 * period + 410, 400 + period, 399 + period, 400, 399)
        rows += [(100 * k + j, noise(rng, rng.randrange(90)) + many[rng.randrange(period) :][:n] + "#" * (j % 2)) for j, n in enumerate(sizes)]
        # Another run right behind, of the same distance and of another one.
        rows.append((100 * k + 50, noise(rng, 50) + many[:900] + many[3:1200] + "ab" * 450 + many[:700]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(queries.digest(op.cut(docs))) == expected(rows)

    same = [noise(rng, 300) + "over and over " * 300 + noise(rng, 300) for _ in range(40)]
    found = op._anchored(spark.createDataFrame(list(enumerate(same)), "doc_id long, text string"))
    assert found.where("core IS NULL").count() == 40
    assert found.count() < 40 * 70
