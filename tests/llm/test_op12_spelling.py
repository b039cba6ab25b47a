import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wallscope.llm import op12_spelling as op

SHAPE = "doc_id bigint, text string, n int, word int, root string"


def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def edits(word, alphabet):
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + c + b for a, b in cuts for c in alphabet} | {a + b[1:] for a, b in cuts if b}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in alphabet}) - {word}


def brute(rows):
    words = brute_words(rows)
    alphabet = sorted({c for w in words for c in w})
    form, out = {}, {}
    for word, n in words.items():
        near = [w for w in edits(word, alphabet) if w in words]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= 5 * n else None
        out[word] = [word, form[word], None, n, len(near), words[best] if form[word] else None]
    for row in out.values():
        root = row[0]
        while form[root]:
            root = form[root]
        row[2] = root
    return sorted(map(tuple, out.values()))


def found(spark, rows):
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SHAPE).repartition(3)
    return sorted(map(tuple, op.variants(table).collect()))


def made(seed, words=90, docs=60):
    draw = random.Random(seed)
    parts = ["th", "on", "er", "é", "ñ", "Ö", "an", "re", "sh"]
    stems = ["".join(draw.choice(parts) for _ in range(draw.randint(2, 6))) for _ in range(words)]
    rows = []
    for k in range(docs):
        text = []
        for _ in range(draw.randint(0, 400)):
            w = stems[min(int(draw.expovariate(0.06)), words - 1)]
            if draw.random() < 0.15:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", "e", "x"]) + w[at + draw.randint(0, 1) :]
            text.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((k, draw.choice([" ", ", ", "1", "Ā", "—\n"]).join(text)))
    return rows


EDGES = [
    (None, "Zürich zürich ZÜRICH zürich zürich zürich zürich"), (7, None), (8, ""), (9, "é" * 6), (9, "a" * 500 + " " + "a" * 500),
    (10, ("a" * 500 + "!") * 5), (11, ("a" * 499 + "é×÷ ") * 7), (12, "abcdefĀbcdefg" * 9), (13, "ÿÀÿÀÿÀ" + "×" * 3), (14, "abcdef"), (15, "abcdef abcdef"),
    (16, "chainaaa " * 5 + "chainaab " * 25 + "chainabb " * 125 + "chainbbb " * 625 + "chainbbbb " * 3125),
]


def test_against_brute_force(spark, monkeypatch):
    rows = made(1, docs=120) + EDGES
    for name, value in (("TEXT_BYTES", 900), ("HELD", 40), ("LONG", 14)):
        monkeypatch.setattr(op, name, value)
    expected = brute(rows)
    assert sum(e[1] is not None for e in expected) > 30 and any(e[1] not in (None, e[2]) for e in expected)
    assert found(spark, rows) == expected


def test_many_small_cells_and_tiles(spark, monkeypatch):
    rows = made(2)
    for name, value in (("CELL", 12), ("BLOCK", 5), ("ASKED", 9), ("SAMPLE", 150), ("LEAF", 2)):
        monkeypatch.setattr(op, name, value)
    assert found(spark, rows) == brute(rows)


def test_words_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute_words(docs.select("doc_id", "text").collect())
    assert {r.word: r.n for r in op.vocabulary(docs).collect()} == expected


def test_erased_letters(spark):
    # Documents whose hash deletes a letter of this word.
    ids = [k for k in range(3000) if zlib.crc32(f"{k}:whatever".encode()) % 199 == 0]
    rows = [(k, "Whatever") for k in ids for _ in range(6)] + [(5000 + k, "WHATEVER") for k in range(60)]
    assert len(ids) > 5 and found(spark, rows) == brute(rows)


def test_pairs_of_tree_equal_all_pairs():
    draw = random.Random(3)
    for one, two in ((6, 6), (6, 7), (7, 6)):
        a, b = (sorted({"".join(draw.choice("abcé") for _ in range(n)) for _ in range(400)}) for n in (one, two))
        got = sorted(zip(*(x.tolist() for x in op.near_pairs(a, b))))
        alphabet = "abcé"
        assert got == sorted((i, j) for i, w in enumerate(a) for j, v in enumerate(b) if v in edits(w, alphabet))


def test_tree_reaches_every_leaf_in_range():
    random_ = np.random.default_rng(4)
    counts = random_.integers(0, 4, (300, op.LETTERS)).astype(np.int32)
    counts[:, 5:] = 0
    tree, leaves = op.grow(counts, 6)
    assert sorted(np.concatenate(leaves)) == list(range(300))
    asked = random_.integers(0, 4, (50, op.LETTERS)).astype(np.int32)
    asked[:, 5:] = 0
    for more, less in ((1, 0), (0, 1), (1, 1)):
        reached = {(leaf, r) for leaf, rows in tree.reached(asked, more, less) for r in rows.tolist()}
        for leaf, own in enumerate(leaves):
            gap = counts[own] - asked[:, None]
            near = ((np.maximum(gap, 0).sum(2) <= more) & (np.maximum(-gap, 0).sum(2) <= less)).any(1)
            assert {(leaf, r) for r in np.flatnonzero(near).tolist()} <= reached
    assert len(reached) < 0.8 * 50 * len(leaves)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short words only")]])
def test_nothing_to_group(spark, rows):
    assert found(spark, rows) == []
