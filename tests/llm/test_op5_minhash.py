import random
import re

import numpy as np
import pytest

from wallscope.llm import op5_minhash as op
from wallscope.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_value = {}
    for k, (i, s) in enumerate(sets):
        seen = {}
        for v in s:
            for q in by_value.setdefault(v, []):
                seen[q] = seen.get(q, 0) + 1
            by_value[v].append(k)
        for q, both in seen.items():
            if 100 * both >= 75 * (len(s) + len(sets[q][1]) - both):
                a, b = root(i), root(sets[q][0])
                parent[max(a, b)] = min(a, b)
    return sorted(str((i, len(shingles(t)), root(i) if i is not None else None, i is None or root(i) == i)) for i, t in rows)


def result(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert result(queries.QUERIES["op5_minhash"](spark, f"/root/testdata/{sf}")) == expected([tuple(r) for r in docs])


def edited(rng, words, share):
    return " ".join(rng.choice("qrst") * 3 + str(rng.random()) if rng.random() < share else w for w in words)


def test_large_groups_with_all_degrees_of_likeness(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 16)
    rng = random.Random(4)
    rows = []
    for n in (40, 700):
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))) for k in range(70)]
    chain = [f"c{k}" for k in range(400)]
    rows += [(1000 + k, " ".join(chain[k * 8 : k * 8 + 100])) for k in range(30)]
    common = " ".join(f"p{k}" for k in range(30))
    rows += [(2000 + k, common + " " + " ".join(f"x{k}y{j}" for j in range(60))) for k in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op.near_duplicates(docs)) == expected(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (5, "A  B"), (6, "a b c d e"), (None, "a b"), (7, "é É x y z"), (8, "w " * 200_000), (9, "W " * 100)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    assert result(op.near_duplicates(docs)) == expected(rows)
    assert sorted(str(r.doc_id) for r in op.keep_one(docs).collect()) == sorted(map(str, [1, 2, 3, 4, 6, None, 7, 8]))
    assert op.keep_one(docs).columns == docs.columns
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_are_exact_for_whole_sets():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(10_000, 200, replace=False))
    sets = [np.sort(np.unique(np.r_[base[rng.random(200) < 0.93], rng.choice(10_000, 8)])) for _ in range(30)]
    i, j, _ = op.promising(sets, np.array([len(s) for s in sets]))
    want = {(a, b) for b in range(30) for a in range(b) if 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def row_groups(rows):
    """Groups of row numbers linked by their own sets, whatever their doc_ids."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    group = list(range(len(rows)))
    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [[k for k, g in enumerate(group) if g == own] for own in set(group)]


def test_doc_ids_with_several_texts(spark):
    rows = [(3, "a b c"), (5, "a b c"), (5, "x y z"), (7, "x y z"), (7, ""), (9, "q"), (9, None), (11, "q"), (9, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op.near_duplicates(docs)) == expected(rows)
    kept = sorted((r.doc_id, r.text) for r in op.keep_one(docs).collect() if r.text)
    assert kept == [(3, "a b c"), (5, "x y z"), (9, "q")]


@pytest.mark.parametrize("exact", [False, True])
def test_random_repeated_doc_ids(spark, monkeypatch, exact):
    monkeypatch.setattr(op, "TILE", 8)
    rng = random.Random(7)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 30, 200]))] for _ in range(25)]
    rows = [(rng.randrange(120), edited(rng, rng.choice(bases), rng.choice([0, 0, 0.01, 0.03]))) for _ in range(160)]
    rows += [(rng.randrange(120), "") for _ in range(5)] + rows[:10]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(op.near_duplicates(docs, exact)) == expected(rows)
    kept = [(r.doc_id, r.text) for r in op.keep_one(docs, exact).collect()]
    left = list(kept)
    for group in row_groups(rows):
        if not shingles(rows[group[0]][1]):
            left.remove(rows[group[0]])
            continue
        own = [k for k in left if k in {rows[g] for g in group}]
        assert len(own) == 1 and own[0][0] == min(rows[g][0] for g in group)
        left.remove(own[0])
    assert not left


def test_numbers_of_sets_that_collide_are_drawn_again(spark, monkeypatch):
    hashed, salts = op.F.xxhash64, []

    def poor(*columns):
        if len(columns) == 2 and isinstance(columns[1], str) and columns[1] == "digest":
            salts.append(columns[0])
            if len(salts) == 1:
                return op.F.lit(1).cast("long")
        return hashed(*columns)

    monkeypatch.setattr(op.F, "xxhash64", poor)
    rows = [(1, "a b"), (2, "c d"), (3, "a b")]
    found = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(found) == expected(rows) and len(salts) == 2
