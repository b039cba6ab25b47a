import numpy as np
import pytest

from wallscope.llm import op11_neighbours as op

SHAPE = "vec_id bigint, embedding array<float>, leaf int, score string"


def brute(vectors, queries, k=10):
    """Rows (query, rank, candidate, distance) by comparing everything."""
    good = lambda v: v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
    rows = [(i, np.float32(v).astype(float)) for i, v in vectors if i is not None and good(v)]
    out = []
    for query in sorted({i for i, v in queries if i is not None and good(v)}):
        best = {}
        for own in (np.float32(v).astype(float) for i, v in queries if i == query and good(v)):
            for i, v in rows:
                if i != query and len(v) == len(own):
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((own - v) ** 2).sum())))
        ranked = sorted(best.items(), key=lambda b: (b[1], b[0]))[:k]
        out += [(query, rank, i, d) for rank, (i, d) in enumerate(ranked, 1)]
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SHAPE).repartition(3)
    result = op.search(table, table.where("vec_id % 5 = 0"), **options)
    return sorted(map(tuple, result.select("query_id", "rank", "vec_id", "score").collect()))


def same(got, expected):
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], rel=1e-12, abs=0)


def test_all_leaves_are_exact(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 12)
    monkeypatch.setattr(op, "BLOCK", 7)
    monkeypatch.setattr(op, "QUERIES", 3)
    random = np.random.default_rng(3)
    rows = [(k, random.normal(size=6).tolist()) for k in range(160)]
    rows += [(200 + k, [1.0] * 6) for k in range(40)] + [(300, [1.0] * 6), (301, None), (305, [0.0] * 6), (310, [float("nan")] + [1.0] * 5)]
    rows += [(None, [1.0] * 6), (315, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (321, [1.0, 2.5]), (325, [])]
    rows += [(10, rows[3][1]), (3, rows[20][1]), (3, rows[3][1])]
    same(found(spark, rows, target=1.1), brute(rows, [r for r in rows if r[0] is not None and r[0] % 5 == 0]))


def test_recall_without_structure(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 16)
    random = np.random.default_rng(4)
    rows = [(k, random.normal(size=16).tolist()) for k in range(1500)]
    got = found(spark, rows)
    expected = brute(rows, rows[::5])
    assert len({g[:2] for g in got}) == len(got) == len(expected)
    assert len({(g[0], g[2]) for g in got} & {(e[0], e[2]) for e in expected}) >= 0.95 * len(expected)


def test_clusters_need_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 25)
    random = np.random.default_rng(5)
    middles = random.normal(size=(60, 16)) * 10
    rows = [(k, (middles[k % 60] + random.normal(size=16) / 10).tolist()) for k in range(1800)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SHAPE)
    index = op.collapse(op.sound(table), 11)
    trees = op.fit(index)
    leaves = max(trees[16].leaf) + 1
    assert leaves >= 50
    assert op.calibrate(op._placed(index, trees), table.where("vec_id % 5 = 0"), trees, 10) <= leaves // 5


def test_visits_begin_with_the_own_leaf_and_reach_all():
    random = np.random.default_rng(6)
    x = random.normal(size=(500, 4))
    tree = op.grow(x, 20, 7)
    every = sorted(n for n in tree.leaf if n >= 0)
    assert every == list(range(7, 7 + len(every))) and len(every) > 16
    for own, order in zip(tree.assign(x).tolist(), tree.visits(x, len(tree.leaf))):
        assert order[0] == own and sorted(order) == every


def test_equal_vectors_few_candidates_and_empty_table(spark):
    rows = [(k, [1.0, 1.0]) for k in range(30)]
    same(found(spark, rows), brute(rows, rows[::5]))
    same(found(spark, [(0, [1.0]), (1, [2.0])]), [(0, 1, 1, 1.0)])
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
