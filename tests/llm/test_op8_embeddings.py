import numpy as np
import pytest

from wallscope.llm import op8_embeddings as op
from wallscope.llm import queries


def expected(rows, least=0.95):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, parent = {k: 0 for k in range(len(sound))}, {i: i for i, _ in sound}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, x) in enumerate(sound):
        for q, (j, y) in enumerate(sound[:p]):
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[p] += 1
                links[q] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = [(i, links[p], root(i), i == root(i)) for p, (i, _) in enumerate(sound)]
    known = {i for i, _ in sound}
    return sorted(map(str, out + [(i, 0, i, True) for i, _ in rows if i not in known]))


def result(df):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in df.collect())


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(queries.QUERIES["op8_embeddings"](spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("block", [16, 2048])
def test_clusters_copies_and_odd_rows(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for c in rng.normal(size=(6, 8)):
        rows += [(len(rows) + k, (c + rng.normal(0, 0.22, 8)).tolist()) for k in range(25)]
    rows += [(500 + k, rows[3][1]) for k in range(30)]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [float("nan")] * 8), (604, [1.0, None] * 4), (605, [1.0, 2.0]), (606, [2.0, 4.0])]
    rows += [(607, [1e300] * 8), (608, [1e-300] * 8)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, component_id int")
    got = result(op.near_duplicates(df, block=block))
    want = expected([r for r in rows if r[0] < 605])
    # The last rows overflow in plain double products; both pairs are parallel.
    want += [str(x) for x in ((605, 1, 605, True), (606, 1, 605, False), (607, 1, 607, True), (608, 1, 607, False))]
    assert got == sorted(want)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert result(op.near_duplicates(df)) == sorted(["(None, 0, None, True)"] * 2 + ["(1, 0, 1, True)"])
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(5)
    rows = op.unit(rng.normal(size=(300, 48)) * rng.exponential(size=(300, 48)))
    codes, scale, missed = op.quantise(rows)
    near = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale
    bound = missed[:, None] * (1 + missed) + (1 + missed[:, None]) * missed + missed[:, None] * missed
    assert (np.abs(near - rows @ rows.T) <= bound).all()


def test_rows_dealt_stay_in_proportion(spark, monkeypatch):
    rng = np.random.default_rng(7)
    dealt, deal = [], op._deal
    monkeypatch.setattr(op, "_deal", lambda *a: dealt.append(deal(*a)) or dealt[-1])
    for n in (300, 1500):
        rows = rng.normal(size=(n, 32))
        rows[1::50] = rows[::50] + rng.normal(0, 0.02, (len(rows[::50]), 32))
        rows = list(enumerate(rows.tolist()))
        assert result(op.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=50)) == expected(rows)
        assert dealt[-1].count() <= 2 * op.BLOCKS * n


@pytest.mark.parametrize("dim", [2, 3, 64, 700, 1100])
def test_links_near_the_threshold(dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(300, dim)) * rng.exponential(size=(300, dim)) ** 2
    other = rng.normal(size=(300, dim))
    u = op.unit(a)
    other = op.unit(other - (other * u).sum(1, keepdims=True) * u)
    angle = np.arccos(0.95) + rng.choice([-1e-2, -1e-5, -1e-8, 1e-8, 1e-5, 1e-2, 0.5], 300)[:, None]
    b = np.cos(angle) * u + np.sin(angle) * other
    for x, y, same in ((a, b, False), (np.r_[a, b], np.r_[a, b], True)):
        i, j = op.links(x, y, 0.95, same)
        true = op.unit(x) @ op.unit(y).T
        want = np.triu(true >= 0.95, 1) if same else true >= 0.95
        got = np.zeros_like(want)
        got[i, j] = True
        assert len(i) == want.sum() and (got == want).all()


def test_small_cells_share_blocks():
    pivots = {2: op.unit(np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], [0.1, 1.0]]))}
    cells = [(2, 0, 0.1, 40), (2, 1, 0.1, 40), (2, 2, 0.1, 40), (2, 3, 0.1, 250), (5, 0, 9.0, 30)]
    table, total = op._blocks(cells, pivots, 100)
    place = {(dim, cell): (first, blocks) for dim, cell, _, first, blocks in table}
    assert place == {(2, 0): (0, 1), (2, 2): (0, 1), (2, 3): (1, 3), (2, 1): (4, 1), (5, 0): (5, 1)} and total == 6
